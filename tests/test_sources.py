import datetime as dt
from types import SimpleNamespace

import pytest

from tillroll import schemas
from tillroll.sources import extracts, sinks
from tillroll.streaming.silver_stream import stream_silver


def write(folder, name, text, newline="\n"):
    path = folder / name
    path.write_bytes(text.replace("\n", newline).encode())
    return str(path)


def test_bronze_is_text_with_blanks(spark, tmp_path):
    path = write(tmp_path, "prd.csv", (
        "prd_id,prd_key,prd_nm,prd_cost,prd_line,prd_start_dt,prd_end_dt\n"
        '210,CO-RF-1," Frame, ""big"" ",,R ,2003-07-01,\n'
        "211,CO-RF-2,NA,007,\t,2003-07-01,\n"), newline="\r\n")
    got = [tuple(r) for r in extracts.read_bronze(spark, "crm_prd_info", path).orderBy("prd_id").collect()]
    assert got == [
        ("210", "CO-RF-1", ' Frame, "big" ', "", "R ", "2003-07-01", ""),
        ("211", "CO-RF-2", "NA", "007", "\t", "2003-07-01", "")]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path, "loc.csv", 'cid,cntry\nAW-1,"United\nStates"\nAW-2,DE\n')
    got = extracts.read_bronze(spark, "erp_loc_a101", path, multi_line=True).orderBy("cid").collect()
    assert [tuple(r) for r in got] == [("AW-1", "United\nStates"), ("AW-2", "DE")]


def test_unexpected_header_is_an_error(spark, tmp_path):
    path = write(tmp_path, "loc.csv", "cid,country\nAW-1,US\n")
    with pytest.raises(Exception, match="(?i)header"):
        extracts.read_bronze(spark, "erp_loc_a101", path).collect()


@pytest.mark.parametrize("text", [
    'cid,cntry\nAW-1,"DE\nX"\n', "cid,cntry\nAW-1,DE,extra\n", "cid,cntry\nAW-2\n"])
def test_torn_and_ragged_records_are_errors(spark, tmp_path, text):
    path = write(tmp_path, "loc.csv", text)
    for columns in (["cid", "cntry"], ["cid"]):
        with pytest.raises(Exception, match="(?i)malformed|failfast"):
            extracts.read_bronze(spark, "erp_loc_a101", path).select(*columns).collect()


def test_all_extracts_can_be_multi_line(spark, tmp_path):
    paths = {"erp_loc_a101": write(tmp_path, "loc.csv", 'cid,cntry\nAW-1,"United\nStates"\n'),
             "erp_px_cat_g1v2": write(tmp_path, "cat.csv", "id,cat,subcat,maintenance\nA,B,C,D\n")}
    got = extracts.read_bronze_all(spark, paths, multi_line=["erp_loc_a101"])
    assert got["erp_loc_a101"].first().cntry == "United\nStates" and got["erp_px_cat_g1v2"].count() == 1


def test_gold_csv_is_typed(spark, tmp_path):
    path = write(tmp_path, "fact.csv", (
        "order_number,product_key,customer_key,order_date,shipping_date,due_date,sales_amount,quantity,price\n"
        "SO1,1,2,2010-12-29,2011-01-05,2011-01-10,3578,1,3578\nSO2,1,,,2011-01-05,2011-01-10,5,1,5\n"))
    fact = extracts.load_fact(spark, path, "csv")
    assert fact.schema == schemas.FACT_SALES
    one, two = fact.orderBy("order_number").collect()
    assert one.order_date == dt.date(2010, 12, 29) and two.order_date is None and two.customer_key is None


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_come_back_whole(spark, tmp_path, fmt):
    rows = spark.createDataFrame(
        [(" AW-1\t", "  padded "), ("", 'quo"te, comma')], schemas.BRONZE["erp_loc_a101"])
    path = sinks.save_tables({"loc": rows}, str(tmp_path / "out"), fmt)["loc"]
    back = extracts.read_table(spark, rows.schema, path, fmt).na.fill("")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_never_over_an_input_or_an_existing_folder(spark, tmp_path):
    rows = spark.range(3)
    out = str(tmp_path / "gold")
    with pytest.raises(ValueError, match="over an input"):
        sinks.save_tables({"t": rows}, out, inputs=[out + "/"])
    (tmp_path / "bronze").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "bronze")
    for target, source in ((out, f"file://{out}/t"), (out, str(tmp_path)), (str(tmp_path / "bronze" / "gold"),
                           str(tmp_path / "bronze")), (str(tmp_path / "link" / "gold"), str(tmp_path / "bronze"))):
        with pytest.raises(ValueError, match="over an input"):
            sinks.save_tables({"t": rows}, target, inputs=[source])
    sinks.save_tables({"t": rows}, out)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_tables({"t": rows}, out)
    assert spark.read.parquet(out + "/t").count() == 3


def test_export_writes_one_header_per_part(spark, tmp_path):
    path = sinks.export_csv(spark.range(100).repartition(4), str(tmp_path / "slice"))
    parts = list((tmp_path / "slice").glob("part-*.csv"))
    assert len(parts) == 4 and all(p.read_text().startswith("id\n") for p in parts)
    assert spark.read.option("header", True).csv(path).count() == 100


def test_views_are_replaced(spark):
    sinks.publish_view(spark.range(3), "report_under_test")
    assert sinks.publish_view(spark.range(5), "report_under_test").count() == 5


def test_tables_are_replaced(spark):
    sinks.publish_table(spark.range(3), "table_under_test")
    assert sinks.publish_table(spark.range(5), "table_under_test").count() == 5
    spark.sql("DROP TABLE table_under_test")


def test_shared_folder_follows_the_session():
    def session(folder, master):
        return SimpleNamespace(
            conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(
                master=master, getCheckpointDir=lambda: None))

    cluster = session("hdfs://store/shared", "yarn")
    one, two = sinks.shared_folder(cluster), sinks.shared_folder(cluster)
    assert one != two and one.startswith("hdfs://store/shared/")
    for master in ("yarn", "local[8]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            sinks.shared_folder(session(None, master))


@pytest.mark.parametrize("text", ["cntry,cid\nDE,AW-1\n", "cid,cntry\nAW-1,DE,extra\n"])
def test_silver_stream_refuses_what_the_batch_reader_does(spark, tmp_path, text):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.csv", text)
    with pytest.raises(Exception):
        stream_silver(spark, "erp_loc_a101", *(str(tmp_path / n) for n in ("in", "out", "state"))).awaitTermination()


def test_silver_stream_takes_only_new_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for name, row in (("a.csv", "AW-1,US\n"), ("b.csv", "AW-2, France \n")):
        write(tmp_path / "in", name, "cid,cntry\n" + row)
        stream_silver(spark, "erp_loc_a101", source, out, state).awaitTermination()
    got = spark.read.parquet(out).orderBy("cid").collect()
    assert [tuple(r) for r in got] == [("AW1", "United States"), ("AW2", "France")]
