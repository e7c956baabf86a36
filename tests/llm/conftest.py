import pytest

from tillroll.llm.common import read_table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, id int, size string, key int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [
        (1, f"one two three four five six seven {PASSAGE} eight nine"),
        (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "a"), (6, "a"), (6, "b c d"),
        (7, f"other start {PASSAGE} other end, of the text."), (8, LONG), (8, LONG), (None, "no id at all here"),
        (None, None), (None, "no id at all here"), (9, "x " * 400), (10, f"Other START {PASSAGE} other end, of the text."),
        (11, "É<|endoftext|> ümlaut 漢字 \x85   line"), (12, "you are a worthless idiot. He is not an idiot."),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t),
             "row", k, "size", 7) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
