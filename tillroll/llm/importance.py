"""Importance resampling: documents drawn by how much likelier their word runs are in a target.

Every run of one to three words falls in one of 10,000 buckets. A bucket's gain is the logarithm of
its share in the target over its share in the documents; a document's weight is the sum of the gains
of its runs. The highest weights, each with Gumbel noise from its id, are a draw without replacement.
Runs are interned in ``ngram_table``: one slot holds bucket and count of a run, and the occurrences
of a batch gather their gains through their slots. The texts are read twice, and stored nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tillroll.llm import ngram_table
from tillroll.llm.common import Batches, batch_of, packed, small_batches, stored, text_hash, texts_of

BUCKETS = 10_000
MOST_WORDS = 3


def _counts(buckets: int):
    """Per task, the number of runs in each bucket."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in ngram_table.portions(texts_of(batch)):
                for table in ngram_table.tables(texts, MOST_WORDS, buckets):
                    np.add.at(total, table.bucket[table.used], table.count[table.used])
        found = np.flatnonzero(total)
        yield batch_of(pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), found.astype(np.int32), total[found])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all runs of all texts; buckets without a run are left out, null texts have none."""
    small_batches(texts.sparkSession)
    rows = packed(texts).select(F.col("row")[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text",
          buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).

    s and S count the documents' runs, in the bucket and in all; t and T those of the target.
    """
    total = Window.partitionBy()  # over the buckets, whose number is fixed
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    sums = [(F.sum(c).over(total) + buckets) for c in (s, t)]
    return (
        docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(bucket_counts(docs, text_col, buckets).withColumnRenamed("n", "s"), "bucket", "left")
        .join(bucket_counts(target, target_text_col, buckets).withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.floor(1000 * F.log((t + 1) * sums[0] / ((s + 1) * sums[1]))).alias("gain")))


def _weights(gain: np.ndarray):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = texts_of(batch)
            n_features, weight = np.zeros(len(all_texts), np.int64), np.zeros(len(all_texts), np.int64)
            for begin, texts in ngram_table.portions(all_texts):
                mine = slice(begin, begin + len(texts))
                for table in ngram_table.tables(texts, MOST_WORDS, len(gain)):
                    of_slot = gain[table.bucket]
                    n_features[mine] += np.bincount(table.text, minlength=len(texts))
                    # whole numbers far below 2^53, so sums of doubles are exact
                    weight[mine] += np.bincount(
                        table.text, weights=of_slot[table.slot], minlength=len(texts)).astype(np.int64)
            schema = pa.schema([("row", batch.column("row").type), ("n_features", pa.int64()), ("weight", pa.int64())])
            yield batch_of(schema, batch.column("row"), n_features, weight)

    return run


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the SHA-256 of seed and id; a null id counts as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(row, n_features, weight, score, rank) of every row of ``docs``; row holds its other columns.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in
    lower case. Of the N rows of at least ``least_words`` words, the floor(percent N / 100) with the
    highest scores are drawn; ranks number them from 1, ties to the smaller id, null ids last, then by
    a hash of the text. Rows alike in all of these are numbered in any order. The others have no rank.

    A null text has no words: weight 0, never drawn. Rows that repeat count each time. Without
    documents nothing is returned; without a target all gains come from the documents alone.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent lies between 0 and 100")
    spark = docs.sparkSession
    small_batches(spark)
    table = gains(docs, target, text_col, target_text_col).orderBy("bucket").collect()  # BUCKETS rows, whatever the input
    gain = np.array([r.gain for r in table], np.int64)

    row = F.col("row")
    texts = packed(docs).select(
        F.struct(F.struct(*[row[c].alias(c) for c in docs.columns if c != text_col]).alias("kept"),
                 row[id_col].alias("id"), text_hash(row[text_col]).alias("th")).alias("row"),
        row[text_col].cast("string").alias("text"))
    scored = texts.mapInArrow(_weights(gain), T.StructType([
        texts.schema["row"], T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]))
    scored = scored.select("*", (F.col("weight") + noise(row["id"], seed)).alias("score"),
                           (F.col("n_features") >= _features_of(least_words)).alias("eligible"))

    # ordered in ranges of scores; a range's first rank follows from the rows of the ranges before it
    order = [F.col("eligible").desc(), F.col("score").desc(), row["id"].asc_nulls_last(), row["th"]]
    ranges = stored(stored(scored).repartitionByRange(*order).select("*", F.spark_partition_id().alias("range")))
    sizes = ranges.groupBy("range").agg(F.count_if("eligible").alias("n"))
    before = Window.orderBy("range")  # one row a range
    starts = sizes.select(
        "range", (F.sum("n").over(before) - F.col("n")).alias("start"),
        F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("most"))
    placed = ranges.join(F.broadcast(starts), "range")  # as many rows as the shuffle has partitions
    drawn = F.col("eligible") & (F.col("start") < F.col("most"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    rank = F.col("start") + within
    named = [row["kept"].alias("row"), F.col("n_features"), F.col("weight"), F.col("score")]
    return placed.where(drawn).select(*named, F.when(rank <= F.col("most"), rank).cast("long").alias("rank")).unionByName(
        placed.where(~drawn).select(*named, F.lit(None).cast("long").alias("rank")))


def _features_of(words: int) -> int:
    """The runs of a text of so many words."""
    return sum(max(0, words - n) for n in range(MOST_WORDS))
