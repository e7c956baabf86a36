"""What the text operators share: words, Arrow batches, stored steps."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space. bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Settings for Python workers: batches small enough for whole texts, and a way to this package."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= MAX_BATCH_ROWS:
        spark.conf.set(name, str(MAX_BATCH_ROWS))
    # a local worker may start in another folder; on a cluster the package is installed or shipped
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type)
         for c, t in zip(columns, schema)], schema=schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_hash(text: Column) -> Column:
    """31 bits of the text, which tell apart rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def packed(docs: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that names an operator adds cannot clash with them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tillroll-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def stored(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    path = posixpath.join(checkpoint_folder(rows.sparkSession), f"tillroll-llm-{uuid.uuid4().hex}")
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def checkpointed(rows: DataFrame) -> DataFrame:
    """Like `stored` for the small steps of a loop; Spark removes the files of dropped steps."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


def labelled_sample(docs: DataFrame, known: DataFrame, most: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """(text, label, h) of at most ``most[label]`` distinct texts of each label, stored.

    ``known`` has a label for each id. Ids and texts with the smallest hashes are taken. All that is
    broadcast has at most that many rows.
    """
    def first(rows: DataFrame, *order: Column | str) -> DataFrame:
        parts = [rows.where(F.col("label") == label).orderBy(*order).limit(n) for label, n in most.items()]
        return reduce(DataFrame.unionByName, parts)

    ids = first(known, F.xxhash64("id"), "id")
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    found = whole.select("id", "h").join(F.broadcast(ids), "id").select("label", "h").distinct()
    picked = stored(first(found, "h"))
    texts = whole.join(F.broadcast(ids), "id").join(F.broadcast(picked), ["label", "h"])
    return stored(texts.groupBy("label", "h").agg(F.first("text").alias("text")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]
