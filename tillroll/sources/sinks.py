"""Writers. Each is an action, unlike everything else in the package."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _overlap(a: str, b: str) -> bool:
    """Whether two folders are the same, or one lies in the other, links resolved where they are local."""
    def clean(path: str) -> str:
        if "://" in path and not path.startswith("file://"):
            return posixpath.normpath(path) + "/"
        return os.path.realpath(path.removeprefix("file://").removeprefix("file:")).rstrip("/") + "/"

    a, b = clean(a), clean(b)
    return a.startswith(b) or b.startswith(a)


# Spark's CSV writer trims values unless told not to.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def save_tables(
    tables: dict[str, DataFrame], out: str, fmt: str = "parquet", inputs: Iterable[str] = (),
    partition_by: dict[str, Sequence[str]] | None = None, sort_by: dict[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Write each table to ``out/<name>``; never onto, into or around an input, nor onto an existing folder.

    ``partition_by`` and ``sort_by`` give, by table, folder columns and the order inside files, so
    that a later filter on them reads only what it needs.
    """
    paths = {name: posixpath.join(out, name) for name in tables}
    for target in [out, *paths.values()]:
        if any(_overlap(target, source) for source in inputs):
            raise ValueError(f"refusing to write over an input: {target}")
    for name, table in tables.items():
        folders, order = (partition_by or {}).get(name, ()), (sort_by or {}).get(name, ())
        if order:
            table = table.sortWithinPartitions(*folders, *order)
        writer = table.write.mode("errorifexists").format(fmt).partitionBy(*folders)
        if fmt == "csv":
            writer = writer.options(**_CSV)
        writer.save(paths[name])
    return paths


def export_csv(rows: DataFrame, path: str) -> str:
    """Write a slice as a folder of CSV part files, each with a header."""
    rows.write.mode("errorifexists").options(**_CSV).csv(path)
    return path


def publish_view(rows: DataFrame, name: str) -> DataFrame:
    """(Re)create a session view and return it; `sources.views` has views that outlive the session."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


def publish_table(rows: DataFrame, name: str) -> DataFrame:
    """(Re)create a catalog table and return it."""
    rows.write.mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach, under the session's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return posixpath.join(base, f"tillroll-{uuid.uuid4().hex}")
