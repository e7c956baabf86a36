"""Builds that become visible at once: tables in a folder of their own, then one row in a manifest.

``out/builds/<build>/<table>`` holds the tables of a build and ``out/manifest`` a row for each build
that was finished and checked. Readers take the newest row. A build that dies midway has written no
row, so the tables before it stay as they are, and a rebuild beside them needs nothing removed.
Null counts, row counts and sums are observed by the write itself, not by another read.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tillroll.sources.sinks import save_tables

_TABLE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("schema", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("nulls", T.MapType(T.StringType(), T.LongType())),
    T.StructField("sums", T.MapType(T.StringType(), T.LongType()))])
MANIFEST = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("build", T.StringType()),
    T.StructField("tables", T.ArrayType(_TABLE))])


@dataclass(frozen=True)
class Measures:
    """What a write saw: rows, NULLs by column, sums by column."""

    rows: int
    nulls: dict[str, int]
    sums: dict[str, int]


@dataclass
class Build:
    """Tables on their way; nobody sees them before ``publish``."""

    spark: SparkSession
    out: str
    inputs: Iterable[str] = ()
    build: str = field(default_factory=lambda: uuid.uuid4().hex)
    tables: dict[str, tuple] = field(default_factory=dict)

    def write(self, name: str, table: DataFrame, sums: Sequence[str] = (), partition_by: Sequence[str] = (),
              cluster_by: Sequence[str] = ()) -> DataFrame:
        """Store a table and return it as stored.

        ``cluster_by`` deals the rows out by ranges of these columns and sorts the files by them.
        With ``partition_by`` each folder then has a file or two, each with a range of its own. Ranges are
        sampled before rows are dealt out, so the rows are kept on the executors' disks meanwhile: the
        sample would otherwise build the whole table a first time.
        """
        built = table.persist(StorageLevel.DISK_ONLY) if cluster_by else None
        if cluster_by:
            table = built.repartitionByRange(*cluster_by)
        seen = Observation(f"{name}-{self.build}")
        observed = table.observe(
            seen, F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls.{c}") for c in table.columns],
            *[F.sum(F.col(f"`{c}`")).cast("bigint").alias(f"sums.{c}") for c in sums])
        folder = posixpath.join(self.out, "builds", self.build)
        try:
            path = save_tables(
                {name: observed}, folder, inputs=self.inputs, partition_by={name: partition_by},
                sort_by={name: cluster_by})[name]
        finally:
            if built is not None:
                built.unpersist()
        found = seen.get

        def of(kind: str) -> dict[str, int]:
            return {k.removeprefix(kind): v for k, v in found.items() if k.startswith(kind)}

        schema = T.StructType([f for f in table.schema if f.name not in partition_by]
                              + [table.schema[c] for c in partition_by])
        self.tables[name] = (path, schema, Measures(found["rows"], of("nulls."), of("sums.")))
        return self.spark.read.schema(schema).parquet(path)

    @property
    def measures(self) -> dict[str, Measures]:
        return {name: seen for name, (_, _, seen) in self.tables.items()}

    def publish(self, check: Callable[[dict[str, Measures]], str | None] | None = None) -> int:
        """Check the build and switch to it; the new version.

        A table that does not hold the rows its write saw, or a finding of ``check``, fails before the
        switch. The switch is one small file. Two builds that end at once get the same version; readers
        agree on the one with the greater name.
        """
        for name, (path, schema, seen) in self.tables.items():
            stored = self.spark.read.schema(schema).parquet(path).count()
            if stored != seen.rows:
                raise ValueError(f"{name} holds {stored} rows, {seen.rows} were written")
        finding = check(self.measures) if check else None
        if finding:
            raise ValueError(f"not published: {finding}")
        version = max([r.version for r in _rows(self.spark, self.out)], default=0) + 1
        row = (version, self.build, [
            (name, path, schema.json(), seen.rows, seen.nulls, seen.sums)
            for name, (path, schema, seen) in self.tables.items()])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(_manifest(self.out))
        return version


def _manifest(out: str) -> str:
    return posixpath.join(out, "manifest")


def _rows(spark: SparkSession, out: str) -> list:
    """The manifest's rows, one for each publication; none before the first."""
    try:
        return spark.read.schema(MANIFEST).json(_manifest(out)).collect()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _chosen(spark: SparkSession, out: str, version: int | None):
    rows = [r for r in _rows(spark, out) if version in (None, r.version)]
    if not rows:
        raise LookupError(f"nothing published in {out}" if version is None else f"no version {version} in {out}")
    return max(rows, key=lambda r: (r.version, r.build))


def current(spark: SparkSession, out: str, version: int | None = None) -> dict[str, DataFrame]:
    """The published tables: the newest, or those of a version."""
    return {t.name: spark.read.schema(T.StructType.fromJson(json.loads(t.schema))).parquet(t.path)
            for t in _chosen(spark, out, version).tables}


def measured(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """(table_name, measure, column_name, value) as observed when the tables were written."""
    found = []
    for t in _chosen(spark, out, version).tables:
        found.append((t.name, "rows", None, t.rows))
        found += [(t.name, kind, c, v) for kind, by in (("nulls", t.nulls), ("sum", t.sums)) for c, v in by.items()]
    return spark.createDataFrame(found, "table_name string, measure string, column_name string, value long")
