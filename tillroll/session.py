"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution must stay on: plain joins leave hot keys to its skew-join split.
# ANSI mode makes overflow fail instead of wrapping. HotSpot never compiles a method above 8000
# bytes, so Spark should not keep one: it then falls back to smaller generated methods. Cleaning and
# looking up sales lines takes more than twice as long without it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def keep_methods_compiled(spark: SparkSession) -> None:
    """Give a session that came without the package's settings the one that cleaning sales lines depends on."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > int(SETTINGS[name]):
        spark.conf.set(name, SETTINGS[name])


def local_session(cores: int | str = "*", app: str = "tillroll", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
