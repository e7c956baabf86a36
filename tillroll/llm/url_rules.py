"""URL rules by a sort-merge range join.

A host's labels in reverse order, then the path, make a key under which a rule covers one interval:
all keys that start with its own. Rules and URLs are sorted together and swept: at a URL the stack of
the last rule that opened holds every rule that may still be open, and the innermost one that covers
the key is the longest match. A URL enters once for each parent domain of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.llm.common import LOWER, UPPER, packed, stored


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack) of every rule: itself and the rules around it, innermost first."""
    named = rules.select(
        F.col("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host IS NOT NULL AND host <> ''")
    keyed = named.select(
        F.concat(F.concat_ws(".", _reversed(F.col("host"))), F.lit("/"), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict",
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"))
    # of equal rules a blocking one stands
    keyed = keyed.groupBy("key", "rule", "size", "host_size").agg(
        F.coalesce(F.max(F.when(F.col("verdict") == "block", F.lit("block"))), F.max("verdict")).alias("verdict"))
    starts = keyed.select("key", F.explode(F.sequence(
        F.instr("key", "/"), F.length("key"))).alias("upto")).select(
        "key", F.expr("substring(key, 1, upto)").alias("around"))
    around = keyed.select(
        F.col("key").alias("around"),
        F.struct("size", "host_size", "rule", "verdict", "key").alias("entry"))
    return starts.join(around, "around").groupBy("key").agg(
        F.sort_array(F.collect_set("entry"), asc=False).alias("stack"))


def match(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(row, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has host, path, verdict (allow or block). A rule fits its host and all subdomains where
    the URL's path starts with the rule's; the longest rule (host and path together, then host, then
    code points) wins, and without one ``rule`` is null and the verdict ``default``. Rules without a
    host are void, a null path is empty, and of equal rules with both verdicts block stands. A null
    URL has empty host and path. Repeated URLs are swept once and repeated rows stay repeated.
    """
    url = F.col("row")[url_col]
    rows = packed(pages).select("row", host_of(url).alias("host"), path_of(url).alias("path"))

    targets = rows.select("host", "path").where("host <> ''").distinct()
    labels = _reversed(F.col("host"))
    points = targets.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat_ws(".", F.slice(labels, 1, n)))).alias("domain")
    ).select(F.concat("domain", F.lit("/"), "path").alias("key"), F.lit(1).alias("kind"), "host", "path")
    opened = _rule_stacks(rules)
    stack_type = opened.schema["stack"].dataType
    events = opened.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"),
                           F.lit(None).cast("string").alias("path"), "stack").unionByName(
        points.withColumn("stack", F.lit(None).cast(stack_type)))
    # ranges of the sorted events; stored, as ranges drawn anew may differ
    ranged = stored(events.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()))

    # the stack with which each range is entered: one row for each range
    ends = ranged.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    entered = ends.select("part", F.last("top", ignorenulls=True).over(before).alias("entered"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("own", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1") \
        .join(F.broadcast(entered), "part")
    innermost = F.get(F.filter(F.coalesce("own", "entered"), lambda r: F.col("key").startswith(r["key"])), F.lit(0))
    best = swept.select("host", "path", innermost.alias("found")).where("found IS NOT NULL") \
        .groupBy("host", "path").agg(F.max("found").alias("found"))
    # stored, so that both sides of the join are plain exchanges and a hot URL can be split
    best = stored(best.select("host", "path", "found.rule", "found.verdict"))
    return rows.join(best, ["host", "path"], "left").select(
        "row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
