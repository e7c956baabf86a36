"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target over its size is how often its documents should be taken: a whole number of
times, and once more with the fraction left. Documents are paired one after the other; random
transfers of words between the two keep their sum until one of them is in or out, and the other goes
on. A group of documents so leaves at most one open; the open ones of many groups meet in a
reduction tree.

A large document, with over a hundredth of its source's words, is first paired with the pool of all
smaller ones: it is drawn, and the pool's fraction makes up for it. So the last open document, by
whose size a source can miss its target, is a small one.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tillroll.llm.common import WORD, Batches, batch_of, packed, small_batches, stored

GROUP_ROWS = 2_000  # documents of a source that are paired in one group
LARGE_SHARE = 100   # a document is large if this many like it exceed its source
POOL = -1           # bucket of a source's large documents, fewer than LARGE_SHARE
FAN_IN = 16         # groups whose open documents meet in one group of the next level


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, rank, n_docs, source_size, target) per source of rows (source, size).

    Weights repeat over the sources in code-point order, a null source last. No target exceeds
    ``cap`` times the source's size; the excess is shared among the others by weight.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranged = stored(totals.repartitionByRange(F.col("source").isNull(), "source")
                    .withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").count()  # one row per range of sources
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    ranked = ranged.join(F.broadcast(offsets), "part").withColumn(
        "rank", F.col("offset") + F.row_number().over(within) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("source", "rank", "n_docs", "source_size", weight.alias("weight")))

    limit = F.lit(float(cap)) * F.col("source_size")
    total = ranked.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, closed = 0.0, -1
    while True:  # the level rises until no further source reaches its limit
        full = F.col("weight") * level >= limit if closed >= 0 else F.lit(False)
        now = ranked.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("fixed"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
                         F.sum(full.cast("long")).alias("closed")).first()
        if not now["open"] or now["closed"] == closed:
            break
        level, closed = (total - now["fixed"]) / now["open"], now["closed"]
    return ranked.select("source", "rank", "n_docs", "source_size",
                         F.least(F.col("weight") * level, limit).alias("target"))


def _draw(*parts: int) -> float:
    """A number in [0, 1) that the parts fix."""
    return xxhash.xxh64_intdigest(struct.pack(f"<{len(parts)}q", *parts)) / 2.0 ** 64


def _transfer(a: float, size_a: float, b: float, size_b: float, u: float) -> tuple[float, float]:
    """Move words between two open documents so that one is out (0) or in (its size); the sum and means stay."""
    to_a, to_b = min(size_a - a, b), min(a, size_b - b)
    if u * (to_a + to_b) < to_b:
        return (size_a if to_a == size_a - a else a + b), (0.0 if to_a == b else b - to_a)
    return (0.0 if to_b == a else a - to_b), (size_b if to_b == size_b - b else b + a)


def _is_open(words: float, size: float) -> bool:
    return 1e-9 * size < words < size * (1 - 1e-9)


def _pooled(fraction: float, left: float, size: float, u: float) -> tuple[bool, float, float]:
    """Draw a large document against the pool of ``left`` words: (taken, the pool's fraction, its words)."""
    left -= size
    taken = u < fraction
    if 0 < fraction < 1 and left > 0:
        fraction = min(1.0, max(0.0, fraction + (fraction - taken) * size / left))
    return taken, fraction, left


def _pool_rows(seed: int):
    """Sorted large documents to the fraction that is left for the pool of each source."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rank", pa.int64()), ("pooled", pa.float64())])
        state = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("rank", "size", "source_size", "fraction", "draw")]
            for rank, size, source_size, fraction, draw in zip(*columns):
                if state is None or state[0] != rank:
                    out += [state[:2]] if state else []
                    state = (rank, fraction, float(source_size))
                state = (rank, *_pooled(state[1], state[2], size, _draw(seed, -2, draw))[1:])
            if out:
                yield batch_of(schema, *zip(*out))
        if state:
            yield batch_of(schema, *zip(state[:2]))

    return run


def _paired(seed: int, level: int):
    """Sorted rows of one level with their words after pairing: 0, the size, or open for one row a group."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rank", pa.int64()), ("bucket", pa.int64()), ("origin", pa.int64()),
                            ("size", pa.float64()), ("words", pa.float64()), ("draw", pa.int64())])
        held = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("rank", "bucket", "origin", "size", "words", "draw")]
            for mine in zip(*columns):
                if held and held[:2] != mine[:2]:
                    out.append(held)
                    held = None
                size, words, draw = mine[3:]
                if not _is_open(words, size):
                    out.append(mine)
                elif held is None:
                    held = mine
                else:
                    a, b = _transfer(held[4], held[3], words, size, _draw(seed, level, draw))
                    first, second = (*held[:4], a, held[5]), (*mine[:4], b, draw)
                    held = second if _is_open(b, size) else first if _is_open(a, held[3]) else None
                    out += [x for x in (first, second) if x is not held]
            if out:
                yield batch_of(schema, *zip(*out))
        if held:
            yield batch_of(schema, *zip(held))

    return run


_ROWS = "rank long, bucket long, origin long, size double, words double, draw long"
_OPEN = "words > 1e-9 * size AND words < size * (1 - 1e-9)"


def _fates(opened: DataFrame, seed: int, levels: int) -> DataFrame:
    """(rank, bucket, fate): whether the document that level 0 left open in the group is taken."""
    decided = []
    for level in range(1, levels + 1):
        up = opened.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        paired = stored(up.repartition("rank", "bucket").sortWithinPartitions(
            "rank", "bucket", F.desc("size"), "origin")
                        .mapInArrow(_paired(seed, level), _ROWS))
        decided.append(paired.where(f"NOT ({_OPEN})").select("rank", "origin", (F.col("words") > 0).alias("fate")))
        opened = paired.where(_OPEN)
    # one document a source is left: it is taken with the chance that is left of it
    chance = F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    decided.append(opened.select("rank", "origin", (chance < F.col("words") / F.col("size")).alias("fate")))
    return reduce(DataFrame.unionByName, decided).withColumnRenamed("origin", "bucket")


def _settled(seed: int):
    """Level 0 again, on whole rows, with the fate of each group's open document at its front."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        group, held, fate, pool, before = None, None, False, None, None
        for batch in batches:
            out: list[tuple] = []  # (place of the row, size, copies)
            names = ("rank", "bucket", "kind", "fate", "size", "words", "draw", "whole", "fraction", "source_size")
            columns = [batch.column(c).to_pylist() for c in names]
            # whole rows stay in Arrow: place 0 has the row still held, the others are the batch's
            carried = [batch.column(c) for c in ("row", "source_size", "target")]
            before = before or [pa.nulls(1, c.type) for c in carried]
            carried = [pa.concat_arrays([b, c]) for b, c in zip(before, carried)]
            schema = pa.schema([("row", carried[0].type), ("size", pa.int64()), ("source_size", pa.int64()),
                                ("target", pa.float64()), ("copies", pa.int64())])

            def done(one: tuple, taken: bool) -> None:
                out.append((one[0], one[1], one[2] + taken))

            for k, (rank, bucket, kind, said, size, words, draw, whole, fraction, total) in enumerate(zip(*columns)):
                if (rank, bucket) != group:
                    if held:
                        done(held, fate)
                    group, held, fate, pool = (rank, bucket), None, False, None
                if kind == 0:
                    fate = said
                    continue
                mine = (k + 1, size, whole, words, draw)
                if bucket == POOL:
                    pool = pool or (fraction, float(total))
                    taken, *pool = _pooled(*pool, size, _draw(seed, -2, draw))
                    done(mine, taken)
                elif not _is_open(words, size):
                    # a text without words takes its chance alone
                    done(mine, words > 0 if size else _draw(seed, -1, draw) < words)
                elif held is None:
                    held = mine
                else:
                    a, b = _transfer(held[3], held[1], words, size, _draw(seed, 0, draw))
                    if _is_open(b, size):
                        done(held, a > 0)
                        held = (*mine[:3], b, draw)
                    else:
                        done(mine, b > 0)
                        if _is_open(a, held[1]):
                            held = (*held[:3], a, held[4])
                        else:
                            done(held, a > 0)
                            held = None
            if out:
                yield _rows(schema, carried, out)
            if held:
                before, held = [c.take(pa.array([held[0]])) for c in carried], (0, *held[1:])
        if held:
            yield _rows(schema, before, [(0, held[1], held[2] + fate)])

    def _rows(schema: pa.Schema, carried: list[pa.Array], out: list[tuple]) -> pa.RecordBatch:
        at, size, copies = zip(*out)
        row, source_size, target = (c.take(pa.array(at)) for c in carried)
        return batch_of(schema, row, size, source_size, target, copies)

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
        seed: int = 7) -> DataFrame:
    """(row, size, source_size, target, copies) of every row; row holds the columns in ``keep`` (else all).

    ``size`` is the number of words (null: 0); ``copies`` how often the row is taken, ``cap`` times at
    most. Sources weigh ``weights`` in turn by code point, a null source last, and share the words of
    all. The result is a function of the rows: ties and repeated rows may swap roles, nothing else
    changes between runs. An empty table, or one without words, takes nothing beyond chance 0.
    """
    small_batches(docs.sparkSession)
    row = F.col("row")
    # stored, so that words are counted once; the steps before the last read no text
    whole = stored(packed(docs).select(
        F.struct(*[row[c].alias(c) for c in keep or docs.columns]).alias("row"),
        row[source_col].alias("source"),
        F.coalesce(F.regexp_count(row[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(row[id_col], F.lit(seed), *[row[c] for c in docs.columns if c not in (id_col, text_col)],
                   F.xxhash64(row[text_col])).alias("draw")))
    sources = source_targets(whole.select("source", "size"), weights, cap)
    # as many lookups as sources; Spark broadcasts them only below its own size limit
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups = F.ceil(F.col("n_docs") / GROUP_ROWS)
    sources = stored(sources.select(
        F.col("source").alias("name"), "rank", "source_size", "target", groups.alias("groups"), ratio.alias("ratio")))
    large = F.col("size") * LARGE_SHARE > F.col("source_size")
    placed = whole.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "row", "rank", F.when(large, F.lit(POOL)).otherwise(F.pmod("draw", "groups")).alias("bucket"),
        "size", "source_size", "target", "draw", F.floor("ratio").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("fraction"))
    pools = stored(placed.where(F.col("bucket") == POOL).select("rank", "size", "source_size", "fraction", "draw")
                   .repartition("rank").sortWithinPartitions("rank", F.desc("size"), "draw")
                   .mapInArrow(_pool_rows(seed), "rank long, pooled double"))  # one row a source at most
    keyed = placed.join(pools, "rank", "left").withColumn(
        "words", F.coalesce("pooled", "fraction") * F.greatest(F.col("size"), F.lit(1))).drop("pooled")

    # level 0 leaves one open document per group; the tree decides them
    slim = keyed.where((F.col("size") > 0) & (F.col("bucket") != POOL)).select(
        "rank", "bucket", F.col("bucket").alias("origin"), F.col("size").cast("double").alias("size"), "words", "draw")
    paired = slim.repartition("rank", "bucket").sortWithinPartitions(
        "rank", "bucket", F.desc("size"), "draw") \
        .mapInArrow(_paired(seed, 0), _ROWS)
    most = sources.agg(F.max("groups").alias("m")).first()["m"] or 1
    fates = _fates(stored(paired.where(_OPEN)), seed, math.ceil(math.log(most, FAN_IN)) + 1 if most > 1 else 1)

    # level 0 once more, on whole rows, each group headed by its open document's fate
    rows = keyed.withColumns({"kind": F.lit(1), "fate": F.lit(None).cast("boolean")})
    heads = fates.withColumn("kind", F.lit(0))
    both = rows.unionByName(heads, allowMissingColumns=True)
    ready = both.repartition("rank", "bucket").sortWithinPartitions(
        "rank", "bucket", "kind", F.desc("size"), "draw")
    return ready.mapInArrow(_settled(seed), T.StructType([
        ready.schema["row"], T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("copies", T.LongType())]))


def take(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed: every row as often as `mix` takes it, columns as they are."""
    mixed = mix(docs, **options)
    return mixed.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
