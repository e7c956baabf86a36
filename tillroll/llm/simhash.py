"""SimHash near-duplicates: fingerprints linked within a few bits by pigeonring filtering.

The 64 bits lie on a ring of m = max_distance + 1 segments. If two fingerprints differ in at most
max_distance bits, some segment starts a chain whose first l segments together differ in at most
l * max_distance / m bits, for every l. The first segment is then equal and the second differs in
one bit at most, so one of its halves is equal too: segment and half are the key of a bucket.
Inside a bucket the chain is checked segment by segment before the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import Batches, batch_of, checkpointed, packed, small_batches, stored, texts_of
from tillroll.llm.components import connected

BITS = 64
BUCKET_ROWS = 4096          # buckets above this are split by further bits, at every input size
PAIRWISE_ROWS = 16          # smaller buckets are compared at every lag, larger ones by search


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a word list: bit set where over half of the shingles' XXH64 have it; 0 for no words."""
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())],
        np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
    for at in range(0, len(bits), 255):  # sums of 255 rows fit a byte
        ones += bits[at:at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint long) of every row. A null text has no words; ids may be null or repeat."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.lower().split(), shingle, seed) for t in texts_of(batch)]
            ids = batch.column("id")
            schema = pa.schema([("id", ids.type), ("fingerprint", pa.int64())])
            yield batch_of(schema, ids, np.array(found, np.uint64).view(np.int64))

    return slim.mapInArrow(run, f"id {kind}, fingerprint long")


# --- buckets -------------------------------------------------------------------------------

def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, p)) for p in np.array_split(np.array(bits, dtype=int), n)]


def _segments(max_distance: int) -> list[list[int]]:
    return _parts(list(range(BITS)), max_distance + 1)


def _first_masks(max_distance: int) -> list[int]:
    """Equal bits of each bucket path of the first level; path // 2 is the chain's first segment."""
    ring = _segments(max_distance)
    return [_mask(ring[i] + half) for i in range(len(ring))
            for half in _parts(ring[(i + 1) % len(ring)], 2)]


def _finer_masks(masks: list[int], max_distance: int) -> list[int]:
    """Each path's open bits in max_distance + 1 parts, one of which a pair must share."""
    return [mask | _mask(part) for mask in masks
            for part in _parts([b for b in range(BITS) if not mask >> b & 1], max_distance + 1)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _chains(max_distance: int) -> list[list[tuple[int, int]]]:
    """Per first segment: (bits, budget) of its chains of 2, 3, ... m segments."""
    ring = _segments(max_distance)
    m = len(ring)
    return [[(_mask(sum((ring[(i + k) % m] for k in range(l)), [])), l * max_distance // m)
             for l in range(2, m + 1)] for i in range(m)]


def _within(diff: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Positions whose differences keep every budget of the chain; the last is the whole distance."""
    left = np.arange(len(diff))
    for bits, budget in chain:
        left = left[np.bitwise_count(diff[left] & np.uint64(bits)) <= budget]
    return left


def _forest(prints: np.ndarray, chain) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what a bucket connects: a search that visits each member once."""
    rest = prints
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue:
            for one in queue.pop():
                near = _within(rest ^ one, chain)
                if len(near):
                    yield np.full(len(near), one), rest[near]
                    queue.append(rest[near])
                    rest = np.delete(rest, near)


def _bucket_links(max_distance: int, paths_per_segment: int):
    """Rows (key, path, fingerprint) sorted by key and path to links (a, b)."""
    chains = _chains(max_distance)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys: np.ndarray, paths: np.ndarray, prints: np.ndarray):
        same = np.concatenate(([False], (keys[1:] == keys[:-1]) & (paths[1:] == paths[:-1]), [False]))
        starts = np.flatnonzero(~same)
        sizes = np.diff(starts)
        small = np.repeat(sizes <= PAIRWISE_ROWS, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for lag in range(1, PAIRWISE_ROWS):
            at = np.flatnonzero(small[lag:] & (group[lag:] == group[:-lag]))
            if not len(at):
                break
            for segment, chain in enumerate(chains):
                mine = at[paths[at] // paths_per_segment == segment]
                near = mine[_within(prints[mine] ^ prints[mine + lag], chain)]
                if len(near):
                    yield prints[near], prints[near + lag]
        for g in np.flatnonzero(sizes > PAIRWISE_ROWS):
            members = slice(starts[g], starts[g] + sizes[g])
            yield from _forest(prints[members], chains[paths[members][0] // paths_per_segment])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "path", "fingerprint")]
            now[2] = now[2].view(np.uint64)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            # the last bucket may go on in the next batch
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [x[cut:] for x in now]
            for a, b in links(*(x[:cut] for x in now)):
                yield batch_of(schema, a.view(np.int64), b.view(np.int64))
        if held is not None and len(held[0]):
            for a, b in links(*held):
                yield batch_of(schema, a.view(np.int64), b.view(np.int64))

    return run


def link_table(prints: DataFrame, max_distance: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``max_distance`` bits.

    Small buckets give every link, large ones a spanning forest of theirs. A bucket above
    ``bucket_rows`` is not sent to one task: its members take finer keys until every bucket fits.
    Each finer key fixes more bits, so this ends after a few rounds and loses no pair. The keys of
    such buckets may be many: they meet the members in a shuffle join, in which Spark splits hot keys.
    """
    spark = prints.sparkSession
    if max_distance < 1:
        return spark.createDataFrame([], "a long, b long")
    rows = prints.select("fingerprint")
    masks, per_segment, found = _first_masks(max_distance), 2, []
    limit = max(bucket_rows, 64)
    paths = None
    while True:
        if paths is None:
            keyed = rows.select("fingerprint", F.explode(F.array(*[
                F.struct(F.lit(p).alias("path"), F.xxhash64(F.lit(p), F.col("fingerprint").bitwiseAND(
                    F.lit(_signed(m)))).alias("key")) for p, m in enumerate(masks)])).alias("k")
            ).select("fingerprint", "k.path", "k.key")
        else:
            table = F.array(*[F.lit(_signed(m)) for m in masks])
            finer = max_distance + 1
            keyed = paths.select("fingerprint", F.explode(F.sequence(
                F.col("path") * finer, F.col("path") * finer + (finer - 1))).alias("path")
            ).select("fingerprint", "path", F.xxhash64("path", F.col("fingerprint").bitwiseAND(
                F.element_at(table, F.col("path") + 1))).alias("key"))
        crowded = checkpointed(keyed.groupBy("key").count().where(F.col("count") > limit).select("key"))
        split = crowded.hint("merge")
        fit = keyed.join(split, "key", "left_anti")
        found.append(fit.repartition("key").sortWithinPartitions("key", "path").mapInArrow(
            _bucket_links(max_distance, per_segment), "a long, b long"))
        if crowded.isEmpty():
            break
        paths = checkpointed(keyed.join(split, "key", "left_semi").select("fingerprint", "path"))
        masks, per_segment = _finer_masks(masks, max_distance), per_segment * (max_distance + 1)
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_distance: int = 3, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, fingerprint long, component_id, component long) of every row.

    Rows with equal fingerprints, or linked through fingerprints within ``max_distance`` bits, are
    one component. ``component_id`` is its smallest id (null if no row of it has an id) and
    ``component`` its smallest fingerprint by signed value. Texts without words, null ones
    included, have fingerprint 0 and are linked like any other; repeated rows stay repeated; an
    empty table gives no rows; other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("least_id")))
    roots = connected(link_table(nodes, max_distance, bucket_rows))
    labelled = nodes.join(roots, F.col("node") == F.col("fingerprint"), "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("component"))
    labelled = stored(labelled)
    least = stored(labelled.groupBy("component").agg(F.min("least_id").alias("component_id")))
    classes = stored(labelled.join(least, "component").select("fingerprint", "component", "component_id"))
    # both sides are stored, so adaptive execution can split the rows of a hot fingerprint
    return rows.join(classes, "fingerprint").select("id", "fingerprint", "component_id", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_distance: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component does: the smallest id.

    Rows without an id stay only where the whole component has none; then, and where rows share
    the id that stays, the least row by its column values stays. Columns are kept as they are.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, max_distance, seed)
    heads = stored(found.where("id <=> component_id").groupBy("id", "component").count())
    single = heads.groupBy("id").agg(F.sum("count").alias("_rows"))
    # as many ids as documents stay: a merge join at every size, never a broadcast
    kept = packed(docs).join(single.hint("merge"), F.col("row")[id_col].eqNullSafe(single["id"]))
    once = kept.where("_rows = 1").select("row.*")
    if single.where("_rows > 1").isEmpty():
        return once
    # rare: several rows share an id that stays. Which row is of which component needs its fingerprint.
    several = kept.where("_rows > 1").select("row", F.col("row")[text_col].alias("text"))
    member = found.where("id <=> component_id").select("id", "fingerprint", "component").distinct()
    prints = fingerprints(several, "row", "text", shingle, seed).withColumnRenamed("id", "row")
    least = prints.join(member, F.col("row")[id_col].eqNullSafe(member["id"])
                        & (prints["fingerprint"] == member["fingerprint"])) \
        .groupBy("component").agg(F.min("row").alias("row"))
    return once.unionByName(least.select("row.*"))
