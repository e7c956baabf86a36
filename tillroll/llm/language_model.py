"""Language-model scoring from a log-frequency Bloom filter.

All training documents are counted: words exactly and word pairs, both by 64-bit hashes. The filter
holds quantised counts of all pairs: a pair of level q = floor(log2 count) is inserted once for each
level from 0 up to q, and probing level after level until one is missing reads it back. Pairs are dealt
to segments by the leading bits of their hash, and each segment is sized by its own insertions, so that
no pair is left out however large the corpus is.

Up to ``FILTER_BYTES`` in all the segments are broadcast to the workers. Beyond that each segment stays
in its row: the distinct pairs of every chunk of texts are sent to the segments, probed there, and come
back to the chunk. Both ways make the same probes and give the same scores.

P(w | v) = (1 - b) * count(v w) / count(v) + b * (count(w) + 1) / (N + V + 1), where b depends on the
size of count(v). It is fitted on every training document, whose own words and pairs are taken off
their counts for it, and which are in the filter like all others. A token's likelihood depends on b only
by the ratio of its two terms, so that numbers of tokens by class and ratio are all the fit needs. The
ratios are stored by text as they are counted; scores are summed from them.

Word counts reach the texts by a shuffle: documents are dealt to chunks, every chunk's distinct words
are counted over the corpus and come back to it as one sorted dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import Batches, batch_of, small_batches, stored, text_hash

FILTER_BYTES = 64 << 20   # a filter up to this size is broadcast
PROBES = 4                # bits of each level of a pair
CHUNK_BYTES = 24 << 20    # text whose words share a dictionary
FLUSH_TOKENS = 3_000_000  # tokens that a task counts before it sends them
STEPS = 16                # of a ratio of pair to word model, by octave, for the fit
OCTAVES = (-24, 64)
SHARES = np.concatenate((np.linspace(0.02, 0.98, 49), [0.99, 0.995, 0.999]))
CLASSES = 48              # of count(v), by powers of two
_END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word has a line break
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_FIRST = np.zeros(1, np.int64)
SCORED_TOKENS = 300_000   # tokens of several texts that are looked up together
ROWS_OUT = 200            # count rows of one batch

WORDS, PAIRS, TOTALS, DICTIONARY, SEGMENT = range(5)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased, and of the end."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = _END
    return out


def _shifted(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """The value before each one; ``first`` before the first of each text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def _pair_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each token after its predecessor; the end stands before the first of a text."""
    return _mixed(_shifted(hashes, starts, _END) * _ODD + hashes)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted hashes byte plane by byte plane: those of a bucket share their leading bytes, which compress."""
    return np.ascontiguousarray(keys, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    n = len(planes) // 8
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).reshape(n)


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The leading bits of hashes; ``buckets`` is a power of two, two or more."""
    return keys >> np.uint64(65 - buckets.bit_length())


def _pieces(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of hashes that are sorted by bucket."""
    number = _buckets_of(keys, buckets)
    edges = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True]))) if len(keys) else []
    for a, b in zip(edges, edges[1:]):
        yield int(number[a]), slice(a, b)


def _by_chunk(keys: np.ndarray, chunks: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk, its hashes in their order, their values)."""
    order = np.argsort(chunks, kind="stable")
    keys, chunks, values = keys[order], chunks[order], values[order]
    edges = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1], [True]))) if len(keys) else []
    for a, b in zip(edges, edges[1:]):
        yield int(chunks[a]), _packed(keys[a:b]), values[a:b].tobytes()


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, their sums, and where each one starts (as flags)."""
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts.astype(np.uint64), np.flatnonzero(first)), first


# --- the filter ----------------------------------------------------------------------------

def _level_hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = _mixed(keys * _ODD + np.uint64((level + 1) * 0x9E3779B9))
    return mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF) | np.uint64(1)


def _spots(start: np.ndarray, step: np.ndarray, probe: int, bits) -> np.ndarray:
    """Bit numbers of one probe in segments of so many bits (below 2^32)."""
    at = start + step * np.uint64(probe) & np.uint64(0xFFFFFFFF)
    return at * bits >> np.uint64(32)


def segment(keys: np.ndarray, levels: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """The bits of one segment: half of them set by all levels of its pairs."""
    insertions = int(levels.astype(np.int64).sum()) + len(levels)
    size = 8 * max(1, -(-int(insertions * probes / np.log(2)) // 8))
    bits = np.zeros(size, np.uint8)
    for level in range(int(levels.max()) + 1 if len(levels) else 0):
        start, step = _level_hashes(keys[levels >= level], level)
        for probe in range(probes):
            bits[_spots(start, step, probe, np.uint64(size))] = 1
    return np.packbits(bits, bitorder="little")


def read_levels(bits: np.ndarray, begins: np.ndarray, sizes: np.ndarray, keys: np.ndarray,
                probes: int = PROBES) -> np.ndarray:
    """Quantised counts by membership probes, level after level; -1 where nothing is held.

    The segment of each key begins at a bit of ``bits`` and has a size in bits, 0 if there is none.
    """
    out = np.full(len(keys), -1, np.int8)
    left = np.flatnonzero(sizes > 0)
    for level in range(64):
        start, step = _level_hashes(keys[left], level)
        begin, size = begins[left], sizes[left]
        for probe in range(probes):
            spot = _spots(start, step, probe, size) + begin
            held = (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1) > 0
            left, start, step, begin, size = (x[held] for x in (left, start, step, begin, size))
        if not len(left):
            break
        out[left] = level
    return out


@dataclass
class Filter:
    """All segments one after the other, the bit at which each begins, and its size in bits."""

    bits: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    buckets: int
    probes: int

    @classmethod
    def of(cls, segments: dict[int, bytes], buckets: int, probes: int = PROBES) -> Filter:
        sizes = np.zeros(buckets, np.uint64)
        for bucket, bits in segments.items():
            sizes[bucket] = len(bits) * 8
        whole = b"".join(segments[k] for k in sorted(segments))
        return cls(np.frombuffer(whole, np.uint8), np.cumsum(sizes) - sizes, sizes, buckets, probes)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        bucket = _buckets_of(keys, self.buckets)
        return read_levels(self.bits, self.begins[bucket], self.sizes[bucket], keys, self.probes)


# --- counting ------------------------------------------------------------------------------

_COUNT_ROWS = "kind int, bucket int, keys binary, counts binary, chunks binary"
_COUNT_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()),
                           ("counts", pa.binary()), ("chunks", pa.binary())])


def _count_rows(word_buckets: int, pair_buckets: int):
    """Counts of a task's tokens by leading hash bits: words by chunk, and pairs."""
    def flush(by_chunk: dict[int, list], pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, counts, chunks = [], [], []
        for chunk, parts in by_chunk.items():
            known, n = np.unique(np.concatenate([h for h, train in parts if train] or [parts[0][0][:0]]),
                                 return_counts=True)
            every = np.unique(np.concatenate([h for h, _ in parts]))
            number = np.zeros(len(every), np.uint32)
            number[np.searchsorted(every, known)] = n
            found.append(every)
            counts.append(number)
            chunks.append(np.full(len(every), chunk, np.uint32))
        found, counts, chunks = map(np.concatenate, (found, counts, chunks))
        order = np.argsort(_buckets_of(found, word_buckets), kind="stable")
        found, counts, chunks = found[order], counts[order], chunks[order]
        rows = [(WORDS, b, _packed(found[s]), counts[s].tobytes(), chunks[s].tobytes())
                for b, s in _pieces(found, word_buckets)]
        keys, number = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.uint64), return_counts=True)
        number = number.astype(np.uint32)
        rows += [(PAIRS, b, _packed(keys[s]), number[s].tobytes(), b"") for b, s in _pieces(keys, pair_buckets)]
        for at in range(0, len(rows), ROWS_OUT):
            yield batch_of(_COUNT_SCHEMA, *zip(*rows[at:at + ROWS_OUT]))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        by_chunk, pairs, held = {}, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("chunk", "train", "text")]
            for chunk, train, text in zip(*columns):
                hashes = tokens(text)
                by_chunk.setdefault(chunk, []).append((hashes, train))
                if train:
                    pairs.append(_pair_keys(hashes, _FIRST))
                held += len(hashes)
            if held >= FLUSH_TOKENS:
                yield from flush(by_chunk, pairs)
                by_chunk, pairs, held = {}, [], 0
        if held:
            yield from flush(by_chunk, pairs)

    return run


_SUMMED = "kind int, place int, keys binary, counts binary, types long, tokens long"


def _summed(probes: int):
    """Sorted count rows to totals: dictionaries of the chunks, segments of the filter, numbers of words."""
    schema = pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("keys", pa.binary()),
                        ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])

    def words(keys, counts, chunks) -> Iterator[tuple]:
        order = np.lexsort((chunks, keys))
        keys, counts, chunks = keys[order], counts[order], chunks[order]
        distinct, totals, first = _totals(keys, counts)
        yield TOTALS, WORDS, b"", b"", int((totals > 0).sum()), int(totals.sum())
        once = first | np.concatenate(([True], chunks[1:] != chunks[:-1]))
        totals = totals[np.cumsum(first) - 1]
        for chunk, held, numbers in _by_chunk(keys[once], chunks[once], totals[once]):
            yield DICTIONARY, chunk, held, numbers, 0, 0

    def pairs(bucket, keys, counts) -> Iterator[tuple]:
        order = np.argsort(keys, kind="stable")
        keys, totals, _ = _totals(keys[order], counts[order])
        yield SEGMENT, bucket, segment(keys, np.log2(totals).astype(np.uint8), probes).tobytes(), b"", 0, 0

    def done(group, parts) -> Iterator[pa.RecordBatch]:
        kind, bucket = group
        keys, counts, chunks = zip(*parts)
        keys, counts = np.concatenate([_unpacked(k) for k in keys]), np.frombuffer(b"".join(counts), np.uint32)
        if kind == WORDS:
            rows = list(words(keys, counts, np.frombuffer(b"".join(chunks), np.uint32)))
        else:
            rows = list(pairs(bucket, keys, counts))
        for at in range(0, len(rows), ROWS_OUT):
            yield batch_of(schema, *zip(*rows[at:at + ROWS_OUT]))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if row[:2] != group:
                    if parts:
                        yield from done(group, parts)
                    group, parts = row[:2], []
                parts.append(row[2:])
        if parts:
            yield from done(group, parts)

    return run


# --- a filter too large to broadcast -------------------------------------------------------

_ASKED = "bucket int, kind int, chunk int, keys binary"


def _asked_rows(buckets: int):
    """The distinct pairs of each chunk by segment; rows come sorted by chunk."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary())])

    def flush(chunk, held) -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.concatenate(held))
        rows = [(b, 1, chunk, _packed(keys[s])) for b, s in _pieces(keys, buckets)]
        for at in range(0, len(rows), ROWS_OUT):
            yield batch_of(schema, *zip(*rows[at:at + ROWS_OUT]))

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        chunk, held, number = None, [], 0
        for batch in batches:
            for where, text in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist()):
                if held and (where != chunk or number >= 2 * FLUSH_TOKENS):
                    yield from flush(chunk, held)
                    held, number = [], 0
                chunk = where
                held.append(_pair_keys(tokens(text), _FIRST))
                number += len(held[-1])
        if held:
            yield from flush(chunk, held)

    return run


def _probed_rows(probes: int):
    """Each segment, then the pairs asked of it, to (chunk, pairs held, their levels and one)."""
    schema = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        bucket, bits = None, None
        for batch in batches:
            out = []
            for now, kind, chunk, keys in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now != bucket:
                    bucket, bits = now, np.zeros(0, np.uint8)
                if kind == 0:
                    bits = np.frombuffer(keys, np.uint8)
                    continue
                asked = _unpacked(keys)
                size = np.full(len(asked), 8 * len(bits), np.uint64)
                levels = read_levels(bits, np.zeros(len(asked), np.uint64), size, asked, probes)
                found = levels >= 0
                out.append((chunk, _packed(asked[found]), (levels[found] + 1).astype(np.uint8).tobytes()))
            if out:
                yield batch_of(schema, *zip(*out))

    return run


def _dealt_levels(texts: DataFrame, segments: DataFrame, buckets: int, tasks: int, probes: int) -> DataFrame:
    """(chunk, keys, counts) of the pairs of each chunk that the segments hold."""
    by_chunk = texts.select("chunk", "text").repartition(tasks, "chunk").sortWithinPartitions("chunk")
    asked = by_chunk.mapInArrow(_asked_rows(buckets), _ASKED)
    own = segments.select(F.col("place").alias("bucket"), F.lit(0).alias("kind"),
                          F.lit(None).cast("int").alias("chunk"), "keys")
    return asked.unionByName(own).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind") \
        .mapInArrow(_probed_rows(probes), "chunk int, keys binary, counts binary")


# --- probabilities -------------------------------------------------------------------------

@dataclass
class Model:
    """What the workers get: the filter (None if dealt) and the corpus totals."""

    filter: Filter | None
    train_tokens: int
    types: int

    def terms(self, counts: np.ndarray, seen: np.ndarray, before: np.ndarray):
        """Per token: word probability, relative pair count as a multiple of it, class of the word before."""
        word = (counts + 1.0) / (self.train_tokens + self.types + 1.0)
        pair = np.minimum(seen, before) / np.maximum(before, 1)
        return word, pair / word, np.minimum(np.log2(before + 1).astype(np.int64), CLASSES - 1)


def _before(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _shifted(counts, starts, counts[starts[1] - 1 if len(starts) > 1 else -1])  # texts end alike


def _repeats(keys: np.ndarray, number: np.ndarray) -> np.ndarray:
    """How often each key stands in its own text."""
    _, at, n = np.unique(_mixed(keys + number * _ODD), return_inverse=True, return_counts=True)
    return n[at]


def _cells(ratios: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The cell of each token in a table of classes by ratios; the first column holds ratios of zero."""
    low, high = OCTAVES
    with np.errstate(divide="ignore"):
        step = np.floor((np.clip(np.log2(ratios), low, high) - low) * STEPS).astype(np.int64) + 1
    return classes * _columns() + np.where(ratios > 0, step, 0)


def _columns() -> int:
    return (OCTAVES[1] - OCTAVES[0]) * STEPS + 2


def _lookup(keys: np.ndarray, values: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], 0).astype(np.float64)


def _dictionary(parts: list[tuple[bytes, bytes]], values: type) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, values)
    keys = np.concatenate([_unpacked(k) for k, _ in parts])
    order = np.argsort(keys)
    return keys[order], np.frombuffer(b"".join(v for _, v in parts), values)[order]


def _without_own(model: Model, counts: np.ndarray, levels: np.ndarray, hashes: np.ndarray, asked: np.ndarray,
                 starts: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Cells of the tokens of training texts, by the counts of all other texts.

    A count of a level is taken as 1.4 times the least one, less the text's own, and rounded down again.
    """
    number = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(hashes))))
    mine = train[number.astype(np.int64)]
    # an end of the text itself stands before its first token
    others = counts - _repeats(hashes, number)
    seen = np.where(levels >= 0, np.floor(1.4 * 2.0 ** levels), 0) - _repeats(asked, number)
    held = np.where(seen >= 1, 2.0 ** np.floor(np.log2(np.maximum(seen, 1))), 0.0)
    _, ratios, classes = model.terms(np.maximum(others, 0), held, np.maximum(_before(others, starts), 0))
    return _cells(ratios[mine], classes[mine])


def _term_rows(shared):
    """Rows sorted by chunk, the chunk's words and dealt pairs before its texts, to the terms of each text.

    Rows without classes have the numbers of left-out training tokens by cell.
    """
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chunk, parts, words, pairs = None, ([], []), None, None
        fit, schema = np.zeros(CLASSES * _columns(), np.int64), None

        def terms(rows: list[int], held: list[np.ndarray], train: list[bool]) -> Iterator[tuple]:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            starts = np.cumsum(sizes) - sizes
            hashes = np.concatenate(held)
            found = _lookup(*words, hashes)
            asked = _pair_keys(hashes, starts)
            levels = model.filter.levels(asked) if model.filter else _lookup(*pairs, asked) - 1
            known = np.add.reduceat((found > 0).astype(np.int64), starts)
            word, ratios, classes = model.terms(
                found, np.where(levels >= 0, 2.0 ** levels, 0.0), _before(found, starts))
            base = np.add.reduceat(np.log10(word), starts)
            if any(train):
                fit[:] += np.bincount(
                    _without_own(model, found, levels, hashes, asked, starts, np.array(train)), minlength=len(fit))
            ratios, classes = ratios.astype(np.float32), classes.astype(np.uint8)
            for k, n, n_known, total, at in zip(rows, sizes.tolist(), known.tolist(), base.tolist(), starts.tolist()):
                yield k, n, n_known, total, classes[at:at + n].tobytes(), ratios[at:at + n].tobytes()

        for batch in batches:
            out, rows, held, train, total = [], [], [], [], 0
            schema = _terms_schema(batch.column("id").type)
            columns = [batch.column(c).to_pylist() for c in ("chunk", "kind", "keys", "counts", "held_out", "text")]
            for k, (where, kind, some, counts, apart, text) in enumerate(zip(*columns)):
                if rows and (where != chunk or total >= SCORED_TOKENS):
                    out += terms(rows, held, train)
                    rows, held, train, total = [], [], [], 0
                if where != chunk:
                    chunk, parts, words = where, ([], []), None
                if kind < 2:
                    parts[kind].append((some, counts))
                    continue
                if words is None:
                    words, pairs = _dictionary(parts[0], np.uint64), _dictionary(parts[1], np.uint8)
                    parts = ([], [])
                rows.append(k)
                held.append(tokens(text))
                train.append(not apart)
                total += len(held[-1])
            if rows:
                out += terms(rows, held, train)
            if out:
                at, *found = zip(*out)
                at = pa.array(at)
                yield batch_of(schema, batch.column("id").take(at), batch.column("held_out").take(at), *found,
                               [None] * len(at), [None] * len(at))
        cells = np.flatnonzero(fit)
        if len(cells):
            yield batch_of(schema, *[[None]] * 7, [cells.tolist()], [fit[cells].tolist()])

    return run


def _terms_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base_score", pa.float64()), ("classes", pa.binary()), ("ratios", pa.binary()),
        ("cells", pa.list_(pa.int32())), ("numbers", pa.list_(pa.int64()))])


def _score_rows(shares: np.ndarray, train_tokens: int):
    """The terms of texts to scores."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for base, classes, ratios in zip(*(batch.column(c).to_pylist() for c in ("base_score", "classes", "ratios"))):
                share = shares[np.frombuffer(classes, np.uint8)]
                ratio = np.frombuffer(ratios, np.float32).astype(np.float64)
                scores.append(base + float(np.log10((1 - share) * ratio + share).sum()))
            schema = pa.schema([
                ("id", batch.column("id").type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                ("score", pa.float64())])
            yield batch_of(schema, *[batch.column(c) for c in ("id", "held_out", "n_tokens", "n_known")],
                           [train_tokens] * len(scores), batch.column("base_score"), scores)

    return run


def _power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          probes: int = PROBES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows where ``held_out`` is not true. ``base_score`` is the add-one word
    model, ``score`` the pair model, both as log10 of the whole text's probability. A null text has no
    words and one token, the end. Repeated rows all count and all have a row. Without training rows
    every word has probability one. A pair that was never seen is read as seen once at a rate of
    0.5 ** ``probes``; no pair is read as rarer than it is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.xxhash64(F.col(id_col), text_hash(F.col(text_col))).alias("place"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    word_buckets, pair_buckets = _power_of_two(max(64, 2 * chunks)), _power_of_two(max(64, 8 * chunks))
    tasks = max(2 * chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = slim.select(F.pmod("place", F.lit(chunks)).cast("int").alias("chunk"), F.lit(2).alias("kind"),
                        "id", "held_out", "text")

    counted = texts.select("chunk", (~F.col("held_out")).alias("train"), "text") \
        .mapInArrow(_count_rows(word_buckets, pair_buckets), _COUNT_ROWS)
    summed = stored(counted.repartition(tasks, "kind", "bucket").sortWithinPartitions("kind", "bucket")
                    .mapInArrow(_summed(probes), _SUMMED))

    totals = summed.where(f"kind = {TOTALS}").agg(F.sum("types"), F.sum("tokens"))
    types, train_tokens = (x or 0 for x in totals.first())
    segments = summed.where(f"kind = {SEGMENT}").select("place", "keys")
    model = Model(None, train_tokens, types)
    words = summed.where(f"kind = {DICTIONARY}").select(
        F.col("place").alias("chunk"), F.lit(0).alias("kind"), "keys", "counts")
    ready = texts.unionByName(words, allowMissingColumns=True)
    if (segments.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) <= FILTER_BYTES:
        held = {r["place"]: bytes(r["keys"]) for r in segments.toLocalIterator()}  # FILTER_BYTES at most
        model.filter = Filter.of(held, pair_buckets, probes)
    else:
        dealt = _dealt_levels(texts, segments, pair_buckets, tasks, probes)
        ready = ready.unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    shared = spark.sparkContext.broadcast(model)  # FILTER_BYTES at most, and a few numbers
    ready = ready.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind")
    id_type = slim.schema["id"].dataType.simpleString()
    terms = stored(ready.mapInArrow(
        _term_rows(shared), f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, "
        "classes binary, ratios binary, cells array<int>, numbers array<long>"))
    shares = _fitted_shares(terms)
    return terms.where("classes IS NOT NULL").drop("cells", "numbers").mapInArrow(
        _score_rows(shares, train_tokens), f"id {id_type}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double")


def _fitted_shares(terms: DataFrame) -> np.ndarray:
    """The likeliest share of the word model for each class over all training tokens, each by the other texts.

    Classes without tokens take the next lower one's.
    """
    counted = terms.where("cells IS NOT NULL").select(F.explode(F.arrays_zip("cells", "numbers")).alias("c")) \
        .groupBy("c.cells").agg(F.sum("c.numbers").alias("n")).collect()  # CLASSES times _columns() at most
    table = np.zeros(CLASSES * _columns())
    for r in counted:
        table[r["cells"]] = r["n"]
    table = table.reshape(CLASSES, -1)
    ratios = np.concatenate(([0.0], 2.0 ** (OCTAVES[0] + (np.arange(_columns() - 1) + 0.5) / STEPS)))
    likely = table @ np.log(np.outer(ratios, 1 - SHARES) + SHARES)
    shares, last = np.empty(CLASSES), 0.9
    for k in range(CLASSES):
        last = SHARES[int(likely[k].argmax())] if table[k].any() else last
        shares[k] = last
    return shares
