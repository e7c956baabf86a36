"""Removal of word sequences that repeat: suffix trees partitioned by prefixes of variable length.

1. Every window of ``window`` words has an anchor, the least hash of the short word groups in it (the
   leftmost of equal ones). Equal windows have equal anchors at equal places, so a window whose anchor
   occurs once is no repeat. Only documents with repeated anchors go on, and whole copies of a text are
   found by the text itself.
2. Suffixes start at the remaining windows and are read from the anchor on: its words are the prefix
   by which they are dealt out. Neighbouring suffixes with one anchor travel as one piece of text, 64
   bits a word. A prefix with more than ``GROUP_PIECES`` places is lengthened to the whole window,
   which splits its group; members that are equal to the last word are one node, of which a task holds
   one place only.
3. A task takes whole groups until they fill ``TREE_SUFFIXES``, sorts their suffixes and compares
   neighbours word by word: suffixes with ``window`` or more words in common hang from one deep inner
   node. All but the least member of a node are repeats. Members that follow one another in a document
   join to its longest repeats.

Before pieces travel, each task merges the equal ones it holds, so a passage found in a third of all
documents sends one piece of each kind a task. The rest are known as repeats at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tillroll.llm.common import Batches, batch_of, packed, small_batches, stored, text_hash

ANCHOR_WORDS = 5
WORD_BYTES = 8
MERGE_PIECES = 100_000  # pieces that a task holds before it sends them
GROUP_PIECES = 30_000  # places of a short prefix; beyond it the prefix is the whole window
TREE_SUFFIXES = 100_000  # suffixes that are sorted at once, and those of one more group
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# --- words and windows ---------------------------------------------------------------------

def _word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * _ODD + hashes[k:k + len(out)]
    return _mixed(out)


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of every window, hash of every short word group)."""
    n = min(ANCHOR_WORDS, window)
    grams = _grams(hashes, n)
    width, least, span = window - n + 1, grams, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = width - span
    return (np.minimum(least[:len(least) - rest], least[rest:]) if rest else least), grams


def _anchor_places(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of every window, first place where the window has it)."""
    n = min(ANCHOR_WORDS, window)
    least = _grams(hashes, n)
    place, span, width = np.arange(len(least)), 1, window - n + 1
    while span < width:
        step = min(span, width - span)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least, span = np.where(right, least[step:], least[:-step]), span + step
    return least, place


# --- anchors -------------------------------------------------------------------------------

_ANCHOR_ROWS = "group long, anchor long, no_id boolean, id {kind}, th int, n int"


def _anchor_rows(window: int):
    """Rows of (group, anchor, document, n): the places of an anchor are summed over the group.

    An anchor that is already seen twice in a batch is known to repeat: its documents' rows then
    form groups of their own (n = 2), and one row without a document stands for them elsewhere.
    """
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, places, owner = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                anchors, grams = _anchors(_word_hashes(words), window)
                anchors, grams = np.unique(anchors), np.sort(grams)
                found.append(anchors)
                places.append(np.searchsorted(grams, anchors, "right") - np.searchsorted(grams, anchors))
                owner.append(np.full(len(anchors), k))
            schema = pa.schema([("group", pa.int64()), ("anchor", pa.int64()), ("no_id", pa.bool_()),
                                ("id", batch.column("id").type), ("th", pa.int32()), ("n", pa.int32())])
            if not found:
                continue
            anchor, places, owner = map(np.concatenate, (found, places, owner))
            each, index = np.unique(anchor, return_inverse=True)
            total = np.bincount(index, places).astype(np.int32)
            known = total[index] > 1
            spread = _mixed(owner.astype(np.uint64) * _ODD + anchor)
            group = np.where(known, spread, anchor)
            yield batch_of(
                schema, group.view(np.int64), anchor.view(np.int64), batch.column("no_id").take(pa.array(owner)),
                batch.column("id").take(pa.array(owner)), batch.column("th").take(pa.array(owner)),
                known.astype(np.int32) + 1)
            witness = each[total > 1]
            yield batch_of(
                schema, witness.view(np.int64), witness.view(np.int64), pa.nulls(len(witness), pa.bool_()),
                pa.nulls(len(witness), batch.column("id").type), pa.nulls(len(witness), pa.int32()), total[total > 1])

    return run


# --- suffixes ------------------------------------------------------------------------------

_PIECES = "prefix long, piece binary, no_id boolean, id {kind}, th int, pos int, len int"

Place = tuple  # (no_id, id, th, pos): places compare as occurrences do


class _Pieces:
    """The first place of each distinct piece, and the windows that start at any other place."""

    def __init__(self, window: int):
        self.window, self.first, self.repeats = window, {}, []

    def windows(self, piece: bytes) -> int:
        return len(piece) // WORD_BYTES - self.window + 1

    def add(self, piece: bytes, prefix: int, place: Place) -> None:
        held, _ = self.first.setdefault(piece, (place, prefix))
        if place == held:  # a repeated row is no repeat of itself
            return
        if place < held:
            self.first[piece], place = (place, prefix), held
        self.repeats.append((*place, self.windows(piece)))

    def add_nodes(self) -> None:
        """Repeats among the suffixes of the pieces: the members of deep nodes but the first."""
        deep = self.window * WORD_BYTES
        suffixes = [(piece[k * WORD_BYTES:], place, k) for piece, (place, _) in self.first.items()
                    for k in range(self.windows(piece))]
        suffixes.sort(key=itemgetter(0))
        node = []
        for k, (suffix, place, step) in enumerate(suffixes):
            if k and not suffix.startswith(suffixes[k - 1][0][:deep]):
                self._add_node(node)
                node = []
            node.append((*place[:3], place[3] + step))
        self._add_node(node)

    def _add_node(self, node: list[Place]) -> None:
        if len(node) > 1:
            first = min(node)
            self.repeats.extend((*place, 1) for place in node if place != first)

    def runs(self) -> Iterator[tuple]:
        """The repeats, those that follow one another in a document as one."""
        self.repeats.sort()
        for _, places in groupby(self.repeats, itemgetter(0, 1, 2)):
            last = None
            for place in places:
                if last and place[3] <= last[3] + last[4]:
                    last = (*last[:4], max(last[4], place[3] + place[4] - last[3]))
                else:
                    if last:
                        yield last
                    last = place
            yield last


def _piece_rows(window: int):
    """Pieces that may repeat elsewhere (len 0), and runs of window starts known to repeat (len > 0)."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, schema = _Pieces(window), None

        def rows() -> Iterator[pa.RecordBatch]:
            out = [(prefix, piece, *place, 0) for piece, (place, prefix) in held.first.items()]
            out += [(hash(r[2:4]), b"", *r) for r in held.runs()]
            for at in range(0, len(out), 20_000):
                yield batch_of(schema, *map(list, zip(*out[at:at + 20_000])))

        for batch in batches:
            schema = pa.schema([("prefix", pa.int64()), ("piece", pa.binary()), ("no_id", pa.bool_()),
                                ("id", batch.column("id").type), ("th", pa.int32()),
                                ("pos", pa.int32()), ("len", pa.int32())])
            columns = [batch.column(c).to_pylist() for c in ("no_id", "id", "th", "text", "copy")]
            anchors, crowded = batch.column("anchors"), batch.column("crowded")
            for k, (no_id, id_, th, text, copy) in enumerate(zip(*columns)):
                repeated = anchors[k].values
                if not copy and (repeated is None or not len(repeated)):
                    continue
                words = (text or b"").split()
                if len(words) < window:
                    continue
                if copy:  # an earlier document has this very text: all its windows repeat
                    held.repeats.append((no_id, id_, th, 0, len(words) - window + 1))
                    continue
                hashes = _word_hashes(words)
                text = hashes.astype(">u8").tobytes()
                anchor, place = _anchor_places(hashes, window)
                pos = np.flatnonzero(np.isin(anchor, _unsigned(repeated)))
                split = np.isin(anchor[pos], _unsigned(crowded[k].values))
                whole = _grams(hashes, window)
                new = np.ones(len(pos), bool)
                new[1:] = (place[pos[1:]] != place[pos[:-1]]) | split[1:]
                at = np.flatnonzero(new)
                prefix = np.where(split, whole[pos], anchor[pos])[at].view(np.int64)
                last = pos[np.append(at[1:], len(pos)) - 1]
                for p, start, end in zip(prefix.tolist(), pos[at].tolist(), (last + window).tolist()):
                    held.add(text[start * WORD_BYTES:end * WORD_BYTES], p, (no_id, id_, th, start))
            if len(held.first) + len(held.repeats) >= MERGE_PIECES:
                yield from rows()
                held = _Pieces(window)
        if schema:
            yield from rows()

    return run


def _unsigned(values: pa.Array | None) -> np.ndarray:
    return np.empty(0, np.uint64) if values is None else values.to_numpy(zero_copy_only=False).view(np.uint64)


def _repeat_rows(window: int):
    """Pieces, each prefix's together, to the repeats among their suffixes as runs of window starts."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, size, group, schema = _Pieces(window), 0, None, None

        def rows() -> Iterator[pa.RecordBatch]:
            out = [(*r[:3], r[3] << 32 | r[4]) for r in held.runs()]
            held.repeats.clear()
            for at in range(0, len(out), 20_000):
                yield batch_of(schema, *map(list, zip(*out[at:at + 20_000])))

        for batch in batches:
            schema = pa.schema([("no_id", pa.bool_()), ("id", batch.column("id").type),
                                ("th", pa.int32()), ("run", pa.int64())])
            names = ("prefix", "piece", "no_id", "id", "th", "pos", "len")
            for prefix, piece, *place, length in zip(*(batch.column(c).to_pylist() for c in names)):
                if prefix != group and size >= TREE_SUFFIXES:
                    held.add_nodes()
                    yield from rows()
                    held, size = _Pieces(window), 0
                elif len(held.repeats) >= TREE_SUFFIXES:  # known for good, so a large group sends them as it goes
                    yield from rows()
                group = prefix
                if length:
                    held.repeats.append((*place, length))
                elif piece in held.first:
                    held.add(piece, prefix, tuple(place))
                else:
                    held.add(piece, prefix, tuple(place))
                    size += held.windows(piece)
        if schema:
            held.add_nodes()
            yield from rows()

    return run


# --- the operator --------------------------------------------------------------------------

def _kept(window: int, digest: bool):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            runs = batch.column("runs")
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = (text or b"").split()
                found = runs[k].values
                n_words.append(len(words))
                if found is None or not len(found):
                    n_removed.append(0)
                    left = words
                else:
                    found = found.to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(words) + 1, np.int32)
                    start = found >> 32
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + (found & 0xFFFFFFFF) - 1 + window, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    left = [words[i] for i in np.flatnonzero(stays).tolist()]
                    n_removed.append(len(words) - len(left))
                if digest:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                elif len(left) == len(words):
                    kept.append(text)
                else:
                    kept.append(b" ".join(left))
            schema = pa.schema([("row", batch.column("row").type), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                                ("kept", pa.string() if digest else pa.binary())])
            yield batch_of(schema, batch.column("row"), n_words, n_removed, kept)

    return run


def _with_runs(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(no_id, id, th, text, runs, row): each text with the window starts that repeat, as (first << 32 | number)."""
    if window < 4:
        raise ValueError("a window has four words at least")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    row, text = F.col("row"), F.col("row")[text_col]
    keyed = packed(docs).select(
        row[id_col].isNull().alias("no_id"), F.coalesce(row[id_col], F.lit(0).cast(kind)).alias("id"),
        text_hash(text).alias("th"), text.cast("binary").alias("text"),
        F.struct(*[row[c].alias(c) for c in docs.columns if c != text_col]).alias("row"))
    key = ["no_id", "id", "th"]

    # whole copies of an earlier text; stored, so that a text with many copies is split in the join
    texts = packed(docs).select(
        row[id_col].isNull().alias("no_id"), F.coalesce(row[id_col], F.lit(0).cast(kind)).alias("id"),
        text_hash(text).alias("th"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")
    ).where(text.isNotNull())
    firsts = stored(texts.groupBy("h1", "h2").agg(F.min(F.struct(*key)).alias("first"), F.count("*").alias("n"))
                    .where("n > 1").select("h1", "h2", "first"))
    copies = texts.join(firsts, ["h1", "h2"]).where(F.struct(*key) != F.col("first"))

    # documents with anchors that repeat, and the anchors with too many places for one group
    anchors = keyed.select(*key, "text").mapInArrow(_anchor_rows(window), _ANCHOR_ROWS.format(kind=kind))
    per_anchor = stored(anchors.withColumn("total", F.expr("sum(n) OVER (PARTITION BY group)"))
                        .where(f"total > 1 AND (no_id IS NOT NULL OR total > {GROUP_PIECES})"))
    crowded = stored(per_anchor.where(f"group = anchor AND total > {GROUP_PIECES}").select("anchor").distinct()) \
        .withColumn("crowd", F.col("anchor"))
    repeated = per_anchor.where("no_id IS NOT NULL").join(crowded, "anchor", "left").select(
        *key, "anchor", "crowd", F.lit(False).alias("copy"))
    none = F.lit(None).cast("long")
    marks = repeated.unionByName(copies.select(
        *key, none.alias("anchor"), none.alias("crowd"), F.lit(True).alias("copy")))
    marks = marks.groupBy(*key).agg(
        F.collect_list("anchor").alias("anchors"), F.collect_list("crowd").alias("crowded"), F.max("copy").alias("copy"))

    pieces = keyed.join(marks, key, "left").select(
        *key, "text", "anchors", "crowded", F.coalesce("copy", F.lit(False)).alias("copy")
    ).sortWithinPartitions(*key).mapInArrow(_piece_rows(window), _PIECES.format(kind=kind))
    subtrees = pieces.repartition("prefix").sortWithinPartitions("prefix")
    runs = subtrees.mapInArrow(_repeat_rows(window), f"no_id boolean, id {kind}, th int, run long") \
        .groupBy(*key).agg(F.collect_list("run").alias("runs"))

    return keyed.join(runs, key, "left").select(*key, "text", "runs", "row")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                   digest: bool = False) -> DataFrame:
    """(row, n_words, n_removed, kept) of every row of ``docs``; row holds its other columns.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document
    with a smaller id, or earlier in the same one. Null ids come after all others; rows with the
    same id count as one document if their texts are equal, else they are ordered by a hash of the
    text. ``kept`` is the text: untouched (null stays null) if nothing goes, else the words left,
    joined by one space, perhaps empty. With ``digest`` it is the SHA-256, in hex, of the words left
    so joined. Words are unlike if they differ in any byte; texts shorter than a window stay.
    """
    ready = _with_runs(docs, id_col, text_col, window)
    return ready.mapInArrow(_kept(window, digest), T.StructType([
        ready.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType() if digest else T.BinaryType())]))


def _stretches(window: int):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, rows, first, words = batch.column("runs"), [], [], []
            for k in range(batch.num_rows):
                found = np.sort(runs[k].values.to_numpy(zero_copy_only=False))
                start, end = found >> 32, np.maximum.accumulate((found >> 32) + (found & 0xFFFFFFFF))
                at = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                first.append(start[at])
                words.append(end[np.append(at[1:], len(end)) - 1] - start[at] + window - 1)
                rows.append(np.full(len(at), k))
            if rows:
                schema = pa.schema([("row", batch.column("row").type), ("first_word", pa.int64()), ("n_words", pa.int64())])
                yield batch_of(schema, batch.column("row").take(pa.array(np.concatenate(rows))),
                               np.concatenate(first), np.concatenate(words))

    return run


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(row, first_word, n_words): the stretches of words all of whose windows also start earlier.

    Each is as long as it can be, counted from word 0; two may overlap by less than a window. The order
    of occurrences, nulls and repeated rows are as in `remove_repeats`, which removes these words.
    """
    found = _with_runs(docs, id_col, text_col, window).where("runs IS NOT NULL").select("runs", "row")
    return found.mapInArrow(_stretches(window), T.StructType([
        found.schema["row"], T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``docs`` with the repeated words gone from its texts; texts left without a word stay as empty.

    Rows, their number and their other columns stay; null texts stay null, null ids come last, rows that
    repeat another with its id count as that one.
    """
    found = remove_repeats(docs, id_col, text_col, window)
    return found.select(*[
        F.col("kept").cast("string").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
