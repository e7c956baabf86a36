"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names are parsed again, and so on. Runs of one
symbol become one symbol. Deterministic coin tossing then labels each symbol by the lowest bit in
which it differs from its left neighbour, a few times over, until labels are below six; phrases begin
at local maxima of the labels. Where a phrase begins depends on a few symbols around it alone, so
equal substrings have the same phrases inside, at whatever offset they stand.

The fingerprint keeps the least hash of a text's phrase names in each of 64 bins. The share of bins
in which two fingerprints agree estimates the overlap of the two sets of phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillroll.llm.common import Batches, small_batches, stored, text_hash

LEVELS = 3                # phrases of about 27 bytes
BINS = 64
EMPTY = 0xFFFF            # a bin without a phrase
BATCH_BYTES = 1 << 20     # bytes parsed together
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


def _tossed(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a symbol differs from its left neighbour, plus that bit's value."""
    one = x.dtype.type(1)
    diff = x ^ left
    lowest = diff & (~diff + one)
    at = np.bitwise_count(lowest - one)
    return (at << np.uint8(1)) | ((x & lowest) != 0)


def _labels(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below six; unequal neighbours keep unequal labels. starts: first symbol of each text."""
    labels, rounds = symbols, 4 if symbols.dtype == np.uint64 else 3
    for _ in range(rounds):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[starts] = labels[starts] ^ labels.dtype.type(1)
        labels = _tossed(labels, left)
    return labels


def _first_of(owner: np.ndarray) -> np.ndarray:
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    return new


def parse(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: symbols of many texts (owner: nondecreasing) to (phrase names, owner)."""
    if not len(symbols):
        return np.zeros(0, np.uint64), owner
    # runs become one symbol, so that neighbours differ
    new = _first_of(owner) | np.concatenate(([True], symbols[1:] != symbols[:-1]))
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(symbols)))
    owner = owner[at]
    if symbols.dtype == np.uint8:
        symbols = symbols[at].astype(np.uint32) | (np.minimum(length - 1, 0xFFFFFF).astype(np.uint32) << np.uint32(8))
    else:
        symbols = np.where(length > 1, _mixed(symbols[at] + length.astype(np.uint64)), symbols[at])
    first = _first_of(owner)
    labels = _labels(symbols, np.flatnonzero(first)).astype(np.int8)
    before, after = np.full(len(labels), -1, np.int8), np.full(len(labels), -1, np.int8)
    inner = ~first[1:]
    before[1:][inner] = labels[:-1][inner]
    after[:-1][inner] = labels[1:][inner]
    begins = np.flatnonzero(first | ((labels > before) & (labels >= after)))
    # a phrase's name is a polynomial hash of its symbols; long phrases use the powers modulo their number
    place = np.arange(len(symbols)) - np.repeat(begins, np.diff(np.append(begins, len(symbols))))
    names = np.add.reduceat(_mixed(symbols.astype(np.uint64)) * _POWERS[place % len(_POWERS)], begins)
    return _mixed(names), owner[begins]


_POWERS = np.cumprod(np.full(64, _ODD, np.uint64))


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Fingerprints (texts x BINS, 16 bits each); an empty text has empty bins only."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= BATCH_BYTES):
            total += len(texts[upto])
            upto += 1
        sizes = np.fromiter(map(len, texts[at:upto]), np.int64, upto - at)
        names: np.ndarray = np.frombuffer(b"".join(texts[at:upto]), np.uint8)
        owner = np.repeat(np.arange(upto - at, dtype=np.int32), sizes)
        for _ in range(LEVELS):
            names, owner = parse(names, owner)
        value = np.minimum((names >> np.uint64(16)) & np.uint64(0xFFFF), np.uint64(EMPTY - 1)).astype(np.uint16)
        cell = owner.astype(np.int64) * BINS + (names >> np.uint64(58)).astype(np.int64)
        np.minimum.at(out[at:upto].reshape(-1), cell, value)
        at = upto
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that hold a phrase in either; 1 if none does."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def shown(prints: np.ndarray) -> list[str]:
    raw = prints.astype(">u2").tobytes().hex()
    step = BINS * 4
    return [raw[k:k + step] for k in range(0, len(raw), step)]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text, or all."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


_INSIDE, _HEAD, _TAIL = range(3)  # a comparison; the first and the last text of a range


def _fields(id_type: str) -> str:
    return (f"id {id_type}, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _comparisons(ids: pa.Array, texts: list[str], following: list[str], own: np.ndarray, theirs: np.ndarray,
                 digest: bool) -> dict[str, pa.Array]:
    """The columns of texts with the texts that follow them; ``own`` and ``theirs`` are their prints."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    prints = fingerprints(changed)
    return {
        "id": ids, "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited": pa.array([hashlib.sha256(t).hexdigest() if digest else t.decode() for t in changed], pa.string()),
        "fingerprint": pa.array(shown(own), pa.string()), "edited_fingerprint": pa.array(shown(prints), pa.string()),
        "near_edited": pa.array(likeness(own, prints), pa.float64()),
        "near_next": pa.array(likeness(own, theirs), pa.float64())}


def _inside(digest: bool):
    """Texts of a range in order to the comparison of each with the next; the range's ends go on as texts."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        kind_of = None
        last = None  # (range, id, text, print) of the text whose successor is not seen yet

        def end(kind: int, bucket: int, id_, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
                "text": pa.array([text], pa.string()), "id": pa.array([id_], kind_of),
                **{c: pa.array([None], t) for c, t in (
                    ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))}})

        for batch in batches:
            buckets, ids, texts = (batch.column(c).to_pylist() for c in ("bucket", "id", "text"))
            if not ids:
                continue
            kind_of = batch.column("id").type
            texts = [t or "" for t in texts]
            prints = fingerprints([t.encode() for t in texts])
            if last is None:
                yield end(_HEAD, buckets[0], ids[0], texts[0])
            else:
                ids, texts, prints = [last[1], *ids], [last[2], *texts], np.concatenate((last[3][None], prints))
            last = (buckets[-1], ids[-1], texts[-1], prints[-1])
            n = len(texts) - 1
            if n:
                found = _comparisons(pa.array(ids[:-1], kind_of), texts[:-1], texts[1:], prints[:-1], prints[1:], digest)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([_INSIDE] * n, pa.int32()), "bucket": pa.array([buckets[-1]] * n, pa.int32()),
                    "text": pa.nulls(n, pa.string()), **found})
        if last is not None:
            yield end(_TAIL, *last[:3])

    return run


def _across(digest: bool):
    """Last texts of ranges with the first text of the next one to comparisons."""
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = (batch.column(c).to_pylist() for c in ("text", "following"))
            if texts:
                own, theirs = (fingerprints([t.encode() for t in some]) for some in (texts, following))
                yield pa.RecordBatch.from_pydict(
                    _comparisons(batch.column("id"), texts, following, own, theirs, digest))

    return run


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   digest: bool = False) -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one with the next smaller id, after the last the first; a lone document
    follows itself. Rows with the same id follow each other by a hash of the text, and rows without an
    id come last, in that order too. Null texts count as empty: no characters, empty bins, likeness 1
    to each other and 0 to any other text. With ``digest`` edited is its SHA-256.

    Texts are dealt out by ranges in that order, equal rows over several ranges if they are many, and
    compared inside each. A range's last text meets the first one of the next range by a join on their
    numbers; only these two texts of a range are stored.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       text_hash(F.col(text_col)).alias("th"), F.monotonically_increasing_id().alias("nth"))
    id_type = slim.schema["id"].dataType.simpleString()
    order = [F.desc_nulls_last("id"), F.desc("th"), F.col("nth")]
    ranges = slim.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("bucket"), "id", "text")
    found = stored(ranges.mapInArrow(_inside(digest), f"kind int, bucket int, text string, {_fields(id_type)}"))

    tails = found.where(F.col("kind") == _TAIL).select("bucket", "id", "text")
    heads = found.where(F.col("kind") == _HEAD).select(F.col("bucket").alias("next"), F.col("text").alias("following"))
    numbers = heads.select(F.col("next").alias("bucket"))  # one row a range
    ring = numbers.select("bucket", F.coalesce(
        F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.partitionBy())).alias("next"))
    across = tails.join(ring, "bucket").join(heads, "next").select("id", "text", "following")
    columns = [c.split()[0] for c in _fields(id_type).split(", ")]
    return found.where(F.col("kind") == _INSIDE).select(*columns).unionByName(
        across.mapInArrow(_across(digest), _fields(id_type)))
