"""Byte-level BPE encoding and decoding, merged in batched numpy rounds.

A text is cut into pieces by the vocabulary's pattern. The pieces of a batch that were not met before
lie as byte symbols in one flat array. Each round looks up all neighbouring pairs by binary search
among the sorted pair keys, finds the lowest rank of every piece, and merges that pair wherever it
stands in the piece, from left to right. Pieces without a known pair are finished and leave.

Pieces without any break can be as long as their text. Those above ``LONG_PIECE`` bytes share a flat
array of their own whose symbols are linked to their neighbours. Known pairs wait there by rank; a round
takes the lowest rank, merges its pairs, and looks up only the pairs that a merge has made.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tillroll.llm.common import Batches, batch_of, packed, small_batches

# Fixed value: the published pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_PIECES = 500_000   # pieces a worker remembers before it starts anew
LONGEST_KNOWN = 64       # longer pieces are not remembered
LONG_PIECE = 512         # bytes from which on pieces are merged with links
NO_RANK = np.iinfo(np.int64).max
_UNREAD = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class Vocabulary:
    """Tokens, ranked merges and added tokens of a byte-level BPE file, given as its path or content.

    Files that ask for more than `PATTERN`, byte symbols, ranked merges and plain added tokens are refused.
    """

    def __init__(self, source: str | bytes):
        if isinstance(source, str):
            with open(source, "rb") as file:
                source = file.read()
        said = json.loads(source)
        names, model, cut = _byte_names(), said["model"], said.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or said.get("normalizer") or cut.get("type") != "ByteLevel" \
                or cut.get("add_prefix_space") or not cut.get("use_regex", True) or any(model.get(k) for k in _UNREAD):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t.get(k) for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with conditions are not supported")
        self.text = {i: bytes(names[c] for c in t) for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.text |= {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for i, t in self.text.items():
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        ids = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in c], np.int64) for c in zip(*((a, b, a + b) for a, b in merges)))
        keys = left << 32 | right
        self.pair_of, self.made_of = keys, made  # by rank
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        size = max(self.text) + 1
        self.table = [self.text.get(i, b"") for i in range(size)]


def merge_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each piece as little-endian unsigned 32-bit integers, all pieces merged in rounds."""
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
    keys, finished = vocabulary.keys, []
    while len(symbols):
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = (keys[at] == pair) & (owner[1:] == owner[:-1])
        rank = np.where(known, vocabulary.ranks[at], NO_RANK)
        # the lowest rank of every piece
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        index = np.cumsum(new) - 1
        least = np.minimum.reduceat(np.append(rank, NO_RANK), np.flatnonzero(new))
        done = (least == NO_RANK)[index]
        finished.append((owner[done], symbols[done]))
        merge = np.append(known & (rank == least[index[:-1]]), False)
        # of overlapping pairs (a run of one symbol) every second one merges, from the left
        run = np.flatnonzero(merge)
        if len(run):
            first = np.ones(len(run), bool)
            first[1:] = run[1:] != run[:-1] + 1
            place = np.arange(len(run)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            merge[run[place % 2 == 1]] = False
        into = np.flatnonzero(merge)
        symbols[into] = vocabulary.made[at[into]]
        stays = ~done
        stays[into + 1] = False
        symbols, owner = symbols[stays], owner[stays]
    if not finished:
        return [b""] * len(pieces)
    owner, symbols = map(np.concatenate, zip(*finished))
    raw = symbols[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def merge_long(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """As `merge_pieces`; a round costs what it merges, not the length of the pieces."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int(sizes.sum())
    symbols = np.append(vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], -1)  # -1: no symbol
    after, before, ends = np.arange(1, n + 2), np.arange(-1, n), np.cumsum(sizes)
    after[ends[sizes > 0] - 1] = n
    before[(ends - sizes)[sizes > 0]] = n
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def look_up(place: np.ndarray) -> None:
        pair = symbols[place] << 32 | symbols[after[place]]
        at = np.minimum(np.searchsorted(vocabulary.keys, pair), len(vocabulary.keys) - 1)
        known = vocabulary.keys[at] == pair
        place, rank = place[known], vocabulary.ranks[at[known]]
        order = np.argsort(rank, kind="stable")
        place, rank = place[order], rank[order]
        edges = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))).tolist() if len(rank) else []
        for a, b in zip(edges, [*edges[1:], len(rank)]):
            one = int(rank[a])
            if one not in waiting:
                waiting[one] = []
                heapq.heappush(ranks, one)
            waiting[one].append(place[a:b])

    look_up(np.arange(n))
    while ranks:
        rank = heapq.heappop(ranks)
        pair = int(vocabulary.pair_of[rank])
        place = np.unique(np.concatenate(waiting.pop(rank)))
        place = place[symbols[place] << 32 | symbols[after[place]] == pair]  # others were merged meanwhile
        if pair >> 32 == pair & 0xFFFFFFFF and len(place) > 1:
            # of overlapping pairs every second one merges, from the left
            first = np.concatenate(([True], after[place[:-1]] != place[1:]))
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            place = place[(np.arange(len(place)) - start) % 2 == 0]
        if not len(place):
            continue
        gone = after[place]
        symbols[place], symbols[gone] = vocabulary.made_of[rank], -1
        after[place] = after[gone]
        before[after[place]] = place  # that of the end is never read
        left = before[place]
        look_up(np.unique(np.concatenate((left[left < n], place))))
    out = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        out.append(symbols[a:b][symbols[a:b] >= 0].astype("<u4").tobytes())
    return out


class Encoder:
    """Encodes texts; remembers short pieces as their ids in little-endian 32-bit form."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.cut = regex.compile(PATTERN)
        names = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("|".join(f"({regex.escape(n)})" for n in names)) if names else None

    def pieces(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.cut.findall(text)
        out, at = [], 0
        for found in self.added.finditer(text):
            out += self.cut.findall(text[at:found.start()])
            out.append(found.group())
            at = found.end()
        return out + self.cut.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN_PIECES:
            self.known = {}
        if not self.known:
            self.known = {n: np.array([i], "<u4").tobytes() for n, i in self.vocabulary.added.items()}
        cut = [self.pieces(t) for t in texts]
        fresh = list(set().union(*cut) - self.known.keys()) if cut else []
        now: dict[str, bytes] = {}
        raw = [p.encode() for p in fresh]
        for merge, chosen in ((merge_pieces, [k for k, p in enumerate(raw) if len(p) < LONG_PIECE]),
                              (merge_long, [k for k, p in enumerate(raw) if len(p) >= LONG_PIECE])):
            if chosen:
                now |= zip([fresh[k] for k in chosen], merge([raw[k] for k in chosen], self.vocabulary))
        short = {p: ids for p, ids in now.items() if len(p) <= LONGEST_KNOWN}
        self.known |= short
        find = self.known.__getitem__ if len(short) == len(now) else (self.known | now).__getitem__
        return [b"".join(map(find, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become the replacement character."""
        table = self.vocabulary.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary(content))
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """(row, n_tokens, ids, decoded) of every row; row holds the other columns.

    ``path`` names the vocabulary file on the driver; its content (a fixed few MB) goes to the workers.
    Special tokens that stand in a text are encoded as such; none are added. A null text counts as
    empty: no ids, decoded empty. ``ids`` is the sequence as little-endian unsigned 32-bit integers;
    with ``digest`` ids and decoded are SHA-256 in hex instead. Repeated rows stay repeated, and no
    text is cut, however long.
    """
    small_batches(docs.sparkSession)
    with open(path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            decoded = map(encoder.decode, ids)
            if digest:
                shown = [hashlib.sha256(i).hexdigest() for i in ids]
                texts = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
            else:
                shown, texts = ids, list(decoded)
            schema = pa.schema([("row", batch.column("row").type), ("n_tokens", pa.int64()),
                                ("ids", pa.string() if digest else pa.binary()), ("decoded", pa.string())])
            yield batch_of(schema, batch.column("row"), [len(i) // 4 for i in ids], shown, texts)

    whole = packed(docs).select(
        F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col]).alias("row"),
        F.col("row")[text_col].alias("text"))
    return whole.mapInArrow(run, T.StructType([
        whole.schema["row"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType() if digest else T.BinaryType()), T.StructField("decoded", T.StringType())]))
