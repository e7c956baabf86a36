"""Runs of words of many texts, interned in an open-addressed table of numpy arrays.

The texts of a batch lie in one byte array in which a word run is a slice. A run's key is its
XXH64. Keys probe a table of slots linearly, all runs at once: a free slot goes to one of the runs
that reach it, a run that meets its own bytes there has found its slot, and the rest probe on.
Equal keys of unlike bytes never share a slot. A slot stores the run's bucket and its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import xxhash

FLAT_BYTES = 1 << 20     # bytes of text that are laid out together; a longer text is laid out alone
WINDOW_WORDS = 1 << 16   # words whose runs are interned together
_PAD = 8
_LONG = 256              # longer slices are hashed one by one
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (  # fixed values: XXH64's primes
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
# word bytes as they are or in lower case, any other as a blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _left(state + lane * _P2, 31) * _P1


def _hash_of_length(flat: np.ndarray, lanes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """XXH64, seed 0, of the slices of one length that start at ``at``."""
    done = 0
    if length >= 32:
        states = [np.zeros(len(at), np.uint64) + p for p in (_P1, _P2, np.uint64(0), ~_P1)]
        states = [states[0] + _P2, states[1], states[2], states[3] + np.uint64(1)]
        while length - done >= 32:
            states = [_round(s, lanes[at + (done + 8 * k)]) for k, s in enumerate(states)]
            done += 32
        h = sum((_left(s, b) for s, b in zip(states[1:], (7, 12, 18))), _left(states[0], 1))
        for s in states:
            h = (h ^ _round(np.uint64(0), s)) * _P1 + _P4
    else:
        h = np.full(len(at), _P5, np.uint64)
    h = h + np.uint64(length)
    while length - done >= 8:
        h = _left(h ^ _round(np.uint64(0), lanes[at + done]), 27) * _P1 + _P4
        done += 8
    if length - done >= 4:
        h = _left(h ^ ((lanes[at + done] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        done += 4
    while done < length:
        h = _left(h ^ (flat[at + done].astype(np.uint64) * _P5), 11) * _P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _crc_table() -> np.ndarray:
    """CRC-32's register after two bytes, by the two bytes xored with its low half."""
    register = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        register = (register >> np.uint32(1)) ^ np.where(register & 1, np.uint32(0xEDB88320), np.uint32(0))
    return register


_TWO_BYTES = _crc_table()
_ONE_BYTE = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)
_ONE_BYTE ^= _ONE_BYTE[0]


def _crc_of_length(flat: np.ndarray, lanes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """CRC-32 of the slices of one length that start at ``at``."""
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for done in range(0, length - 1, 2):
        if done % 8 == 0:
            lane = lanes[at + done]
        crc = (crc >> np.uint32(16)) ^ _TWO_BYTES[(crc ^ lane.astype(np.uint32)) & np.uint32(0xFFFF)]
        lane = lane >> np.uint64(16)
    if length % 2:
        crc = (crc >> np.uint32(8)) ^ _ONE_BYTE[(crc ^ flat[at + (length - 1)]) & np.uint32(0xFF)]
    return ~crc


def _by_length(flat: np.ndarray, lanes: np.ndarray, start: np.ndarray, length: np.ndarray, of_length, of_bytes,
               kind) -> np.ndarray:
    """A function of each slice: all slices of a length at once, very long ones one by one."""
    out = np.empty(len(start), kind)
    order = np.argsort(length.clip(max=_LONG + 1).astype(np.uint16), kind="stable")
    ordered = length[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1, [len(order)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            rows, n = order[a:b], int(ordered[a])
            out[rows] = of_length(flat, lanes, start[rows], n) if n <= _LONG else [
                of_bytes(flat[s:s + n].data) for s in start[rows].tolist()]
    return out


def slice_hashes(flat: np.ndarray, lanes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of the slices of ``flat``; ``lanes`` has the eight bytes from each position on."""
    return _by_length(flat, lanes, start, length, _hash_of_length, xxhash.xxh64_intdigest, np.uint64)


def slice_crcs(flat: np.ndarray, lanes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices."""
    return _by_length(flat, lanes, start, length, _crc_of_length, crc32, np.uint32)


def _same_bytes(flat: np.ndarray, lanes: np.ndarray, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which pairs of slices of equal lengths hold equal bytes."""
    tail = np.uint64(64) - np.uint64(8) * np.minimum(length, 8).astype(np.uint64)
    same = (lanes[one] ^ lanes[other]) << tail == 0  # the first eight bytes, or all of fewer
    at = 8
    left = np.flatnonzero(same & (length > at))
    while len(left):
        step = np.minimum(at, length[left] - 8)      # the last lane ends where the slice ends
        equal = lanes[one[left] + step] == lanes[other[left] + step]
        same[left[~equal]] = False
        at += 8
        left = left[equal & (length[left] > at)]
    return same


@dataclass
class Table:
    """Slots in use, by slot: the bucket and the count of its run; by occurrence: owner and slot."""

    used: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    slot: np.ndarray
    text: np.ndarray


def intern(flat: np.ndarray, lanes: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray,
           buckets: int, keys=slice_hashes) -> Table:
    """The table of all slices. ``keys`` hashes them; unlike slices with equal keys get slots of their own."""
    key = keys(flat, lanes, start, length)
    size = 1 << max(4, (2 * len(start) - 1).bit_length())
    holder = np.full(size, -1, np.int32)             # the occurrence whose bytes stand for the slot
    slot = (key & np.uint64(size - 1)).astype(np.int32)
    open_ = np.arange(len(start), dtype=np.int32)
    while len(open_):
        at = slot[open_]
        free = holder[at] < 0
        holder[at[free]] = open_[free]               # of several one stays
        first = holder[at]
        fits = (key[first] == key[open_]) & (length[first] == length[open_])
        check = np.flatnonzero(fits & (first != open_))
        fits[check] = _same_bytes(flat, lanes, start[first[check]], start[open_[check]], length[open_[check]])
        open_ = open_[~fits]
        slot[open_] = (slot[open_] + 1) & (size - 1)
    used = np.flatnonzero(holder >= 0)
    stands = holder[used]
    bucket = np.zeros(size, np.int32)
    bucket[used] = slice_crcs(flat, lanes, start[stands], length[stands]) % np.uint32(buckets)
    return Table(used, bucket, np.bincount(slot, minlength=size), slot, text)


@dataclass
class Layout:
    """Texts side by side: the bytes, the eight bytes from each position on, and the words' bounds."""

    flat: np.ndarray
    lanes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Layout:
        lines = [b" ".join(t.translate(_FOLD).split()) for t in texts]
        flat = np.frombuffer(b"\n".join(lines) + b"\n" + bytes(_PAD), np.uint8)
        ends = np.flatnonzero(flat[:-_PAD] <= 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        text = np.concatenate(([0], np.cumsum(flat[ends[:-1]] == 10)))
        word = starts < ends
        lanes = np.ndarray((len(flat) - 7,), "<u8", flat.data, strides=(1,))
        return cls(flat, lanes, starts[word], ends[word], text[word].astype(np.int32))


def tables(texts: list[bytes], most: int, buckets: int) -> Iterator[Table]:
    """Tables of all runs of 1 to ``most`` words, every run once, whatever its text's length."""
    laid = Layout.of(texts)
    n_words = len(laid.starts)
    for begin in range(0, n_words, WINDOW_WORDS):
        first, length, text = [], [], []
        for n in range(1, most + 1):
            stop = min(begin + WINDOW_WORDS, n_words - n + 1)
            if stop <= begin:
                break
            whole = laid.text[begin:stop] == laid.text[begin + n - 1:stop + n - 1]
            a = laid.starts[begin:stop][whole]
            first.append(a)
            length.append(laid.ends[begin + n - 1:stop + n - 1][whole] - a)
            text.append(laid.text[begin:stop][whole])
        yield intern(laid.flat, laid.lanes, np.concatenate(first), np.concatenate(length), np.concatenate(text), buckets)


def portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of consecutive texts of ``FLAT_BYTES`` together, one at least."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if k > begin and held + len(t) > FLAT_BYTES:
            yield begin, texts[begin:k]
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]
