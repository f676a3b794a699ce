"""Word n-grams of a batch of texts, interned in an open-addressed NumPy table.

A slot is found by the XXH64 of an n-gram's bytes, linear probing follows, and an n-gram takes
a slot only if length and bytes are those of the slot's first n-gram, so that two n-grams of
one hash are kept apart.  All steps work on whole arrays: n-grams are (start, length) in one
buffer of the batch's words, each followed by a space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

#: Bytes after the last word, so that a lane may be read at any place of a word.
_PAD = 32


def _word_bytes() -> np.ndarray:
    """For each byte: itself if it may be in a word (digits, letters, all of other alphabets), A-Z in lower case, else 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if chr(b).isascii():
            table[b] = ord(chr(b).lower()) if chr(b).isalnum() else 0
        else:
            table[b] = b
    return table


_WORD_BYTES = _word_bytes()


@dataclass
class Words:
    """Words of texts in order: ``data`` holds each with a space after it; ``row`` is the text that a word is in."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    row: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Words of strings with 32-bit offsets, none null."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if len(texts) else np.zeros(0, np.uint8)
    ends -= ends[0]
    low = _WORD_BYTES[raw]
    inside = low > 0
    edge = np.ones(len(raw) + 1, bool)  # a word may start here
    edge[1:-1] = ~inside[:-1]
    edge[ends] = True
    begin = np.flatnonzero(inside & edge[:-1])
    last = np.ones(len(raw), bool)
    if len(raw):
        last[:-1] = ~inside[1:]
        last[ends[1:][ends[1:] > 0] - 1] = True
    length = np.flatnonzero(inside & last) - begin + 1
    start = np.concatenate([[0], np.cumsum(length + 1)])
    data = np.full(int(start[-1]) + _PAD, 32, np.uint8)
    packed = low[inside]
    data[np.arange(len(packed)) + np.repeat(np.arange(len(begin)), length)] = packed
    return Words(data, start[:-1], length, np.searchsorted(ends, begin, side="right") - 1)


def ngrams(words: Words, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of all runs of 1 to ``orders`` consecutive words of one text, repeats included."""
    starts, lengths, rows = [], [], []
    end = words.start + words.length
    for k in range(min(orders, len(words.start))):
        n = len(words.start) - k
        whole = words.row[:n] == words.row[k:]
        first = words.start[:n][whole]
        starts.append(first)
        lengths.append(end[k:][whole] - first)
        rows.append(words.row[:n][whole])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(lengths or none), np.concatenate(rows or none)


def lanes(data: np.ndarray, type_: str) -> np.ndarray:
    """The little-endian number at every byte of a padded buffer."""
    width = np.dtype(type_).itemsize
    return np.ndarray((len(data) - width + 1,), type_, data, 0, (1,))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(state + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of many byte strings of one padded buffer."""
    eight, four = lanes(data, "<u8"), lanes(data, "<u4")
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(start), s + _P5)
        at = start.copy()
        long = np.flatnonzero(length >= 32)
        if len(long):
            state = [np.full(len(long), v) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            left = length[long] // 32
            place = np.arange(len(long))
            while len(place):
                for k in range(4):
                    state[k][place] = _round(state[k][place], eight[at[long[place]] + 8 * k])
                at[long[place]] += 32
                left[place] -= 1
                place = place[left[place] > 0]
            mixed = _turn(state[0], 1) + _turn(state[1], 7) + _turn(state[2], 12) + _turn(state[3], 18)
            for v in state:
                mixed = (mixed ^ _round(np.zeros(len(long), np.uint64), v)) * _P1 + _P4
            h[long] = mixed
        h += length.astype(np.uint64)
        rest = length % 32
        for k in range(1, 4):
            i = np.flatnonzero(rest >= 8 * k)
            if not len(i):
                break
            h[i] = _turn(h[i] ^ _round(np.zeros(len(i), np.uint64), eight[at[i]]), 27) * _P1 + _P4
            at[i] += 8
        i = np.flatnonzero(rest & 4)
        h[i] = _turn(h[i] ^ (four[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[i] += 4
        for k in range(1, 4):
            i = np.flatnonzero((rest & 3) >= k)
            h[i] = _turn(h[i] ^ (data[at[i]].astype(np.uint64) * _P5), 11) * _P1
            at[i] += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _crc_tables() -> np.ndarray:
    """Row k: what a byte adds to the reflected CRC-32 with k zero bytes after it."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1)
    rows = [row]
    for _ in range(7):
        rows.append(row[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.array(rows, np.uint32)


_CRC = _crc_tables().ravel()


def crc32(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 (of zip files) of many byte strings of one padded buffer, eight bytes at a time."""
    eight = lanes(data, "<u8")
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    at, left = start.copy(), length.copy()
    i = np.flatnonzero(left >= 8)
    while len(i):
        x = eight[at[i]] ^ crc[i]
        new = np.zeros(len(i), np.uint32)
        for k in range(8):
            new ^= _CRC[((x >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) + (7 - k) * 256]
        crc[i] = new
        at[i] += 8
        left[i] -= 8
        i = i[left[i] >= 8]
    x = eight[at] ^ crc
    crc = (crc.astype(np.uint64) >> (8 * left).astype(np.uint64)).astype(np.uint32)
    for k in range(7):
        i = np.flatnonzero(left > k)
        if not len(i):
            break
        crc[i] ^= _CRC[((x[i] >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) + (left[i] - 1 - k) * 256]
    return ~crc


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` and at ``b`` are the same."""
    eight = lanes(data, "<u8")
    same = np.ones(len(a), bool)
    i, offset = np.flatnonzero(a != b), 0
    while len(i):
        differ = eight[a[i] + offset] ^ eight[b[i] + offset]
        part = np.minimum(length[i] - offset, 8)
        differ &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * part.astype(np.uint64))
        same[i] = differ == 0
        offset += 8
        i = i[(differ == 0) & (length[i] > offset)]
    return same


class GramTable:
    """Distinct n-grams of a batch: ``slot`` is each occurrence's place among them."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray | None = None):
        """``hashes``: other keys than XXH64, for tests."""
        n = len(start)
        keys = xxh64(data, start, length) if hashes is None else hashes
        size = 1 << max(1, (2 * n - 1).bit_length()) if n else 2
        owner = np.full(size, -1, np.int64)
        found, pending, place = np.zeros(n, np.int64), np.arange(n), (keys & np.uint64(size - 1)).astype(np.int64)
        while len(pending):
            held = owner[place]
            free = held < 0
            owner[place[free]] = pending[free]  # of several, one stays
            held = owner[place]
            same = (keys[held] == keys[pending]) & (length[held] == length[pending])
            i = np.flatnonzero(same)
            same[i] = _equal(data, start[held[i]], start[pending[i]], length[pending[i]])
            found[pending[same]] = place[same]
            pending, place = pending[~same], (place[~same] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        number = np.zeros(size, np.int64)
        number[used] = np.arange(len(used))
        #: The first occurrence in each slot, and the slot of each occurrence.
        self.first, self.slot = owner[used], number[found]
        self.count = np.bincount(self.slot, minlength=len(used))
        self._data, self._start, self._length = data, start[self.first], length[self.first]

    def buckets(self, number: int) -> np.ndarray:
        """The CRC-32 of each slot's bytes, modulo ``number``."""
        return crc32(self._data, self._start, self._length).astype(np.int64) % number
