"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one resolves whole pre-tokens that are in the vocabulary through a minimal perfect
hash: n keys, n slots, one displacement per bucket of keys (hash and displace); the bytes
in the slot are compared, so other keys miss.  Tier two merges the bytes of a miss: they
form a linked list, a heap holds the rank of every neighbouring pair, and the pair of the
lowest rank (leftmost of equals) is merged until none is in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, functions as F

from tablemeld.llm.batches import STEP, plain_strings, steps
from tablemeld.llm.common import importable
from tablemeld.llm.pieces import REMEMBERED, PieceCache, PieceTable

#: The split pattern of GPT-2: under it a space and ASCII letters are always one pre-token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Keys for each bucket on average.
LOAD = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(seed, np.uint64) * _A)
        x = (x ^ (x >> np.uint64(31))) * _B
        return x ^ (x >> np.uint64(29))


def key_hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class PerfectHash:
    """Slots 0 .. n-1 for n distinct keys; any key gets some slot."""

    def __init__(self, keys: list[bytes], seeds: np.ndarray | None = None):
        """``seeds``: those of an earlier hash of the same keys."""
        self.n = len(keys)
        self.buckets = max(1, self.n // LOAD)
        self.seeds = np.zeros(self.buckets, np.int64) if seeds is None else seeds
        if not keys or seeds is not None:
            return
        h = key_hashes(keys)
        b = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        starts = np.searchsorted(b[order], np.arange(self.buckets + 1))
        taken = np.zeros(self.n, bool)
        sizes = np.diff(starts)
        for k in np.argsort(-sizes, kind="stable"):
            if sizes[k] < 2:
                break
            own, first, tried = h[order[starts[k]:starts[k + 1]]], 1, 8
            while True:  # many displacements at once: the last buckets find few free slots
                slots = np.sort((_mixed(own, np.arange(first, first + tried)[:, None]) % np.uint64(self.n)).astype(np.int64), axis=1)
                fits = np.flatnonzero(~taken[slots].any(1) & (slots[:, 1:] != slots[:, :-1]).all(1))
                if len(fits):
                    break
                first, tried = first + tried, min(4 * tried, 4096)
            taken[slots[fits[0]]], self.seeds[k] = True, first + fits[0]
        free = iter(np.flatnonzero(~taken))
        for k in np.flatnonzero(sizes == 1):  # a lone key takes any free slot, which is written down as it is
            self.seeds[k] = -1 - next(free)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = key_hashes(keys)
        seed = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)]
        hashed = (_mixed(h, np.maximum(seed, 0)) % np.uint64(max(1, self.n))).astype(np.int64)
        return np.where(seed < 0, -1 - seed, hashed)


class Vocabulary:
    """Ranks of a tiktoken file: base64 bytes and rank on every line."""

    def __init__(self, data: bytes, pattern: str, seeds: np.ndarray | None = None):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.words = pattern == PATTERN
        keys = list(self.ranks)
        self.hash = PerfectHash(keys, seeds)
        self.slot_key, self.slot_id = [b""] * len(keys), [0] * len(keys)
        for key, slot in zip(keys, self.hash.slots(keys), strict=True):
            self.slot_key[slot], self.slot_id[slot] = key, self.ranks[key]
        self.bytes_of = {i: k for k, i in self.ranks.items()}
        #: Pre-tokens of the last pieces; bounded, and only saves time.
        self.seen: dict[str, tuple[int, ...]] = {}
        #: The id of each byte, and the ids that a left part merges to, by its right part.
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)]
        self.pair: list[dict[int, int]] = [{}] * (1 + max(self.ranks.values()))
        for k, i in self.ranks.items():
            for c in range(1, len(k)):
                if (a := self.ranks.get(k[:c])) is not None and (b := self.ranks.get(k[c:])) is not None:
                    self.pair[a] = self.pair[a] or {}
                    self.pair[a][b] = i
        #: The same of two bytes, by the number that they make.
        self.byte_pair = [self.pair[a].get(b, -1) for a in self.byte_id for b in self.byte_id]
        #: What a list of ids is written as: each id in decimal digits with a comma.
        self.written = {i: b"%d," % i for i in self.bytes_of}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token itself.

        ``rank`` holds, at the left part of each pair, the id that the pair merges to (-1: none).
        A heap entry is such an id and the place; it is stale if the place has another by now.
        Entries of short pre-tokens are small numbers, which Python compares faster.
        """
        merged, n = self.pair, len(piece)
        byte_id, byte_pair = self.byte_id, self.byte_pair
        shift = 12 if n < 4096 else 32
        low = (1 << shift) - 1
        parts = [byte_id[b] for b in piece]
        rank = [byte_pair[a << 8 | b] for a, b in pairwise(piece)]
        heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return parts
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, r = x & low, x >> shift
            if rank[i] != r:
                continue
            j = after[i]
            parts[i], parts[j], rank[j] = r, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = q = merged[r].get(parts[k], -1)
                if q >= 0:
                    heappush(heap, q << shift | i)
            else:
                rank[i] = -1
            k = before[i]
            if k >= 0:
                rank[k] = q = merged[parts[k]].get(r, -1)
                if q >= 0:
                    heappush(heap, q << shift | k)
        return [p for p in parts if p >= 0]

    def encode_pretokens(self, pretokens: list[bytes]) -> list[list[int]]:
        slots = self.hash.slots(pretokens).tolist()
        keys, ids, merge = self.slot_key, self.slot_id, self.merge
        return [[ids[s]] if keys[s] == p else merge(p) for p, s in zip(pretokens, slots, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        find = self.pattern.findall
        # a space and ASCII letters are one pre-token
        cut = [[t] if self.words and t[:1] == " " and t[1:].isalpha() and t.isascii() else find(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        ids = self.seen
        # a piece that is one pre-token is remembered by its piece; tuples of numbers cost the collector nothing
        whole = [pre[0] for pre in cut if len(pre) == 1]
        distinct = [p for p in {p for pre in cut if len(pre) > 1 for p in pre} if p not in ids]
        found = self.encode_pretokens([p.encode() for p in distinct + whole])
        ids.update(zip(distinct, map(tuple, found), strict=False))
        alone = iter(found[len(distinct):])
        return [next(alone) if len(pre) == 1 else [i for p in pre for i in ids[p]] for pre in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[tuple, tuple[Vocabulary, PieceCache, PieceTable]] = {}


def _ready(shared, made) -> tuple[Vocabulary, PieceCache, PieceTable]:
    """The vocabulary of a broadcast, set up once for each worker, and caches of ``made`` for pieces."""
    mark = (hash(shared.value[:2]), made.__name__)
    if mark not in _loaded:
        _loaded.clear()
        v = Vocabulary(*shared.value)

        def encode(texts: list[str]) -> list:
            return [made(v, ids) for ids in v.encode(texts)]

        _loaded[mark] = v, PieceCache(encode), PieceTable(encode)
    return _loaded[mark]


def vocabulary(sc: SparkContext, data: bytes, pattern: str):
    """A vocabulary for executors: the file's bytes (64 MB at most), the split pattern, the perfect hash."""
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary file has at most 64 MB")
    return sc.broadcast((data, pattern, Vocabulary(data, pattern).hash.seeds))


def _piece_ids(v: Vocabulary, ids: list[int]) -> list[int]:
    return ids


def _piece_text(v: Vocabulary, ids: list[int]) -> tuple[int, bytes, bytes]:
    return len(ids), b"".join(map(v.written.__getitem__, ids)), v.decode(ids)


def _id_arrays(rows: list[list[list[int]]]) -> list[pa.Array]:
    return [pa.array([[i for p in row for i in p] for row in rows], pa.list_(pa.int32()))]


def _id_columns(found: tuple[PieceCache, PieceTable], texts: pa.Array) -> list[pa.Array]:
    return _id_arrays(found[0].results(texts.to_pylist()))


def _digest_columns(found: tuple[PieceCache, PieceTable], texts: pa.Array) -> list[pa.Array]:
    """Counts and digests of texts: what their pieces are written as and decode to is gathered in a row and cut."""
    results, codes, bounds = found[1](texts)
    counts, written, decoded = zip(*results, strict=True)
    counts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[codes])])[bounds]
    columns = [pa.array(np.diff(counts), pa.int64())]
    for parts, comma in ((written, 1), (decoded, 0)):
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))[codes])])[bounds].tolist()
        taken = pa.array(parts, pa.large_binary()).take(pa.array(codes))
        data = memoryview(taken.buffers()[2] or b"")
        # the last id of a text has no comma
        columns.append(pa.array([hashlib.sha256(data[a:max(a, b - comma)]).hexdigest() for a, b in pairwise(ends)], pa.string()))
    return columns


def encode(documents: DataFrame, shared, text: str = "text", ids: str = "ids") -> DataFrame:
    """Documents with ``ids`` (array of int) in place of ``text``.

    Null and empty texts have no ids; other columns stay, and one named like ``ids`` is replaced.
    """
    return _apply(documents, shared, text, {ids: "array<int>"}, _piece_ids, _id_columns)


def encode_digest(documents: DataFrame, shared, text: str = "text") -> DataFrame:
    """Documents with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of ``text``.

    The digests are of the decimal ids joined by commas, and of the bytes that the ids decode to.
    """
    return _apply(documents, shared, text, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, _piece_text, _digest_columns)


def _apply(documents: DataFrame, shared, text: str, made: dict[str, str], of_piece, of_rows) -> DataFrame:
    new = {n.lower() for n in made}
    kept = [c for c in documents.columns if c != text and c.lower() not in new]
    df = documents.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("text to encode"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), *(f"`{n}` {t}" for n, t in made.items())])
    names = [*kept, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, *found = _ready(shared, of_piece)
        for batch in batches:
            for part in steps(batch, len(kept), 2 * STEP):  # a bounded amount of text at a time
                made_of = of_rows(found, plain_strings(part.column(len(kept))))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *made_of], names=names)

    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def decode(tokens: DataFrame, shared, ids: str = "ids", data: str = "data") -> DataFrame:
    """Rows with ``data`` (the bytes that the ids stand for) in place of ``ids``; null ids are none."""
    kept = [c for c in tokens.columns if c not in (ids, data)]
    df = tokens.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("ids to decode"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), f"`{data}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, *_ = _ready(shared, _piece_ids)
        for b in batches:
            found = pa.array([v.decode(x or []) for x in b.column(len(kept)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), found], names=[*kept, data])

    importable(df.sparkSession)
    return df.mapInArrow(run, schema)
