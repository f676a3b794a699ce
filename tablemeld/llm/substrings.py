"""Substring deduplication by relative Lempel-Ziv parsing.

Words that lie in a window of ``window`` consecutive words with an earlier copy go; earlier
means a smaller key, or an earlier start in the same document.

Reference.  Every window has an anchor, the smallest hash among its short word grams, which
depends on the window alone.  Consecutive windows on one anchor form a phrase.  Phrases are
dealt to reference blocks by their anchor, so that a block holds all phrases in which any of
its windows can occur, and a document meets every block that can match it.  A block indexes
its phrases: the first place of each, and which anchors have several different phrases.

Parsing.  A document is factored greedily: a phrase with an earlier copy continues the
factor, whole.  Where a shared passage ends, copies differ within a phrase: those phrases,
the ends of factors, share their anchor with a different phrase, and their windows are
checked one by one against blocks dealt by window.  Runs of windows with earlier copies,
all at least ``window`` words long, become the duplicate spans.

Equal phrases (and windows) of one slice of documents are merged before the shuffle, and an
anchor with very many different phrases in a slice goes to the window check at once, so
that a passage or an anchor that a third of all documents hold makes no large block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablemeld.llm.common import importable, materialize, partitions

WINDOW, GRAM = 20, 5
#: Documents and bytes of text in a slice; characters of text in a group of documents.
SLICE_ROWS, SLICE_BYTES, GROUP_CHARS = 4096, 16 << 20, 16 << 20
#: Different phrases on one anchor in a slice from which on their windows are checked at once.
CROWDED = 32
COPY, CHECK = 1, 2  # what a block says of a phrase: it has an earlier copy; its windows need a check
_MARK = 0xFFFFFFFF
PACKED = "bucket int, phase int, grp int, doc binary, th binary, a binary, b binary, c binary, d binary"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _rolled(h: np.ndarray, k: int, m: np.uint64) -> np.ndarray:
    """Hashes of every k consecutive word hashes."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * m + h[j:j + n]
    out ^= out >> np.uint64(29)
    out *= _M3
    return out ^ (out >> np.uint64(32))


class Parsed:
    """Windows and phrases of one document."""

    def __init__(self, words: list[bytes], window: int):
        self.n = max(0, len(words) - window + 1)
        if not self.n:
            return
        h = np.array([_word(w) for w in words], np.uint64)
        gram = min(GRAM, window)
        g, span = _rolled(h, gram, _M2), window - gram + 1
        at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(1) + np.arange(self.n)
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        self.starts, self.ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [self.n]])
        self.w = _rolled(h, window, _M1)
        self.anchor = g[at[self.starts]]
        lengths = (self.ends - self.starts).astype(np.uint64)
        self.phrase = np.add.reduceat(self.w * _M2 ^ (self.w >> np.uint64(31)), self.starts) + lengths * _M1
        self._h, self._window = h, window

    def second(self) -> np.ndarray:
        """Another hash of every window, independent of ``w``."""
        return (_rolled(self._h, self._window, _M3) >> np.uint64(32)).astype(np.uint32)


def _word(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w)


def _firsts(order_by: list[np.ndarray], same_by: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A sorted order (last key first in importance, as lexsort) and where a new group begins in it."""
    order = np.lexsort(order_by)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in same_by], axis=0)
    return order, new


def _rows(bucket: np.ndarray, phase: int, grp: np.ndarray, doc, th, *columns) -> Iterator[tuple]:
    """Entries packed to one row for each bucket and group of documents."""
    if not len(doc):
        return
    order = np.lexsort((th, doc, grp, bucket))
    cut = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(grp[order]) != 0)) + 1
    for part in np.split(order, cut):
        cells = [c[part].tobytes() for c in (doc, th, *columns)]
        yield (int(bucket[part[0]]), phase, int(grp[part[0]]), *cells, *[b""] * (6 - len(cells)))


def _group_of(doc: np.ndarray, th: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(doc ^ th, groups).astype(np.int32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["bucket", "phase", "grp", "doc", "th", "a", "b", "c", "d"]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _phrases(docs: list[tuple[int, int, list[bytes]]], window: int, buckets: int, groups: int) -> list[tuple]:
    """Packed rows of a slice: phrases for the blocks, and what the slice alone tells (phase 1)."""
    doc, th, anchor, phrase, index = [], [], [], [], []
    for d, t, words in docs:
        p = Parsed(words, window)
        if p.n:
            k = len(p.starts)
            doc.append(np.full(k, d, np.int64))
            th.append(np.full(k, t, np.int64))
            anchor.append(p.anchor)
            phrase.append(p.phrase)
            index.append(np.arange(k, dtype=np.uint32))
    if not doc:
        return []
    doc, th, anchor, phrase, index = map(np.concatenate, (doc, th, anchor, phrase, index))
    order, new = _firsts([index, th, doc, phrase, anchor], [phrase, anchor])
    copies = order[~new]
    head = order[new][np.cumsum(new) - 1][~new]  # the first place of each copy's phrase
    repeated = (doc[copies] == doc[head]) & (th[copies] == th[head]) & (index[copies] == index[head])
    copies = copies[~repeated]  # a repeated row is no earlier copy of itself
    kept = order[new]
    # anchors come together in this order: those with many different phrases are crowded
    edge = np.flatnonzero(np.diff(anchor[kept])) + 1
    sizes = np.diff(np.concatenate([[0], edge, [len(kept)]]))
    crowded = np.repeat(sizes > CROWDED, sizes)
    told = np.concatenate([copies, kept[crowded]])
    status = np.concatenate([np.full(len(copies), COPY, np.uint8), np.full(int(crowded.sum()), CHECK, np.uint8)])
    marks = np.unique(anchor[kept[crowded]])
    kept = kept[~crowded]
    out = []
    grp = _group_of(doc[told], th[told], groups)
    out += _rows(np.mod(grp, buckets).astype(np.int32), 1, grp, doc[told], th[told], index[told], status)
    bucket = lambda x: (x % np.uint64(buckets)).astype(np.int32)
    short = lambda x: (x >> np.uint64(32)).astype(np.uint32)
    zero = np.zeros(len(kept), np.int32)
    out += _rows(bucket(anchor[kept]), 0, zero, doc[kept], th[kept], short(anchor[kept]), phrase[kept], index[kept])
    none = np.zeros(len(marks), np.int64)
    out += _rows(bucket(marks), 0, none.astype(np.int32), none, none, short(marks), none.astype(np.uint64), np.full(len(marks), _MARK, np.uint32))
    return out


def _joined(group: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group[column]), kind)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "phase", "grp", "doc", "th", "a", "b", "c", "d"])


def _phrase_block(groups: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A reference block: the first place of each phrase, and the anchors with several."""
        passed, own = rows[rows.phase == 1], rows[rows.phase == 0]
        doc, th = _joined(own, "doc", "<i8"), _joined(own, "th", "<i8")
        anchor, phrase, index = _joined(own, "a", "<u4"), _joined(own, "b", "<u8"), _joined(own, "c", "<u4")
        order, new = _firsts([index, th, doc, phrase, anchor], [phrase, anchor, index == _MARK])
        opens = np.ones(len(order), bool)
        opens[1:] = anchor[order][1:] != anchor[order][:-1]
        of_anchor = np.cumsum(opens) - 1
        marked = index[order] == _MARK
        several = np.bincount(of_anchor, weights=new) > 1
        several |= np.bincount(of_anchor, weights=marked) > 0
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        at = order[head]
        same = (doc[order] == doc[at]) & (th[order] == th[at]) & (index[order] == index[at])
        # entries at the first place itself (repeated rows) are first too
        status = np.where(~same, COPY, np.where(several[of_anchor], CHECK, 0)).astype(np.uint8)
        told = (status > 0) & ~marked
        who, status = order[told], status[told]
        out = list(passed.itertuples(index=False, name=None))
        grp = _group_of(doc[who], th[who], groups)
        out += _rows(np.zeros(len(who), np.int32), 1, grp, doc[who], th[who], index[who], status)
        return _frame(out)

    return run


def _window_block(groups: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Windows dealt by content: all but the first place of each have an earlier copy."""
        passed, own = rows[rows.phase == 1], rows[rows.phase == 0]
        doc, th = _joined(own, "doc", "<i8"), _joined(own, "th", "<i8")
        w, v, at = _joined(own, "a", "<u8"), _joined(own, "b", "<u4"), _joined(own, "c", "<u4")
        who = _later(doc, th, w, v, at)[1]
        out = list(passed.itertuples(index=False, name=None))
        out += _rows(np.zeros(len(who), np.int32), 1, _group_of(doc[who], th[who], groups), doc[who], th[who], at[who], at[who] + np.uint32(1))
        return _frame(out)

    return run


def _later(doc, th, w, v, at) -> tuple[np.ndarray, np.ndarray]:
    """Places of first occurrences of windows, and of the others (repeated rows at the first place aside)."""
    order, new = _firsts([at, th, doc, v, w], [v, w])
    if not len(order):
        return order, order
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (doc[order] == doc[head]) & (th[order] == th[head]) & (at[order] == at[head])
    return order[new], order[~same]


def _by_document(rows: pd.DataFrame, kinds: dict[str, str]) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    doc, th = _joined(rows, "doc", "<i8"), _joined(rows, "th", "<i8")
    columns = [_joined(rows, c, k) for c, k in kinds.items()]
    order = np.lexsort((th, doc))
    doc, th = doc[order], th[order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])) + 1
    edges = [0, *cut.tolist(), len(doc)] if len(doc) else [0]
    columns = [c[order] for c in columns]
    return {(int(doc[a]), int(th[a])): tuple(c[a:b] for c in columns) for a, b in zip(edges, edges[1:], strict=False)}


def _checked(window: int, buckets: int, groups: int):
    def run(key, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Factors of a group of documents: whole copies as ranges (phase 1), windows to be checked (phase 0)."""
        said = _by_document(told, {"a": "<u4", "b": "u1"})
        ranges, checks, seen = [], [], set()
        for d, t, text in zip(texts["key"], texts.th, texts.text, strict=True):
            if (d, t) not in said or (d, t) in seen:
                continue
            seen.add((d, t))
            index, status = said[d, t]
            p = Parsed(text.encode().split(), window)
            a, b = p.starts[index], p.ends[index]
            whole = status == COPY
            if whole.any():
                ranges.append((np.full(whole.sum(), d, np.int64), np.full(whole.sum(), t, np.int64), a[whole].astype(np.uint32), b[whole].astype(np.uint32)))
            if not whole.all():
                size = (b - a)[~whole]
                at = np.repeat(a[~whole] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                checks.append((np.full(len(at), d, np.int64), np.full(len(at), t, np.int64), p.w[at], p.second()[at], at.astype(np.uint32)))
        out = []
        if checks:
            doc, th, w, v, at = map(np.concatenate, zip(*checks, strict=True))
            first, later = _later(doc, th, w, v, at)
            ranges.append((doc[later], th[later], at[later], at[later] + np.uint32(1)))
            doc, th, w, v, at = (x[first] for x in (doc, th, w, v, at))
            out += _rows(np.mod(v, buckets).astype(np.int32), 0, np.zeros(len(doc), np.int32), doc, th, w, v, at)
        if ranges:
            doc, th, a, b = map(np.concatenate, zip(*ranges, strict=True))
            grp = np.full(len(doc), key[0], np.int32)
            out += _rows(np.mod(grp, buckets).astype(np.int32), 1, grp, doc, th, a, b)
        return _frame(out)

    return run


def covered(n_words: int, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that starts in one of the ranges."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts.astype(int), 1)
    np.add.at(change, np.minimum(ends.astype(int) + window - 1, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _cleaned(window: int):
    def run(key, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        said = _by_document(told, {"a": "<u4", "b": "<u4"})
        n_words, n_removed, spans, kept = [], [], [], []
        for d, t, text in zip(texts["key"], texts.th, texts.text, strict=True):
            words = text.encode().split()
            gone = covered(len(words), *said[d, t], window) if (d, t) in said else None
            if gone is None:
                n_removed.append(0)
                spans.append([])
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                n_removed.append(int(gone.sum()))
                words_left = np.flatnonzero(~gone).tolist()
            n_words.append(len(words))
            kept.append(b" ".join(words if gone is None else [words[i] for i in words_left]).decode())
        return pd.DataFrame({"place": texts.place, "th": texts.th, "n_words": n_words, "n_removed": n_removed, "spans": spans, "kept": kept})

    return run


def remove_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, ``n_words``, ``n_removed``, ``spans`` (word ranges, end exclusive) and ``kept`` (text of the rest).

    One row for each row of ``documents``.  Words are runs of anything but space and the
    control characters 9 to 13, compared as they are.  Null and empty texts have no words; a
    null key counts as the smallest; of different texts with one key that with the smaller
    hash counts as earlier; repeated rows are one document.  Windows are judged on the input.
    """
    spark = importable(documents.sparkSession)
    docs = documents.select(F.col(f"`{key}`").cast("long").alias("place"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("place", F.coalesce("place", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("th"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = buckets = max(partitions(spark), -(-chars // GROUP_CHARS))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for d, t, x in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                data = x.as_py().encode()
                held.append((d.as_py(), t.as_py(), data.split()))
                size += len(data)
                if len(held) >= SLICE_ROWS or size >= SLICE_BYTES:
                    if rows := _phrases(held, window, buckets, groups):
                        yield _batch(rows)
                    held, size = [], 0
        if held and (rows := _phrases(held, window, buckets, groups)):
            yield _batch(rows)

    grouped = docs.withColumn("grp", F.pmod(F.col("key").bitwiseXOR(F.col("th")), F.lit(groups)).cast("int"))
    told = docs.mapInArrow(slices, PACKED).groupBy("bucket").applyInPandas(_phrase_block(groups), PACKED)
    told = materialize(told, "rlz-phrases")
    found = grouped.groupBy("grp").cogroup(told.groupBy("grp")).applyInPandas(_checked(window, buckets, groups), PACKED)
    ranges = found.groupBy("bucket").applyInPandas(_window_block(groups), PACKED)
    out = "place long, th long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept string"
    cleaned = grouped.groupBy("grp").cogroup(ranges.groupBy("grp")).applyInPandas(_cleaned(window), out)
    return cleaned.select(F.col("place").alias(key), "n_words", "n_removed", "spans", "kept")
