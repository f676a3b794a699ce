"""Token-id files of patched frame-of-reference (PFOR) blocks.

Documents are dealt to shards by ranges of their key and sorted, so that the shards in turn
hold all ids in key order; an end id closes each document.  A shard is a table file of
pages.  A page holds whole documents, about ``PAGE`` ids: the keys, the lengths, where its
ids start within the shard, the payload, and an index of the byte at which each block of
the payload starts, so that any id is found without reading the blocks before it.

A block is up to 256 ids: count (2 bytes), minimum (4), width (1), exceptions (2), then the
ids less the minimum, packed at the width that a chosen percentile of them needs, then the
exceptions: places (1 byte each) and the bits that did not fit (4 bytes each).  Numbers are
little-endian.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemeld.llm.batches import STEP, plain_strings, steps
from tablemeld.llm.common import importable, partitions
from tablemeld.llm.pieces import PieceIds, joinable

BLOCK, PERCENTILE, PAGE = 256, 90, 1 << 18
#: Bytes of text that a shard holds about, where that makes more shards than the session's shuffle width.
SHARD = 256 << 20
#: Pieces that a worker remembers here: the library is slow for short texts, but the workers
#: of an executor share its memory (700,000 took over 3 GB with two of them).
REMEMBERED = 450_000
_HEAD = np.dtype([("count", "<u2"), ("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
PAGES = "shard int, page int, first long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, payload binary, block_starts array<int>"


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, list[int]]:
    """Payload and block starts of unsigned 32-bit ids."""
    n = len(ids)
    if not n:
        return b"", []
    count = -(-n // BLOCK)
    grid = np.full(count * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(count, BLOCK)
    low = grid.min(1)
    off = grid - low[:, None]
    rank = min(BLOCK - 1, BLOCK * percentile // 100)
    at = np.partition(off, rank, axis=1)[:, rank]
    width = np.frexp(at.astype(float))[1].astype(np.uint32)  # bits that the percentile needs
    high = (off.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype("<u4")
    rows, cols = np.nonzero(high)
    exceptions = np.bincount(rows, minlength=count)
    body = (BLOCK // 8) * width.astype(np.int64)
    sizes = _HEAD.itemsize + body + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    heads = np.zeros(count, _HEAD)
    heads["count"], heads["low"], heads["width"], heads["exceptions"] = BLOCK, low, width, exceptions
    heads["count"][-1] = n - (count - 1) * BLOCK
    out[starts[:, None] + np.arange(_HEAD.itemsize)] = heads.view(np.uint8).reshape(count, -1)
    for w in np.unique(width[width > 0]):
        for part in _parts(np.flatnonzero(width == w)):
            bits = np.unpackbits(off[part].astype("<u4").view(np.uint8).reshape(len(part), BLOCK, 4), axis=2, count=int(w), bitorder="little")
            out[starts[part, None] + _HEAD.itemsize + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
    nth = np.arange(len(rows)) - (np.cumsum(exceptions) - exceptions)[rows]  # place of an exception among those of its block
    at = (starts + _HEAD.itemsize + body)[rows]
    out[at + nth] = cols
    out[(at + exceptions[rows] + 4 * nth)[:, None] + np.arange(4)] = high[rows, cols].view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts.tolist()


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    """Rows in runs of 512 at most, so that their bits stay few."""
    return [rows[k:k + 512] for k in range(0, len(rows), 512)]


def unpack_blocks(payload: bytes, starts: list[int]) -> np.ndarray:
    """The ids of blocks; ``starts`` may be any run of a page's block starts."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    starts = np.asarray(starts, np.int64)
    heads = raw[starts[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD).ravel()
    grid = np.zeros((len(heads), BLOCK), np.uint32)
    widths = heads["width"].astype(np.int64)
    where = starts + _HEAD.itemsize
    for w in np.unique(widths):
        for part in _parts(np.flatnonzero(widths == w)):
            data = raw[where[part][:, None] + np.arange(BLOCK * w // 8)]
            bits = np.zeros((len(part), BLOCK, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(data, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
            grid[part] = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little").view("<u4")
    counts = heads["exceptions"].astype(np.int64)
    rows = np.repeat(np.arange(len(heads)), counts)
    nth = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    at = (where + BLOCK // 8 * widths)[rows]
    values = raw[(at + counts[rows] + 4 * nth)[:, None] + np.arange(4)].view("<u4").ravel().astype(np.uint64)
    grid[rows, raw[at + nth]] += (values << widths[rows].astype(np.uint64)).astype(np.uint32)
    grid += heads["low"][:, None]
    return grid.ravel()[: (len(heads) - 1) * BLOCK + int(heads["count"][-1])]


class _Library:
    """Ids of texts by the library.  Short texts cost it far more than their length, so pieces are encoded joined
    and the ids are cut where the bytes of a piece end, which is always between two tokens."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        data = json.loads(definition)
        self.byte_level = (data.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not data.get("normalizer")
        added = {t["id"]: len(t["content"].encode()) for t in data["added_tokens"]}
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: a letter of a byte-level token stands for one.
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = added.get(i, len(token))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        # nearly all are a space and letters, which need no closer look
        together = [k for k, t in enumerate(texts) if (t[:1] == " " and t[1:].isalnum()) or joinable(t)] if self.byte_level else []
        found: list[bytes] = [b""] * len(texts)
        if together:
            parts = [texts[k] for k in together]
            [encoding] = self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            ends = np.cumsum(self.sizes[ids])
            of_piece = np.cumsum(pc.binary_length(pa.array(parts, pa.large_string())).to_numpy())
            cuts = np.searchsorted(ends, of_piece) + 1
            if len(ends) != cuts[-1] or (ends[cuts - 1] != of_piece).any():
                raise ValueError("a token crosses the end of a piece")
            data, at = ids.tobytes(), 0
            for k, c in zip(together, (4 * cuts).tolist(), strict=True):
                found[k], at = data[at:c], c
        alone = sorted(set(range(len(texts))) - set(together)) if len(together) < len(texts) else []
        for k, ids in zip(alone, self._each([texts[k] for k in alone]), strict=True):
            found[k] = ids
        return found


_loaded: dict[int, PieceIds] = {}


def _cache(shared) -> PieceIds:
    """Set up once for each worker."""
    mark = hash(shared.value)
    if mark not in _loaded:
        _loaded.clear()
        _loaded[mark] = PieceIds(_Library(shared.value), REMEMBERED)
    return _loaded[mark]


def tokenizer(sc: SparkContext, definition: str):
    """A tokenizer for executors, from the text of its file (64 MB at most)."""
    if len(definition) > 64 << 20:
        raise ValueError("a tokenizer file has at most 64 MB")
    return sc.broadcast(definition)


def _page(shard: int, number: int, first: int, keys: list[pa.Array], lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    payload, starts = pack_blocks(ids)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.concat_arrays(keys), pa.array(lengths, pa.int64()), pa.array(starts, pa.int32()))]
    row = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), *lists[:2], pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary()), lists[2]]
    return pa.RecordBatch.from_arrays(row, names=["shard", "page", "first", "doc_ids", "lengths", "n_ids", "payload", "block_starts"])


def _closed(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of documents, each with its end id."""
    return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1


def write_tokens(documents: DataFrame, shared, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode documents and write their ids to ``folder`` in key order.

    Every row is a document; null keys come first, equal keys are ordered by their texts, null
    and empty texts are the end id alone.  Texts are shuffled once, to their shard; other
    columns play no part.  Cache and shard sizes change nothing in the ids.
    """
    spark = importable(documents.sparkSession)
    named = documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = ["key", F.xxhash64("text"), "text"]
    size = named.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    dealt = named.repartitionByRange(max(partitions(spark), -(-size // SHARD)), *order[:2]).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, number, first, shard = _cache(shared), 0, 0, 0
        keys, lengths, ids, size = [], [], [], 0  # of the page that is open
        for batch in batches:
            for part in steps(batch, 1, 2 * STEP):
                shard = part.column(2)[0].as_py()
                new, counts = _closed(*encoded(plain_strings(part.column(1))), end_id)
                ends, done = np.cumsum(counts), 0  # documents up to ``done`` are in pages
                while done < len(ends):
                    before = int(ends[done - 1]) if done else 0
                    upto = min(len(ends), int(np.searchsorted(ends, before + PAGE - size)) + 1)
                    keys.append(part.column(0).slice(done, upto - done))
                    lengths.append(counts[done:upto])
                    ids.append(new[before:ends[upto - 1]])
                    size, done = size + int(ends[upto - 1]) - before, upto
                    if size >= PAGE:
                        yield _page(shard, number, first, keys, np.concatenate(lengths), np.concatenate(ids))
                        number, first = number + 1, first + size
                        keys, lengths, ids, size = [], [], [], 0
        if keys:
            yield _page(shard, number, first, keys, np.concatenate(lengths), np.concatenate(ids))

    pages = dealt.select("key", "text", "shard").mapInArrow(run, PAGES)
    # packed ids do not compress further
    pages.write.option("compression", "uncompressed").parquet(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with ``start``: the ids of all pages before.  Sums of shards are one row for each shard."""
    pages = importable(spark).read.schema(PAGES).parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = pages.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return pages.join(F.broadcast(sums), "shard").withColumn("start", F.col("first") + F.col("before")).drop("before")


def read_digest(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files."""
    out = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, payload, blocks, start = (batch.column(i)[row].as_py() for i in range(5))
                data = memoryview(unpack_blocks(payload, blocks).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], schema=out)

    pages = read_pages(spark, folder).select("doc_ids", "lengths", "payload", "block_starts", "start")
    return pages.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """key and ``ids`` (array of int) of every document, in no order."""
    out = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, payload, blocks = (batch.column(i)[row].as_py() for i in range(4))
                ids = unpack_blocks(payload, blocks).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], schema=out)

    pages = read_pages(spark, folder).select("doc_ids", "lengths", "payload", "block_starts")
    return pages.mapInArrow(run, f"`{key}` long, ids array<int>")
