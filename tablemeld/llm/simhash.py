"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of a text's
shingles.  Two fingerprints link if they differ in at most ``radius`` bits.

Candidates: cut into radius + 1 bands, linked fingerprints agree on one band at least; the
other bits are cut into radius + 1 parts again, of which they agree on one too.  So every
link is found in a bucket of one band and one part, (radius + 1)^2 keys for a fingerprint,
and buckets stay small but for real clusters.  Equal fingerprints are merged before.

Comparison: a bucket is stored as 64 vertical bit planes, 64 fingerprints in a machine word.
One query is compared with all of them plane by plane: the differing bits are added to
carry-save counters that say for 64 fingerprints at once which ones have passed the
radius, and a block is abandoned as soon as all have.  Large buckets are cut into blocks
and every pair of blocks is a task of its own, so that no bucket is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tablemeld.llm.common import free_name, importable, materialize
from tablemeld.llm.components import components

SEED = 42
#: Fingerprints of one bucket that a task compares at once; larger buckets are cut.
BLOCK = 16384
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    parts = (text or "").encode().translate(_ASCII_LOWER).split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:  # shingles are slices of the words joined by one space
        joined, ends = b" ".join(parts), np.cumsum([len(p) + 1 for p in parts]).tolist()
        starts = [0, *ends]
        shingles = [joined[a:b - 1] for a, b in zip(starts, ends[words - 1:], strict=False)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, SEED) for s in shingles], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(documents: DataFrame, text: str = "text", words: int = 3, name: str = "fingerprint") -> DataFrame:
    """Documents with ``name`` (the fingerprint's bits as a long) in place of ``text``."""
    kept = [c for c in documents.columns if c not in (text, name)]
    df = documents.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("text to hash"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), f"`{name}` bigint"])
    importable(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in b.column(len(kept))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(found)], names=[*kept, name])

    return df.mapInArrow(run, schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of ceil(n / 64) words: bit b of fingerprint i is bit i of plane b."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, matches) for blocks of queries; matches[q, i]: at most ``radius`` bits differ.

    The counter of differing bits is kept in ``digits`` words for each 64 candidates, low
    digit first; a lane whose count passes the radius stays out, and once no lane of the
    block is left the remaining planes are not read.
    """
    digits, words = (radius + 1).bit_length(), planes.shape[1]
    step = max(1, (1 << 17) // max(1, words))
    lanes = np.full(words, _ONES)
    if n % 64:
        lanes[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    for at in range(0, len(queries), step):
        q = queries[at:at + step]
        near = np.broadcast_to(lanes, (len(q), words)).copy()
        counter = [np.zeros((len(q), words), np.uint64) for _ in range(digits)]
        for b in range(64):
            asked = (np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1)))[:, None]
            carry = asked ^ planes[b]
            for d in range(digits):  # carry-save: add one bit to all counters at once
                counter[d], carry = counter[d] ^ carry, counter[d] & carry
            passed = carry
            over = np.ones_like(near) * _ONES
            for d in range(digits):  # count == radius + 1, bit by bit
                over &= counter[d] if (radius + 1) >> d & 1 else ~counter[d]
            near &= ~(over | passed)
            if b % 4 == 3 and not near.any():
                break
        yield at, np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Links between two sets (or one set with itself) that connect all that is within the radius.

    A link between members that are connected already adds nothing and is left out.
    """
    same = right is left
    planes, parent, out = bit_planes(right), {}, []

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = p = parent.get(p, p)
            x = p
        return x

    for at, hits in within(left, planes, len(right), radius):
        rows, cols = np.nonzero(hits)
        if same:
            rows, cols = rows[cols > rows + at], cols[cols > rows + at]
        for i, j in zip((rows + at).tolist(), cols.tolist(), strict=True):
            a, b = ("l", i), ("l" if same else "r", j)
            x, y = root(a), root(b)
            if x != y:
                parent[x] = y
                out.append((left[i], right[j]))
    return np.array(out, np.uint64).reshape(-1, 2)


def _cuts(start: int, stop: int, parts: int) -> list[tuple[int, int]]:
    at = [start + (stop - start) * k // parts for k in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def _keys(fp: Column, radius: int) -> Column:
    """(radius + 1)^2 keys: one band, and one part of the other bits, turned to stand in a row."""
    keys = []
    for lo, hi in _cuts(0, 64, radius + 1):
        turned = F.when(F.lit(lo == 0), fp).otherwise(F.shiftrightunsigned(fp, lo).bitwiseOR(F.shiftleft(fp, 64 - lo))) if lo else fp
        width = hi - lo
        for a, b in _cuts(width, 64, radius + 1):
            mask = ((1 << width) - 1) | (((1 << b) - 1) & ~((1 << a) - 1))
            mask = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.struct(F.lit(len(keys)).alias("t"), turned.bitwiseAND(F.lit(mask)).alias("k")))
    return F.array(*keys)


def _compared(radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        fps, side = group.fp.to_numpy().view(np.uint64), group.side.to_numpy()
        if group.same.iloc[0]:
            own = np.unique(fps)
            links = spanning_links(own, own, radius)
        else:
            links = spanning_links(np.unique(fps[side == 0]), np.unique(fps[side == 1]), radius)
        return pd.DataFrame(links.view(np.int64), columns=["a", "b"])

    return run


def link_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that connect all pairs within the radius."""
    keyed = materialize(fps.select("fp", F.inline(_keys(F.col("fp"), radius))), "simhash-keys")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = keyed.join(sizes, ["t", "k"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # block i meets every block j >= i: a fingerprint goes to (its block, j) and to (j, its block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = rows.select("t", "k", "fp", "block", other).select(
        "t", "k", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"),
    )
    return cells.groupBy("t", "k", "i", "j").applyInPandas(_compared(radius), "a long, b long").distinct()


def cluster(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """key, ``fp`` (bits as a long), ``component_id`` (the smallest key that links reach), ``root``, ``row_hash``.

    One row for each row of ``documents``, repeated rows included.  Null and empty texts have
    fingerprint zero and link like others.  A null key has its component, but is never its id
    unless all keys of the component are null.  Extra columns play no part.  ``root`` names the
    component by its smallest fingerprint; ``row_hash`` is of key and text.
    """
    named = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("row_hash", F.xxhash64("key", "text"))
    marked = materialize(fingerprints(named, "text", words, "fp"), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("key").alias("least")), "simhash-distinct")
    roots = components(link_fingerprints(distinct, radius))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = materialize(member.join(ids, "root").select("fp", "root", "component_id"), "simhash-components")
    return marked.join(of_fp, "fp").select(F.col("key").alias(key), "fp", "component_id", "root", "row_hash")


#: Similarity search: minimum hashes that serve as bucket keys, those that estimate a
#: similarity, and the bits in which fingerprints of similar texts may differ (of two sets at
#: 0.8 a bit differs with a probability of 0.19 at most, reached by 4 shingles of 5; over 28
#: of 64 do with one of 1 in a million).
BUCKET_KEYS, SIGNATURE, SIMILAR_RADIUS = 8, 256, 28
#: What is estimated this far below the similarity is still compared exactly: nearly five
#: standard errors at 0.8, so that 4 in a million pairs at 0.8 are not.
SLACK = 0.12
_r = np.random.Generator(np.random.Philox(7))
_MULTIPLY = _r.integers(1, 1 << 63, BUCKET_KEYS + SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _r.integers(0, 1 << 63, BUCKET_KEYS + SIGNATURE, dtype=np.uint64)


def shingle_set(joined: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, its words joined by one space."""
    starts = [0, *np.cumsum([len(p) + 1 for p in joined.split()]).tolist()]
    if len(starts) <= words + 1:
        shingles = [joined]
    else:
        shingles = [joined[a:b - 1] for a, b in zip(starts, starts[words:], strict=False)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(s, SEED) for s in shingles], "<u8"))


def _joined(text: str | None) -> bytes:
    return b" ".join((text or "").encode().translate(_ASCII_LOWER).split())


def sketch(text: str | None, words: int) -> tuple[int, int, list[int], bytes]:
    """Content hash, SimHash, bucket keys and signature of a text's set of word shingles."""
    joined = _joined(text)
    content = xxhash.xxh3_64_intdigest(joined)
    hashes = shingle_set(joined, words)
    total, least = np.zeros(64, np.int64), np.full(len(_ADD), _ONES)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at:at + (1 << 12)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        mixed = part[:, None] * _MULTIPLY + _ADD
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
    fp = int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])
    keys = least[:BUCKET_KEYS].view(np.int64).tolist()
    return content - (1 << 64) if content >> 63 else content, fp, keys, (least[BUCKET_KEYS:] & np.uint64(0xFF)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted distinct hashes) have this Jaccard similarity or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _similar_links(ids: np.ndarray, fps: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, same: bool, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links of a bucket: pairs that are similar, as many as connect all such pairs among the candidates.

    A query is compared with all planes at once; signatures are read only for those within
    the radius that are not connected with it yet, and the sets decide.
    """
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    label, out = np.arange(len(ids)), []
    if not len(left) or not len(right):
        return out
    if len(right) < 64:  # less than one word of lanes: most buckets are a pair or a few
        blocks = [(0, np.bitwise_count(fps[left][:, None] ^ fps[right]) <= radius)]
    else:
        blocks = within(fps[left], bit_planes(fps[right]), len(right), radius)
    for at, hits in blocks:
        for q, row in enumerate(hits):
            i = left[at + q]
            near = right[row]
            near = near[label[near] != label[i]]
            if same:
                near = near[near > i]
            if not len(near):
                continue
            # matching bytes over all, less those that match by chance
            share = ((signs[near] == signs[i]).mean(1) - 1 / 256) / (1 - 1 / 256)
            for j in near[share >= similarity - SLACK].tolist():
                if label[j] != label[i] and alike(sets[i], sets[j], similarity):
                    label[label == label[j]] = label[i]
                    out.append((int(ids[i]), int(ids[j])))
    return out


def _similar(radius: int, similarity: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # a text that has several keys in one bucket, or a crossed block, is there once
        group = group.drop_duplicates(["id", "side"])
        signs = np.frombuffer(b"".join(group.sign), np.uint8).reshape(len(group), -1)
        sets = [np.frombuffer(s, "<u8") for s in group.shingles]
        links = _similar_links(group["id"].to_numpy(), group.fp.to_numpy().view(np.uint64), signs, sets, group.side.to_numpy(), bool(group.same.iloc[0]), radius, similarity)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def cluster_similar(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """key, ``component_id`` (smallest key that links reach), ``root`` and ``row_hash``, as ``cluster`` has them.

    Texts link if their sets of word shingles have a Jaccard similarity of ``similarity`` or
    more; the sets themselves are compared.  A radius that finds such texts by their SimHash is
    too wide for bands of its bits; so candidates share one of eight further minimum hashes
    (two texts at 0.8 miss all of them with a probability of 3 in a million), and within
    these buckets the bit-sliced comparison leaves those within ``SIMILAR_RADIUS`` bits, and
    an estimate from 256 minimum hashes those within ``SLACK`` of the similarity.
    Texts of the same words are one text; null and empty texts link with each other.
    """
    named = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("row_hash", F.xxhash64("key", "text"))
    importable(documents.sparkSession)
    schema = f"key {named.schema['key'].dataType.simpleString()}, row_hash long, id long, fp long, keys array<bigint>, sign binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(t.as_py(), words) for t in b.column(1)]
            ids, fps, keys, signs = zip(*found, strict=True) if found else ((), (), (), ())
            arrays = [pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *arrays], names=["key", "row_hash", "id", "fp", "keys", "sign"])

    marked = materialize(named.select("key", "text", "row_hash").mapInArrow(run, schema), "similar-sketches")
    texts = materialize(marked.groupBy("id").agg(F.min("key").alias("least"), F.min("row_hash").alias("row_hash"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"), F.any_value("sign").alias("sign")), "similar-texts")
    keyed = texts.select("id", F.posexplode("keys").alias("t", "k"))
    # close copies share most of their keys: of buckets with the same members one is compared
    members = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), *members).filter("n > 1")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min(F.struct("t", "k")).alias("first")).select("first.t", "first.k", "n")
    rows = keyed.join(materialize(sizes, "similar-sizes"), ["t", "k"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = rows.select("t", "k", "id", "block", other).select(
        "t", "k", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"),
    )
    cells = materialize(cells, "similar-cells")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(_joined(t.as_py()), words).tobytes() for t in b.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), sets], names=["id", "fp", "sign", "places", "shingles"])

    # one row of each text that has candidates takes along where it is compared: its words meet these places in
    # one shuffle, and its set, as large as the text itself, goes straight to them
    place = "t: int, k: bigint, i: int, j: int, side: int, same: boolean"
    places = cells.groupBy("id").agg(F.collect_list(F.struct("t", "k", "i", "j", "side", "same").cast(f"struct<{place}>")).alias("places"))
    wanted = texts.select("id", "fp", "sign", "row_hash").join(places, "id")
    bodies = named.select("text", "row_hash").join(wanted, "row_hash").dropDuplicates(["row_hash", "id"]).select("id", "fp", "sign", "places", "text")
    sets = bodies.mapInArrow(hashed, f"id long, fp long, sign binary, places array<struct<{place}>>, shingles binary")
    compared = sets.select("id", "fp", "sign", "shingles", F.inline("places")).groupBy("t", "k", "i", "j")
    links = compared.applyInPandas(_similar(SIMILAR_RADIUS, similarity), "a long, b long")
    roots = components(links)
    member = texts.select("id", "least").join(roots, texts["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of_text = materialize(member.join(ids, "root").select("id", "root", "component_id"), "similar-components")
    return marked.select("key", "row_hash", "id").join(of_text, "id").select(F.col("key").alias(key), "component_id", "root", "row_hash")


def keep_one(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest key (null last), ties by content.

    ``found`` is what ``cluster`` or ``cluster_similar`` say of the documents.
    """
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "row_hash")
    chosen = found.groupBy("root").agg(F.min_by("row_hash", place).alias("row_hash"))
    hashed = free_name(documents, "row_hash")
    chosen = materialize(chosen.select(F.col("row_hash").alias(hashed)), "simhash-kept")
    rows = documents.withColumn(hashed, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")))
    return rows.join(chosen, hashed, "left_semi").dropDuplicates([hashed]).drop(hashed)
