"""Mixing, near-duplicates, search and substring copies against brute force; the pipeline."""

from __future__ import annotations

import importlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tablemeld.llm import components, mixing, search, simhash, substrings
from tests.llm.helpers import DOCS, no_documents, odd_documents, odd_rows, prose, rows_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


# --- mixing ---------------------------------------------------------------------------


def test_shares_stop_at_the_limit():
    assert mixing.share_targets([10, 10, 10], [1, 2, 3], 30, 3) == [5, 10, 15]
    got = mixing.share_targets([1, 100, 0, 100], [3, 1, 2, 1], 201, 3)
    assert got == [3, 99, 0, 99]
    assert mixing.share_targets([], [], 0, 3) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 1000)), max_size=40), st.integers(0, 5), st.booleans())
def test_pivot_keeps_the_words_taken(rows, seed, last):
    p, a = np.array([x for x, _ in rows]), np.array([x for _, x in rows], float)
    out, held = mixing.pivot(p, a, np.random.default_rng(seed).random(len(rows) + 1), last)
    closed = np.delete(out, held) if held >= 0 else out
    assert set(closed.tolist()) <= {0.0, 1.0} and (held < 0 or not last)
    assert abs((out * a).sum() - (p * a).sum()) <= (max(a, default=0) if last else 1e-6)


def test_pivot_keeps_expectations():
    p, a, total = np.full(9, 0.3), np.arange(1.0, 10), np.zeros(9)
    for seed in range(4000):
        total += mixing.pivot(p, a, np.random.default_rng(seed).random(10), True)[0]
    assert np.abs(total / 4000 - 0.3).max() < 0.04


@pytest.mark.parametrize("bucket,fan", [(4096, 1024), (7, 3)])
def test_mix_meets_targets_and_repeats(spark, monkeypatch, bucket, fan):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    rows = [(k, prose(k, 1 + k % 40), "en", ["b", "a", None, "B"][k % 4], 0) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).toPandas().sort_values("doc_id")
    sizes = {k: sum(len(words_of(r[1])) for r in rows if r[3] == k) for k in ("B", "a", "b", None)}
    total = sum(sizes.values())
    targets = dict(zip(sizes, mixing.share_targets(list(sizes.values()), [1, 2, 3, 1], total, 3), strict=True))
    got["source"] = [r[3] for r in rows]
    for source, size in sizes.items():
        own = got[got.source.isna()] if source is None else got[got.source == source]
        assert (own.source_size == size).all() and np.allclose(own.target, targets[source])
        assert abs((own["size"] * own.copies).sum() - targets[source]) <= 40
        assert own.copies.between(np.floor(targets[source] / size), np.ceil(targets[source] / size)).all()
    again = mixing.mix(docs.repartition(5)).toPandas().sort_values("doc_id")
    assert (again.copies.to_numpy() == got.copies.to_numpy()).all()
    taken = mixing.take(docs.withColumn("row_hash", F.lit("x")))
    assert taken.columns == [*docs.columns, "row_hash"]
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert counts == {k: c for k, c in zip(got.doc_id, got.copies, strict=True) if c}


def test_mix_on_odd_tables(spark):
    mixed = mixing.mix(odd_documents(spark))
    assert mixed.count() == len(odd_rows()) and mixed.filter("size = 0 and copies > 0").count() == 0
    assert mixing.take(odd_documents(spark)).count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(no_documents(spark)).count() == 0 and mixing.take(no_documents(spark)).count() == 0


# --- near-duplicates --------------------------------------------------------------------


def python_fingerprint(text, n=3):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, links):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_planes_count_differing_bits(radius):
    r = np.random.default_rng(radius)
    for n in (1, 63, 64, 130):
        base = r.integers(0, 2**64, 5, dtype=np.uint64)
        fps = base[r.integers(0, 5, n)]
        for _ in range(4):
            fps = fps ^ (r.integers(0, 2, n).astype(np.uint64) << r.integers(0, 64, n).astype(np.uint64))
        near = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps])
        for at, got in simhash.within(fps, simhash.bit_planes(fps), n, radius):
            assert (got == near[at:at + len(got)]).all()


@pytest.mark.parametrize("radius,block", [(2, 16384), (2, 3), (1, 2), (3, 5)])
def test_links_connect_what_is_near(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(radius * 31 + block)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(9):
            x ^= 1 << r.randrange(64)
            x ^= r.choice([0, 1 << r.randrange(64)])
            fps.add(x)
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = simhash.link_fingerprints(df, radius).collect()
    keys = [signed(x) for x in fps]
    near = [(a, b) for a in keys for b in keys if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    assert all(((x.a ^ x.b) & (2**64 - 1)).bit_count() <= radius for x in got)
    assert classes(keys, [(x.a, x.b) for x in got]) == classes(keys, near)


def test_components(spark):
    r = random.Random(5)
    links = [(k, k + 1) for k in range(100, 140)] + [(-7, k) for k in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(1, 1)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    keys = {k for a, b in links if a != b for k in (a, b)}
    assert got == classes(keys, links[:-1])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rows = []
    for g in range(6):
        text = prose(g, 400, 4000)
        for k in range(5):
            words = text.split(" ")
            if k:
                words[k * 7] = f"edit{k}"
            rows.append((g * 10 + k, " ".join(words).upper() if k == 2 else " ".join(words), "en", "a", 0))
    return rows


def test_cluster_matches_brute_force(spark):
    rows = near_rows() + odd_rows()
    got = simhash.cluster(spark.createDataFrame(rows, DOCS))
    prints = {(r[0], r[1]): python_fingerprint(r[1]) for r in rows}
    marked = got.collect()
    assert len(marked) == len(rows)
    fps = sorted(set(prints.values()))
    root = classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least: dict = {}
    for (key, _), fp in prints.items():
        if key is not None:
            least[root[fp]] = min(key, least.get(root[fp], key))
    assert sorted(str((r.doc_id, r.fp & (2**64 - 1), r.component_id)) for r in marked) == sorted(
        str((r[0], prints[r[0], r[1]], least.get(root[prints[r[0], r[1]]]))) for r in rows
    )


def test_one_of_each_group_stays(spark):
    rows = near_rows() + odd_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("row_hash", F.lit(0))
    found = simhash.cluster(docs)
    kept = simhash.keep_one(docs, found)
    assert kept.columns == docs.columns
    assert kept.count() == found.select("root").distinct().count()
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found.collect()}
    for finder in (simhash.cluster, simhash.cluster_similar):
        assert simhash.keep_one(no_documents(spark), finder(no_documents(spark))).count() == 0


@pytest.mark.parametrize("block", [16384, 3])
def test_similar_texts_link(spark, monkeypatch, block):
    """Clear cases on both sides of the similarity; estimates decide near it."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows, group = [], {}
    for g in range(12):
        base = prose(g, 300, 4000).split(" ")
        for k in range(4):
            words = list(base)
            for e in range(k):
                words[(e * 31 + k) % 300] = f"edit{k}x{e}"
            rows.append((g * 100 + k, " ".join(words)))
            group[g * 100 + k] = g * 100
        half = base[:150] + prose(500 + g, 150, 4000).split(" ")
        rows.append((g * 100 + 50, " ".join(half)))
        group[g * 100 + 50] = g * 100 + 50
    rows += [(5000, "a b"), (5001, "A  B"), (5002, "a c"), (5003, None), (5004, ""), (None, rows[0][1])]
    group |= {5000: 5000, 5001: 5000, 5002: 5002, 5003: 5003, 5004: 5003, None: 0}
    got = simhash.cluster_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == group


def python_jaccard(a, b, n=5):
    def grams(text):
        words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}

    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("block", [16384, 5])
def test_similarity_decides_exactly(spark, monkeypatch, block):
    """Pairs and a template group on both sides of 0.8, against brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(300)]
        rows.append((g * 10, " ".join(words)))
        # a changed end of e words leaves 296 - e shingles of 296 + e
        e = 296 // 9 + (g % 12) - 4
        rows.append((g * 10 + 1, " ".join(words[:300 - e] + [f"g{g}x{k}" for k in range(e)])))
    for g in range(20):
        rows.append((1000 + g, " ".join([f"t{k}" for k in range(260)] + [f"t{g}x{k}" for k in range(35)])))
    near = [(a, b) for a, s in rows for b, t in rows if a < b and python_jaccard(s, t) >= 0.8]
    below = [(a, b) for a, s in rows for b, t in rows if a < b and 0.72 <= python_jaccard(s, t) < 0.8]
    assert len(near) >= 20 and len(below) >= 200
    got = simhash.cluster_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == classes([k for k, _ in rows], near)


def test_sets_of_shingles_are_not_written(spark, monkeypatch):
    """The sets, as large as the texts, go to the comparison in one shuffle and into no table."""
    written, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: written.extend(df.columns) or write(df, label))
    rows = [(k, " ".join(f"w{k % 4}x{j}" for j in range(40)) + " end" * (k > 5)) for k in range(8)]
    got = simhash.cluster_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 4 for k in range(8)}
    assert "id" in written and "shingles" not in written


def test_repeated_lines_do_not_part_similar_texts(spark):
    rows = []
    for g in range(30):
        words = [f"g{g}w{k}" for k in range(200 if g % 2 else 600)]
        line = " ".join(words[20:30] if g % 2 else words[20:40])
        lines = [" ".join(words[k:k + 10]) for k in range(0, len(words), 10)]
        rows.append((g * 10, "\n".join(lines)))
        rows.append((g * 10 + 1, "\n".join(lines[:4] + [line] * (18 if g % 2 else 25) + lines[4:])))
    near = [(a, b) for a, s in rows for b, t in rows if a < b and python_jaccard(s, t) >= 0.8]
    assert len(near) == 30
    got = simhash.cluster_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == classes([k for k, _ in rows], near)


# --- search -------------------------------------------------------------------------------


def python_top(rows, k):
    ok = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in ok:
        if q % 5 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("shard,block,start", [(8192, 8192, 256), (16, 4, 3), (50, 2, 1)])
def test_top_k_matches_brute_force(spark, monkeypatch, shard, block, start):
    for name, value in (("SHARD", shard), ("QUERY_BLOCK", block), ("START", start)):
        monkeypatch.setattr(search, name, value)
    r = random.Random(shard)
    rows = [(i, [r.choice([0.0, 1.0, -0.5, r.gauss(0, 1)]) * w for w in (4, 2, 1, 0.5, 0.1, 0.1)]) for i in range(120)]
    rows += [(i + 500, rows[i][1]) for i in range(0, 120, 7)] + rows[:3]
    rows += [(None, [1.0] * 6), (1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1005, [float("nan")] * 6), (1010, [float("inf")] * 6), (1015, [2.0]), (1020, [])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    as_float = [(i, v and [None if x is None else np.float32(x) for x in v]) for i, v in rows]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(vectors, F.col("vec_id") % 5 == 0).collect())
    assert got == python_top(as_float, 5)


def test_search_of_little(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows_of(search.top_k(vectors, F.col("vec_id") >= 0)) == [(0, 1, 1, 256 * 512), (1, 1, 0, 256 * 512)]
    assert search.top_k(vectors.limit(0), F.col("vec_id") >= 0).count() == 0
    assert search.top_k(vectors, F.lit(None).cast("boolean")).count() == 0


# --- substring copies -----------------------------------------------------------------------


def python_copies(rows, window):
    """Rows are distinct documents; a null key is the smallest; equal keys are not used here."""
    first, out = {}, {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = words_of(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i:i + window]), (key, i)) != (key, i):
                gone.update(range(i, i + window))
        out[key] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


def copied_rows(seed, n=60):
    r = random.Random(seed)
    shared = [prose(1000 + k, r.randint(15, 60), 500) for k in range(8)]
    rows = []
    for i in range(n):
        parts = [prose(seed * 100 + i, r.randint(0, 40), r.choice([2, 5000])) for _ in range(3)]
        for _ in range(r.randint(0, 3)):
            words = r.choice(shared).split(" ")
            if r.random() < 0.5:
                words[r.randrange(len(words))] = f"edit{i}"
            parts.insert(r.randrange(len(parts) + 1), " ".join(words[r.randrange(4):]))
        rows.append((i, "\n".join(parts)))
    return rows + [(n + 1, rows[3][1]), (n + 2, rows[3][1] + " " + rows[5][1]), (n + 3, "a " * 300), (n + 4, None), (n + 5, ""), (None, rows[7][1])]


@pytest.mark.parametrize("seed,window,crowded,slice_rows", [(1, 20, 32, 4096), (2, 20, 1, 7), (3, 20, 2, 1), (4, 6, 1, 5), (5, 3, 3, 16)])
def test_copies_match_brute_force(spark, monkeypatch, seed, window, crowded, slice_rows):
    rows = copied_rows(seed)
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "SLICE_ROWS", slice_rows)
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = substrings.remove_copies(docs, window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == python_copies(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_copies_of_repeated_rows_and_keys(spark):
    text, other = prose(1, 50, 5000), prose(2, 50, 5000)
    docs = spark.createDataFrame([(1, text), (1, text), (2, other), (2, other + " end"), (3, text)], "doc_id long, text string")
    got = rows_of(substrings.remove_copies(docs).select("doc_id", "n_words", "n_removed"))
    assert got[:2] == [(1, 50, 0)] * 2 and got[4] == (3, 50, 50)
    assert sorted(r[2] for r in got[2:4]) == [0, 50]
    assert substrings.remove_copies(docs.limit(0)).count() == 0


def test_long_texts(spark):
    long = prose(9, 30000, 100000)
    docs = spark.createDataFrame([(1, long), (2, "start " + long)], "doc_id long, text string")
    assert rows_of(substrings.remove_copies(docs).select("n_words", "n_removed")) == [(30000, 0), (30001, 30000)]


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    clean = [(1000 + k, prose(k, 90, 5000), "en", "ab"[k % 2], 0) for k in range(40)]
    rows = clean + near_rows() + odd_rows() + [(2000, prose(77, 90, 5000) + " password=hunter2hunter2", "en", "a", 0)]
    folder = str(tmp_path / "tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = str(tmp_path / f"stage{number}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if number < 4:
            assert docs.columns == before.columns, name
        stage(spark, before.limit(0), folder).count()
        if number in (0, 1):
            assert {1000 + k for k in range(40)} <= {r.doc_id for r in docs.select("doc_id").collect()}
        if number == 2:
            assert docs.filter("doc_id = 2000").first().text.endswith(" [secret]") and docs.count() == before.count()
    mixed = corpus_pipeline.run(spark, folder)
    assert mixed.count() == docs.count() and rows_of(mixed) == rows_of(docs)


def test_registry():
    entry = importlib.import_module("__spark_entry__")
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()
