"""Importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tablemeld.llm import grams, importance, queries
from tests.llm.helpers import DOCS, no_documents, odd_documents, odd_rows, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("abAB 1.\n-éÉ漢\x00"), st.characters(exclude_categories=["Cs"])), max_size=40)


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def features(text, orders=3):
    words = WORDS.findall(lower(text))
    return words, [" ".join(words[i:i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def drawn(rows, target, percent=5, least=20, seed=42, buckets=10_000):
    """Sorted rows (key, words, features, weight, score) and the keys in order of rank."""
    s, t = (Counter(bucket(f, buckets) for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], target))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for key, text, *_ in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f, buckets)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    return sorted(out, key=str), able[:percent * len(able) // 100]


def check(spark, rows, target, **options):
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame([(t,) for t in target], "body string")
    got = importance.resample(docs.withColumnRenamed("n_chars", "Weight").withColumnRenamed("lang", "RANK"), benchmark, target_text="body", **options)
    assert got.columns == ["doc_id", "source", "n_words", "n_features", "weight", "score", "rank"]
    got = got.collect()
    want, order = drawn(rows, target, options.get("percent", 5), options.get("least_words", 20), options.get("seed", 42), options.get("buckets", 10_000))
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=str) == want
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(order) + 1))
    assert [(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in ranked] == order


# --- the table of n-grams -----------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=150), max_size=12), st.sampled_from([0, 42, 2**64 - 1]))
def test_hashes_of_many_strings(values, seed):
    data = np.frombuffer(b"".join(values) + bytes(32), np.uint8)
    length = np.array([len(v) for v in values], np.int64)
    start = np.cumsum(length) - length
    assert grams.xxh64(data, start, length, seed).tolist() == [xxhash.xxh64_intdigest(v, seed) for v in values]
    assert grams.crc32(data, start, length).tolist() == [zlib.crc32(v) for v in values]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 4), st.booleans(), st.integers(0, 2))
def test_table_holds_every_ngram(texts, orders, collide, skip):
    words = grams.words_of(pa.array(["skip me"] * skip + texts, pa.string()).slice(skip))
    assert np.bincount(words.row, minlength=len(texts)).tolist() == [len(features(t)[0]) for t in texts]
    start, length, row = grams.ngrams(words, orders)
    keys = np.zeros(len(start), np.uint64) + np.uint64(7) if collide else None  # one hash for all: bytes tell them apart
    table = grams.GramTable(words.data, start, length, keys)
    raw = words.data.tobytes()
    names = [raw[a:a + n].decode() for a, n in zip(start[table.first].tolist(), length[table.first].tolist(), strict=True)]
    want = [features(t, orders)[1] for t in texts]
    assert dict(zip(names, table.count.tolist(), strict=True)) == Counter(f for w in want for f in w)
    for k, w in enumerate(want):
        assert sorted(names[s] for s in table.slot[row == k]) == sorted(w)
    assert table.buckets(97).tolist() == [bucket(n, 97) for n in names]


def test_very_long_words():
    text = "a" * 100_000 + " b " + "a" * 99_999 + "c " + "a" * 100_000
    words = grams.words_of(pa.array([text]))
    start, length, _ = grams.ngrams(words, 3)
    table = grams.GramTable(words.data, start, length)
    assert len(table.first) == len(set(features(text)[1])) and table.count.sum() == 9


# --- the operator ------------------------------------------------------------------------------


def many_rows():
    r = random.Random(5)
    rows = [(k, prose(k, 15 + k % 60, 400), "en", "a", 0) for k in range(900)]
    copies = [(k, "The same PASSAGE in all of these rows " * 4, "en", "hot", 0) for k in range(2000, 2400)]
    repeated = [(5000, prose(1, 40), "en", "hot", 0)] * 300  # one key and text
    target = [prose(k, 50, 100) for k in range(40)] + [None, "", "Ünï 漢字 \U0001F600"]
    out = rows + copies + repeated + odd_rows() + [(None, prose(k, 30), None, None, None) for k in range(30)]
    r.shuffle(out)
    return out, target


@pytest.mark.parametrize("ranked", [2_000_000, 100])
def test_draws_as_brute_force(spark, monkeypatch, ranked):
    monkeypatch.setattr(importance, "RANKED", ranked)
    check(spark, *many_rows())


@pytest.mark.parametrize("options", [{"percent": 100, "least_words": 0, "seed": 1}, {"percent": 33, "buckets": 7}])
def test_other_parameters(spark, options):
    check(spark, *many_rows(), **options)


def test_nothing_to_draw_from_or_towards(spark):
    check(spark, odd_rows(), [])
    check(spark, odd_rows(), [None, ""])
    assert importance.resample(no_documents(spark), odd_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        importance.resample(odd_documents(spark), odd_documents(spark), buckets=1 << 21)


def test_query_over_its_tables(spark, tmp_path):
    rows, target = many_rows()
    rows = [r for r in rows if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["op11_importance_resampling"](spark, str(tmp_path)).collect()
    want, order = drawn(rows, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == sorted(((w[0], *w[2:]) for w in want), key=str)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [w[0] for w in order]
