"""Fill-in-the-middle and merge-rank BPE against brute force, the public library and exact round trips."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tablemeld.llm import batches, infilling, merges, queries
from tests.llm.helpers import DOCS, no_documents, odd_documents, odd_rows, prose, rows_of

DEFINITION = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
LIBRARY = Tokenizer.from_str(DEFINITION)
OWN = merges._Encoder(DEFINITION)
ODD_CHARACTERS = st.one_of(st.sampled_from(["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "漢", "\U0001F600", "7", "'s", "!", "<|endoftext|>", "<|", "the", "ing"]), st.characters(exclude_categories=["Cs"]))
ODD_TEXT = st.lists(ODD_CHARACTERS, max_size=30).map("".join)


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# --- merge ranks ----------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD_TEXT, min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    got = OWN.lists(pa.array(texts))
    assert got.to_pylist() == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert OWN.vocabulary.decode(got).to_pylist() == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50300), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    got = OWN.vocabulary.decode(pa.array([ids, None, []], pa.list_(pa.int32()))).to_pylist()
    assert got == [LIBRARY.decode(ids, skip_special_tokens=False), "", ""]


def test_long_runs_without_spaces():
    r = random.Random(2)
    for text in ("a" * 30000, "".join(r.choice("abcdefgh") for _ in range(30000)), " " * 999 + "x", "漢字" * 5000, "<|endoftext|>" * 300 + "  <|endoftext|>"):
        assert OWN.lists(pa.array([text]))[0].as_py() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_merge_tables(spark):
    shared = merges.vocabulary(spark.sparkContext, DEFINITION)
    docs = odd_documents(spark).withColumnRenamed("n_chars", "IDS")
    coded = merges.encode(docs, shared)
    assert coded.columns == ["doc_id", "lang", "source", "ids"]
    got = sorted((str(r.doc_id), r.ids) for r in coded.collect())
    assert got == sorted((str(r[0]), LIBRARY.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows())
    back = merges.decode(coded.withColumnRenamed("lang", "Text"), shared)
    assert back.columns == ["doc_id", "source", "text"]
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in odd_rows())
    both = merges.encode(docs, shared, decoded="TEXT")
    assert both.columns == ["doc_id", "lang", "source", "ids", "TEXT"]
    assert sorted((str(r.doc_id), r.TEXT) for r in both.collect()) == sorted((str(r[0]), r[1] or "") for r in odd_rows())
    assert merges.encode(no_documents(spark), shared).count() == 0
    holes = spark.createDataFrame([(1, [464, None, 995]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert rows_of(merges.decode(holes, shared)) == [(1, LIBRARY.decode([464, 995])), (2, ""), (3, "")]


@pytest.mark.parametrize("change", [
    lambda d: d["model"].update(dropout=0.1), lambda d: d.update(normalizer={"type": "NFC"}), lambda d: d["pre_tokenizer"].update(add_prefix_space=True),
    lambda d: d["added_tokens"][0].update(lstrip=True), lambda d: d["model"]["vocab"].pop("Ġ"),
])
def test_other_definitions_are_refused(spark, change):
    import json

    data = json.loads(DEFINITION)
    change(data)
    with pytest.raises(ValueError, match="not a plain byte-level BPE"):
        merges.vocabulary(spark.sparkContext, json.dumps(data))


def test_merge_query_is_the_librarys(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.QUERIES["op13_bpe_merges"](spark, str(tmp_path)))
    want = []
    for key, text, *_ in odd_rows():
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


# --- fill-in-the-middle ---------------------------------------------------------------


def infilled(key, text, units=list, seed=1, marks=infilling.SENTINELS):
    text = text or ""
    cut = units(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(cut) + 1), h[1] % (len(cut) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= 90:
        return len(cut), "plain", None, None, text
    prefix, middle, suffix = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    p, s, m = marks
    if h[3] % 100 < 20:
        return len(cut), "spm", a, b - a, s + suffix + p + prefix + m + middle
    return len(cut), "psm", a, b - a, p + prefix + s + suffix + m + middle


def infill_rows():
    extra = [(1000 + k, "".join(random.Random(k).choice("a <SPM>é漢\U0001F600\n\x00") for _ in range(k % 50)), "en", "a", 0) for k in range(300)]
    return odd_rows() + extra + [(2000, "x <S> y", "en", "a", 0), (2001, "<P", "en", "a", 0), (2002, "S>", "en", "a", 0), (2003, "<<<<", "en", "a", 0)] + [(7, "same row", "en", "a", 0)] * 50


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_steps_cut_by_bytes_and_keep_order(size):
    texts = ["", "a" * 30, None, "é" * 30, "", "b", "c" * 500, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["k", "t"]).slice(1)
    parts = list(batches.steps(batch, 1, size))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(1, 8))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= size for p in parts)
    assert list(batches.steps(batch.slice(0, 0), 1, size)) == []


def test_transform_and_restore(spark):
    rows = infill_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "N").withColumnRenamed("source", "FORM")
    done = infilling.transform(docs)
    assert done.columns == ["doc_id", "lang", "n", "form", "prefix_units", "middle_units", "output"]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in done.collect()), key=str)
    assert got == sorted(((r[0], *infilled(r[0], r[1])) for r in rows), key=str)
    forms = {r[2] for r in got}
    assert forms == {"plain", "psm", "spm"}
    back = infilling.restore(done.withColumnRenamed("lang", "TEXT"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert infilling.transform(no_documents(spark)).count() == 0 and infilling.restore(infilling.transform(no_documents(spark))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD_TEXT, min_size=1, max_size=4), st.integers(0, 3))
def test_units_are_the_text_in_pieces(texts, skip):
    import re

    array = pa.array(["skip me"] * skip + texts).slice(skip)
    assert infilling.unit_lists(array).to_pylist() == [list(t) for t in texts]
    assert infilling.unit_lists(array, "line").to_pylist() == [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
    words = infilling.unit_lists(array, "word").to_pylist()
    assert words == [re.findall(r"^[^ \t-\r]+|[ \t-\r]+[^ \t-\r]*", t) for t in texts]


@pytest.mark.parametrize("unit,units", [("word", lambda t: infilling.unit_lists(pa.array([t]), "word")[0].as_py()), ("line", lambda t: t.splitlines(keepends=True))])
def test_other_units_and_marks(spark, unit, units):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = [(k, "\n".join(prose(10 * k + j, 6) for j in range(5)), "en", "a", 0) for k in range(60)]
    done = infilling.transform(spark.createDataFrame(rows, DOCS), seed=5, sentinels=marks, unit=unit)
    got = sorted((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in done.collect())
    assert [g[0] for g in got] == list(range(60))
    assert got == [(r[0], *infilled(r[0], r[1], units, 5, marks)) for r in rows]
    assert sorted((r.doc_id, r.text) for r in infilling.restore(done, sentinels=marks).collect()) == [(r[0], r[1]) for r in rows]


def test_marks_that_could_be_misread_are_refused(spark):
    for marks in [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<<", "S", "M"), ("<P", "<PS", "<M"), ("aPb", "bSc", "cM")]:
        with pytest.raises(ValueError):
            infilling.transform(no_documents(spark), sentinels=marks)
    with pytest.raises(ValueError):
        infilling.transform(no_documents(spark), unit="page")
    gone = spark.createDataFrame([("psm", "no marks")], "form string, output string")
    with pytest.raises(Exception, match="(?i)index|bounds"):
        infilling.restore(gone).collect()


def test_infill_query_over_its_table(spark, tmp_path):
    rows = [r for r in infill_rows() if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.QUERIES["op12_fill_in_middle"](spark, str(tmp_path)))
    want = []
    for key, text, *_ in rows:
        n, form, p, m, out = infilled(key, text)
        want.append((key, n, form, p, m, sha(out), sha(text or "")))
    assert got == sorted(want, key=str)
