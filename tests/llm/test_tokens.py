"""BPE and token files against the public libraries, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pathlib import Path

from tablemeld.llm import bpe, pieces, tokens
from tests.llm.helpers import no_documents, odd_documents, odd_rows

RANKS = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
OWN = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())},
)
SPACES = " \n\t\r\x0b\x85\xa0\u3000"


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 50, 5000):
        keys = [b"k%d" % i for i in range(n)]
        assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))
    assert bpe.PerfectHash([]).slots([b"x"]).tolist() == [0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sdt1é漢!? " + SPACES), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoding_matches_the_library(text):
    ids = [i for p in pieces.PieceCache(OWN.encode).results([text])[0] for i in p]
    assert ids == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


def test_long_pretokens():
    r = random.Random(1)
    for text in ("a" * 20000, "".join(r.choice("abcdefgh") for _ in range(20000)), " " * 999 + "x"):
        assert OWN.encode([text])[0] == THEIRS.encode_ordinary(text)


def test_piece_cache_forgets_and_agrees():
    cache = pieces.PieceCache(OWN.encode, remembered=5)
    texts = [f"alpha beta w{k} w{k % 3}  \n x " for k in range(40)]
    for _ in range(2):
        for t in texts:
            assert [i for p in cache.results([t])[0] for i in p] == THEIRS.encode_ordinary(t)


def test_encode_and_decode_tables(spark):
    shared = bpe.vocabulary(spark.sparkContext, RANKS, public_tokenizers.PATTERN)
    docs = odd_documents(spark).withColumnRenamed("n_chars", "N_TOKENS")
    coded = bpe.encode(docs, shared)
    assert coded.columns == ["doc_id", "lang", "source", "N_TOKENS", "ids"]
    back = bpe.decode(coded, shared)
    assert sorted((r.doc_id or -1, bytes(r.data).decode()) for r in back.collect()) == sorted((r[0] or -1, r[1] or "") for r in odd_rows())
    digest = bpe.encode_digest(docs, shared)
    assert digest.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and digest.count() == len(odd_rows())
    assert bpe.encode(no_documents(spark), shared).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.integers(0, 100))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    payload, starts = tokens.pack_blocks(ids, percentile)
    assert (tokens.unpack_blocks(payload, starts) == ids).all()
    for k, s in enumerate(starts):
        assert (tokens.unpack_blocks(payload, [s]) == ids[256 * k:256 * (k + 1)]).all()


def expected_files(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("page", [1 << 18, 50])
def test_files_hold_all_ids_in_order(spark, tmp_path, monkeypatch, page):
    monkeypatch.setattr(tokens, "PAGE", page)
    shared = tokens.tokenizer(spark.sparkContext, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    docs = odd_documents(spark).filter("doc_id is not null").withColumnRenamed("source", "shard")
    tokens.write_tokens(docs, shared, str(tmp_path / "ids"))
    got = sorted(tuple(r) for r in tokens.read_digest(spark, str(tmp_path / "ids")).collect())
    assert got == expected_files(sorted((r[0], r[1]) for r in odd_rows() if r[0] is not None))
    assert {r.doc_id: len(r.ids) for r in tokens.read_ids(spark, str(tmp_path / "ids")).collect()} == {r[0]: r[2] for r in got}


def test_literal_special_tokens_as_the_library_has_them(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    shared = tokens.tokenizer(spark.sparkContext, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n z", "a < |endoftext|> b", "many words <|endoftext|>" * 50]
    tokens.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shared, str(tmp_path / "ids"))
    got = {r.doc_id: list(r.ids) for r in tokens.read_ids(spark, str(tmp_path / "ids")).collect()}
    assert got == {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def test_files_of_null_keys_and_nothing(spark, tmp_path):
    shared = tokens.tokenizer(spark.sparkContext, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    tokens.write_tokens(odd_documents(spark), shared, str(tmp_path / "all"))
    got = tokens.read_digest(spark, str(tmp_path / "all")).orderBy("start").collect()
    assert [r.doc_id for r in got[:2]] == [None, None] and len(got) == len(odd_rows())
    tokens.write_tokens(no_documents(spark), shared, str(tmp_path / "none"))
    assert tokens.read_digest(spark, str(tmp_path / "none")).count() == 0


def test_digest_looks_up_distinct_pieces_only():
    """The pieces of a step are counted off before any is looked up, and those of one pre-token are not split again."""
    asked = []
    table = pieces.PieceTable(lambda texts: asked.extend(texts) or [bpe._piece_text(OWN, i) for i in OWN.encode(texts)])
    texts = ["", " lead", "one two one two's\tx", "one two " * 40, "Äé two \n two"]
    counts, ids, decoded = (c.to_pylist() for c in bpe._digest_columns((None, table), pa.array(texts)))
    assert len(asked) == len({p for t in texts for p in pieces.cut(t)}) + len(texts)
    for t, n, i, d in zip(texts, counts, ids, decoded, strict=True):
        theirs = THEIRS.encode_ordinary(t)
        assert n == len(theirs) and d == hashlib.sha256(t.encode()).hexdigest()
        assert i == hashlib.sha256(",".join(map(str, theirs)).encode()).hexdigest()


def test_short_and_long_pretokens_merge_alike():
    for n in (4094, 4095, 4096, 4097):
        text = " " + "abcab" * n
        assert OWN.encode([text[:n + 1]])[0] == THEIRS.encode_ordinary(text[:n + 1])
