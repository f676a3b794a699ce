"""BPE encoding and decoding by a priority queue of merge ranks over a linked list of symbols.

A vocabulary file of the tokenizers library is read as it is: literals of added tokens are cut
out first, a byte-level pre-tokenizer splits the rest, and the symbols of each pre-token form a
doubly linked list.  A queue holds the rank of every neighbouring pair that has a merge; the
pair of the lowest rank (leftmost of equals) becomes one symbol, its two neighbour pairs are
queued anew, and entries whose pair has changed meanwhile are stale and skipped.  Decoding
concatenates vocabulary strings.

Null and empty texts have no ids and null ids decode to an empty text.  Every row is encoded
whole, on its own, whatever its length, key or repetition; other columns stay, and one named
like a result is replaced.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, functions as F

from tablemeld.llm.batches import kept_columns, plain_strings, schema_of, steps, with_inputs
from tablemeld.llm.common import importable
from tablemeld.llm.pieces import LONGEST, REMEMBERED, PieceIds, joinable

#: Bytes of ids that a decoding step works on.
_LARGEST = 64 << 20


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself if it prints, else the next free one from 256."""
    printing = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(printing)]
    letters = {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class MergeVocabulary:
    """Vocabulary, merges, pre-tokenizer and added tokens of a definition in the library's JSON format."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        data = json.loads(definition)
        _check(data)
        model = data["model"]
        self.id_of: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Rank of a pair of symbols, and the symbol that a rank makes.  A pair that is listed again has the later rank.
        self.rank_of = {self.id_of[a] << 32 | self.id_of[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.id_of[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        literals = sorted(self.added, key=len, reverse=True)
        self.literal = re.compile("(" + "|".join(map(re.escape, literals)) + ")") if literals else None
        self.pretokens = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
        self.strings = self._strings()

    def _strings(self) -> pa.Array:
        """The bytes of each id; none for an id that is not in use."""
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        tokens = {i: t for t, i in [*self.id_of.items(), *self.added.items()]}
        known = [tokens.get(i) for i in range(max(tokens, default=-1) + 1)]
        return pa.array([None if t is None else bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in known], pa.binary())

    def merge(self, pretoken: str) -> list[int]:
        """Ids of one pre-token in byte letters."""
        rank_of, made = self.rank_of.get, self.made
        symbols = [self.id_of[c] for c in pretoken]
        n = len(symbols)
        pair_rank = [rank_of(a << 32 | b, -1) for a, b in pairwise(symbols)]
        queue = [rank << 32 | place for place, rank in enumerate(pair_rank) if rank >= 0]
        if not queue:
            return symbols
        pair_rank.append(-1)
        heapify(queue)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            place, rank = entry & 0xFFFFFFFF, entry >> 32
            if pair_rank[place] != rank:
                continue  # stale: the pair was merged away or has another right symbol by now
            gone = following[place]
            after, before = following[gone], previous[place]
            symbols[place] = symbol = made[rank]
            symbols[gone] = pair_rank[gone] = pair_rank[place] = -1
            following[place] = after
            if after < n:
                previous[after] = place
                if (r := rank_of(symbol << 32 | symbols[after], -1)) >= 0:
                    pair_rank[place] = r
                    heappush(queue, r << 32 | place)
            if before >= 0:
                pair_rank[before] = r = rank_of(symbols[before] << 32 | symbol, -1)
                if r >= 0:
                    heappush(queue, r << 32 | before)
        return [s for s in symbols if s >= 0]

    def _merged(self, part: str) -> list[int]:
        return [i for pretoken, _ in self.pretokens(part) for i in self.merge(pretoken)]

    def encode(self, text: str) -> list[int]:
        if self.literal is None or not self.literal.search(text):
            return self._merged(text)
        parts = self.literal.split(text)  # every second one is a literal
        return [i for k, part in enumerate(parts) for i in ([self.added[part]] if k % 2 else self._merged(part))]

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of a list array of ids; ids that are not in use stand for nothing, bytes that are no UTF-8 are replaced."""
        lists = pc.fill_null(ids, pa.scalar([], ids.type))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        known = (flat >= 0) & (flat < len(self.strings))
        strings = self.strings.take(pa.array(np.where(known, flat, 0))) if len(self.strings) else pa.nulls(len(flat), pa.binary())
        strings = pc.if_else(pa.array(known), pc.fill_null(strings, b""), b"")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), strings), b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", errors="replace") for t in joined.to_pylist()], pa.string())


def _check(data: dict) -> None:
    """Definitions that this operator encodes as the library does; others are refused."""
    model, split, decoder = data["model"], data.get("pre_tokenizer") or {}, data.get("decoder") or {}
    plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"}
    refused = [name for name in plain if model.get(name)]
    if model.get("type", "BPE") != "BPE":
        refused.append("model")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        refused.append("pre_tokenizer")
    if decoder.get("type") != "ByteLevel":
        refused.append("decoder")
    if data.get("normalizer"):
        refused.append("normalizer")
    if any(t.get(flag) for t in data["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        refused.append("added_tokens")
    if not all(letter in model["vocab"] for letter in byte_letters()):
        refused.append("vocab without all bytes")
    if refused:
        raise ValueError(f"not a plain byte-level BPE definition: {', '.join(sorted(refused))}")


class _Encoder:
    """A vocabulary with remembered pieces.  Texts with literals of added tokens are encoded whole."""

    def __init__(self, definition: str):
        self.vocabulary = MergeVocabulary(definition)
        self.pieces = PieceIds(self._texts)
        #: Ids of pre-tokens; bounded, and only saves time.
        self.pretokens: dict[str, bytes] = {}

    def _pretoken(self, pretoken: str) -> bytes:
        ids = self.pretokens.get(pretoken)
        if ids is None:
            ids = np.array(self.vocabulary.merge(pretoken), "<u4").tobytes()
            if len(pretoken) <= LONGEST:
                self.pretokens[pretoken] = ids
        return ids

    def _texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without literals; those that may stand among others are split to pre-tokens in one call."""
        if len(self.pretokens) > REMEMBERED:
            self.pretokens = {}
        split, found = self.vocabulary.pretokens, [b""] * len(texts)
        together = []
        for k, text in enumerate(texts):
            if joinable(text):
                together.append(k)
            else:
                found[k] = b"".join([self._pretoken(p) for p, _ in split(text)])
        ends = accumulate(len(texts[k]) for k in together)
        k, end, parts = 0, next(ends, 0), []
        for pretoken, (_, upto) in split("".join([texts[k] for k in together])):
            parts.append(self._pretoken(pretoken))
            if upto == end:
                found[together[k]] = b"".join(parts)
                k, end, parts = k + 1, next(ends, 0), []
        return found

    def lists(self, texts: pa.Array) -> pa.Array:
        literal = self.vocabulary.literal
        held = np.zeros(len(texts), bool) if literal is None else pc.match_substring_regex(texts, literal.pattern).to_numpy(zero_copy_only=False)
        plain, lengths = self.pieces(pc.if_else(pa.array(held), "", texts))
        if held.any():
            rows = np.split(plain, np.cumsum(lengths)[:-1])
            for k in np.flatnonzero(held).tolist():
                rows[k] = np.array(self.vocabulary.encode(texts[k].as_py()), np.uint32)
            plain, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(plain.astype(np.int32)))


_loaded: dict[int, _Encoder] = {}


def _encoder(shared) -> _Encoder:
    """Set up once for each worker."""
    mark = hash(shared.value)
    if mark not in _loaded:
        _loaded.clear()
        _loaded[mark] = _Encoder(shared.value)
    return _loaded[mark]


def vocabulary(sc: SparkContext, definition: str):
    """A vocabulary for executors, from the text of its file (64 MB at most)."""
    if len(definition) > _LARGEST:
        raise ValueError("a vocabulary file has at most 64 MB")
    _check(json.loads(definition))
    return sc.broadcast(definition)


def encode(documents: DataFrame, shared, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Documents with ``ids`` (array of int) in place of ``text``; ``decoded`` names a column for the text that the
    ids decode to, made in the same pass."""
    made = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    kept = kept_columns(documents, [text, *made])
    df = with_inputs(documents, kept, {"text": F.col(f"`{text}`").cast("string")})
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in steps(batch, n):
                found = [encoder.lists(plain_strings(part.column(n)))]
                if decoded:
                    found.append(encoder.vocabulary.decode(found[0]))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *found], names=[*kept, *made])

    importable(df.sparkSession)
    return df.mapInArrow(run, schema_of(df, n, made))


def decode(tokens: DataFrame, shared, ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows with ``text`` in place of ``ids`` (array of int); null ids are none."""
    kept = kept_columns(tokens, [ids, text])
    df = with_inputs(tokens, kept, {"ids": F.filter(F.col(f"`{ids}`"), lambda i: i.isNotNull())})
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(shared).vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], v.decode(part.column(n))], names=[*kept, text])

    importable(df.sparkSession)
    return df.mapInArrow(run, schema_of(df, n, {text: "string"}))
