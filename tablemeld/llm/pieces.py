"""Texts as short pieces whose tokens do not depend on their neighbours.

A space that is followed by anything but white space always starts a new pre-token under
the split pattern of these vocabularies.  A text cut before every such space is a list of
pieces, most of them one word, that repeat all the time: each distinct piece is encoded
once and its ids are looked up afterwards.  The cache is bounded and only saves time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers in each of two generations; longer ones are encoded anew each time.
REMEMBERED, LONGEST = 300_000, 64

_NO_START = re.compile(r" (?:\s|\Z)")


def cut(text: str) -> list[str]:
    """Pieces of a text; all but the first start with one space that is then left out.

    A space before white space or the end starts no piece and stays with the piece before.
    """
    pieces = text.split(" ")
    if not _NO_START.search(text):
        return pieces
    joined = pieces[:1]
    for p in pieces[1:]:
        if p and not p[0].isspace():
            joined.append(p)
        else:
            joined[-1] += " " + p
    return joined


class PieceCache:
    """Results of ``encode`` (a list of texts to a list of results) for pieces led by a space."""

    def __init__(self, encode: Callable[[list[str]], list], remembered: int = REMEMBERED):
        self.encode, self.remembered, self.known, self.old = encode, remembered, {}, {}

    def results(self, texts: list[str]) -> list[list]:
        """The results of every text's pieces, in order."""
        if len(self.known) > self.remembered:
            self.known, self.old = {}, self.known
        firsts, rests, rows, missing, new = [], [], [], [], {}
        known, old = self.known, self.old
        for text in texts:
            first, *rest = cut(text)
            row = list(map(known.get, rest))
            gaps = [k for k, r in enumerate(row) if r is None]
            for k in gaps:
                p = rest[k]
                if p not in new:
                    if (r := old.get(p)) is None:
                        new[p] = None
                    else:
                        row[k] = known[p] = r
            firsts.append(first)
            rests.append(rest)
            rows.append(row)
            missing.append(gaps)
        made = self.encode([" " + p for p in new] + firsts)
        fresh = dict(zip(new, made, strict=False))
        for rest, row, gaps in zip(rests, rows, missing, strict=True):
            for k in gaps:
                if row[k] is None:
                    row[k] = fresh[rest[k]]
        known.update((p, r) for p, r in fresh.items() if len(p) <= LONGEST)
        return [[first, *row] for first, row in zip(made[len(new):], rows, strict=True)]


def joinable(text: str) -> bool:
    """Whether a text led by a space can stand among others: its pre-tokens are the same there as alone."""
    return text[:1] == " " and len(text) > 1 and not text[1].isspace() and not text[-1].isspace()


#: RE2: a space before white space or the end.  The class holds what ``str.isspace`` holds.
_ARROW_NO_START = r" (?:[\t-\r\x1c-\x20\x{85}\p{Z}]|\z)"


def flat_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pieces of texts (strings, none null) in one array, and where each text's pieces start and end."""
    if pc.any(pc.match_substring_regex(texts, _ARROW_NO_START)).as_py():
        lists = pa.array([cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


class PieceTable:
    """Results of whole texts' pieces; ``encode`` turns a list of texts into one result for each.

    Pieces are counted off in Arrow and only distinct ones are looked up.  The two
    generations of remembered pieces are bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list], remembered: int = REMEMBERED):
        self.encode, self.remembered, self.known, self.old = encode, remembered, {}, {}

    def _results(self, words: list[str]) -> list:
        if len(self.known) > self.remembered:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        found = list(map(known.get, words))
        new = []
        for k in [k for k, r in enumerate(found) if r is None]:
            if (r := old.get(words[k])) is None:
                new.append(k)
            else:
                found[k] = known[words[k]] = r
        for k, r in zip(new, self.encode([" " + words[k] for k in new]), strict=True):
            found[k] = r
            if len(words[k]) <= LONGEST:
                known[words[k]] = r
        return found

    def __call__(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Results, which of them each piece of the texts (strings, none null) has, and where each text's pieces start and end."""
        flat, bounds = flat_pieces(texts)
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = bounds[:-1]
        firsts = [words[c] for c in codes[starts].tolist()]  # led by no space
        codes[starts] = len(words) + np.arange(len(firsts))
        return self._results(words) + self.encode(firsts), codes, bounds


class PieceIds:
    """Token ids of whole texts; ``encode`` turns a list of texts into one bytes of uint32 ids for each.

    The ids of pieces are gathered by position.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self.table = PieceTable(encode, remembered)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, none null) in a row, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        results, codes, bounds = self.table(texts)
        sizes = np.fromiter(map(len, results), np.int64, len(results)) // 4
        ends = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(results), "<u4")
        of_piece = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends])), pa.array(ids))
        return of_piece.take(pa.array(codes)).flatten().to_numpy(zero_copy_only=False), np.add.reduceat(sizes[codes], bounds[:-1])
