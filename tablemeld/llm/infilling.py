"""Fill-in-the-middle transformation: a text becomes prefix, middle and suffix around sentinels.

Texts of a batch are split into units, one list array; flattened, each unit has the index of its
text and its ordinal there, which against the text's two cuts gives its role; the units of a role
are filtered, rebuilt to lists and joined, and the three pieces are joined with the sentinels.
All of it is Arrow kernels on whole batches; the draws are hashes of the key, so reruns agree.

A text is plain, its own output, if it is empty or null, contains a sentinel, or its draw says so.
Every row is transformed whole, on its own: equal keys have equal draws, a null key draws as an
empty one, very long texts make a batch of their own.  Other columns stay; one named like a result
is replaced.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tablemeld.llm.batches import kept_columns, plain_strings, schema_of, steps, with_inputs
from tablemeld.llm.common import importable

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: Percent of texts that are rearranged, and percent of those whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20

#: One code point, a word with the white space before it, or a line with its end.
UNITS = ("char", "word", "line")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_lists(texts: pa.Array, unit: str = "char") -> pa.ListArray:
    """The units of each text (strings, none null), whose concatenation is the text."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data, ends = data[ends[0]:ends[-1]], ends - ends[0]
    if unit == "char":
        starts_unit = (data & 0xC0) != 0x80
    elif unit == "line":
        starts_unit = np.concatenate([[True], data[:-1] == 10])[: len(data)]
    else:
        space = (data == 32) | (data >= 9) & (data <= 13)
        starts_unit = space & ~np.concatenate([[False], space[:-1]])[: len(data)]
    first = ends[:-1][ends[:-1] < ends[1:]]
    if len(first):
        starts_unit[first] = True
    begins = np.flatnonzero(starts_unit)
    values = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, ends), pa.int32()), values)


def _role(units: pa.Array, parents: pa.Array, rows: int, chosen: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The chosen units of every text joined, and how many there are."""
    counts = np.bincount(pc.filter(parents, chosen).to_numpy(zero_copy_only=False), minlength=rows)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pc.filter(units, chosen))
    return pc.binary_join(lists, ""), pa.array(counts, pa.int64())


def rearranged(texts: pa.Array, h: list[pa.Array], sentinels: tuple[str, str, str], rate: int, suffix_first: int, unit: str) -> dict[str, pa.Array]:
    """Number of units, form, units of prefix and middle, and output of every text."""
    lists = unit_lists(texts, unit)
    n = pc.list_value_length(lists).cast(pa.int64())
    h = [np.asarray(x, np.int64) for x in h]
    size = n.to_numpy(zero_copy_only=False) + 1
    low, high = np.minimum(h[0] % size, h[1] % size), np.maximum(h[0] % size, h[1] % size)
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    row = parents.to_numpy(zero_copy_only=False)
    ordinal = np.arange(len(row)) - lists.offsets.to_numpy(zero_copy_only=False)[row]
    before, within = ordinal < low[row], ordinal < high[row]
    p, s, m = (pa.scalar(x) for x in sentinels)
    prefix, n_prefix = _role(units, parents, len(texts), pa.array(before))
    middle, n_middle = _role(units, parents, len(texts), pa.array(within & ~before))
    suffix, _ = _role(units, parents, len(texts), pa.array(~within))
    plain = pc.equal(texts, "")
    for mark in sentinels:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    plain = pc.or_(plain, pa.array(h[2] % 100 >= rate))
    spm = pa.array(h[3] % 100 < suffix_first)
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_units": pc.if_else(plain, none, n_prefix),
        "middle_units": pc.if_else(plain, none, n_middle),
        "output": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
    }


def _between(values: pa.Array, marks: tuple[str, str, str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The texts after each of three marks, the first of which starts every value."""
    halves = pc.split_pattern(values, marks[2], max_splits=1)
    front = pc.split_pattern(pc.list_element(halves, 0), marks[1], max_splits=1)
    return pc.utf8_replace_slice(pc.list_element(front, 0), 0, len(marks[0]), ""), pc.list_element(front, 1), pc.list_element(halves, 1)


def rebuilt(output: pa.Array, form: pa.Array, sentinels: tuple[str, str, str]) -> pa.Array:
    """The text of every output: no text holds a sentinel, so each is found where it was put."""
    p, s, m = sentinels
    form = np.asarray(form.to_pylist(), object)
    psm, spm = np.flatnonzero(form == "psm"), np.flatnonzero(form == "spm")
    plain = np.flatnonzero((form != "psm") & (form != "spm"))
    prefix, suffix, middle = _between(output.take(pa.array(psm)), (p, s, m))
    suffix2, prefix2, middle2 = _between(output.take(pa.array(spm)), (s, p, m))
    parts = [output.take(pa.array(plain)), pc.binary_join_element_wise(prefix, middle, suffix, ""), pc.binary_join_element_wise(prefix2, middle2, suffix2, "")]
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate([plain, psm, spm]), kind="stable")))


def _check(sentinels: tuple[str, str, str]) -> None:
    """A sentinel can only be found where it was put if its first character is in no other place of any sentinel."""
    if len(sentinels) != 3 or not all(sentinels) or len({*sentinels}) != 3:
        raise ValueError("three different sentinels are needed")
    if any(x[0] in y[1:] or x != y and y.startswith(x) for x in sentinels for y in sentinels):
        raise ValueError("the first character of a sentinel may be in no other place of a sentinel, and none may start another")


def transform(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "char") -> DataFrame:
    """Documents with ``n`` (units of the text), ``form`` (plain, psm or spm), ``prefix_units``, ``middle_units``
    (null if plain) and ``output`` in place of ``text``."""
    _check(sentinels)
    if unit not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    made = {"n": "bigint", "form": "string", "prefix_units": "bigint", "middle_units": "bigint", "output": "string"}
    kept = kept_columns(documents, [text, *made])
    h = draws(F.col(f"`{key}`"), seed)
    df = with_inputs(documents, kept, {"text": F.col(f"`{text}`").cast("string"), **{f"h{k + 1}": x for k, x in enumerate(h)}})
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, n):
                done = rearranged(plain_strings(part.column(n)), part.columns[n + 1:], sentinels, rate, suffix_first, unit)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(done[c] for c in made)], names=[*kept, *made])

    importable(df.sparkSession)
    return df.mapInArrow(run, schema_of(df, n, made))


def restore(transformed: DataFrame, output: str = "output", form: str = "form", text: str = "text", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Rows with ``text``, rebuilt from ``output`` and ``form``, in place of ``output``.

    A null form counts as plain and a null output is an empty text; an output that lacks a sentinel
    of its form is an error.
    """
    _check(sentinels)
    kept = kept_columns(transformed, [output, text])
    df = with_inputs(transformed, kept, {"output": F.col(f"`{output}`"), "form": F.col(f"`{form}`")})
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, n):
                texts = rebuilt(plain_strings(part.column(n)), part.column(n + 1), sentinels)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], texts], names=[*kept, text])

    importable(df.sparkSession)
    return df.mapInArrow(run, schema_of(df, n, {text: "string"}))
