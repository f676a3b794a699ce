"""Exact nearest vectors by a tree of cells that is built level by level.

A cell with too many rows is split: some of its vectors, one for each range of a hash, become
centres and every row goes to the nearest.  A split cell keeps the least and the greatest distance
of its rows to its centre.  A query first descends to its home cell, whose rows give a bound for its
k-th distance; then it visits only cells that can hold a row within that bound, by the triangle
inequality (the distances to the centre) and by the cells' borders (the nearest centre).

Distances that only decide the work come from a matrix product of vectors less a centre, with an
error bound from the norms that are left; whatever the bound cannot exclude is computed exactly.
Every step is a join of cells: no vector and no list of cells passes through the driver, memory
rows are copied for parts of the queries of their own cell only, and cells that cannot be split
(one vector many times) are compared in blocks.

Where distances are much alike (dense vectors of many dimensions) a query meets most cells, and a copy
of it for each would be written.  Such queries, or all if some probes say so before a tree is built, pass
by all rows in packed blocks instead: a task holds some blocks of queries with their nearest rows so far
and reads the blocks of rows one after the other.  That work is quadratic, what is written is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld.operators.joins import lookup_join, weighted_lookup
from tablemeld.session import importable
from tablemeld.storage import discard, materialize

#: Rows of a cell that is not split, and centres of a cell that is.
LEAF_ROWS, FAN = 2_500, 256
#: Levels of the tree (cell numbers are 64 bits wide); larger cells below are compared in blocks.
DEPTH = 7
#: Rows of one side that a task compares at most and bytes of their vectors, bytes of the vectors that it
#: returns when every query goes to all cells, and distances computed at once.
BLOCK_ROWS, BLOCK_BYTES, ROUTED_BYTES, CELLS = 20_000, 32 << 20, 64 << 20, 1_000_000
#: Cells that a query is sent to at most; beyond, it passes by all rows.  Share of the rows in cells that probes
#: meet, from which no tree is built, and their number.
ROUTES, WIDE, PROBES = 16, 0.25, 64
#: Bytes of the vectors of a packed block (as floats of 32 bits), rows of a block of queries at least, blocks of a
#: file and of queries for each core, rows compared at once, and pairs of a query from which 32 bits are too coarse.
PACKED_BYTES, LEAST_BLOCK, FILE_BLOCKS, CORE_BLOCKS, PIECE_ROWS, COARSE = 2 << 20, 256, 8, 4, 2_048, 32
#: Relative slack of bounds on distances: a cell too many costs time only.
SLACK = 1e-9


# --- distances ------------------------------------------------------------------


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def bracketed(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances from a product, and how far they may be off."""
    centre = vectors.mean(0)
    q, m = queries - centre, vectors - centre
    qq, mm = (q**2).sum(1)[:, None], (m**2).sum(1)[None, :]
    off = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (qq + mm)
    return qq + mm - 2 * q @ m.T, off


def best(queries: np.ndarray, vectors: np.ndarray, k: int, most: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of rows that may be among a query's k nearest and within ``most``; distances exact.

    All rows tied with the k-th are returned, so that ids can decide.
    """
    rough, off = bracketed(queries, vectors)
    limit = np.broadcast_to(np.asarray(most, float), (len(queries),)) * (1 + SLACK)
    if rough.shape[1] > k:
        limit = np.minimum(limit, np.partition(rough + off, k - 1, axis=1)[:, k - 1])
    q, m = np.nonzero(rough - off <= limit[:, None])
    # of many copies of one vector all pairs are near: a slice of them at once
    exact, step = np.empty(len(q)), max(1, CELLS // max(1, queries.shape[1]))
    for at in range(0, len(q), step):
        exact[at:at + step] = ((queries[q[at:at + step]] - vectors[m[at:at + step]]) ** 2).sum(1)
    return q, m, exact


def within(queries: np.ndarray, vectors: np.ndarray, k: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best`` where ``most`` is near already: a product of 32 bits leaves out what its error bound can exclude."""
    centre, width = vectors.mean(0), queries.shape[1]
    q, m = queries - centre, vectors - centre
    qq, mm = (q**2).sum(1), (m**2).sum(1)
    scale = np.sqrt(max(qq.max(), mm.max())) or 1.0
    off = 8 * (width + 8) * float(np.finfo(np.float32).eps) * (qq + mm.max()) + 1e-30 * scale**2
    with np.errstate(over="ignore"):
        left = np.column_stack([-2 * q / scale, (qq - most * (1 + SLACK) - off) / scale**2, np.ones(len(q))]).astype(np.float32)
    right = np.column_stack([m / scale, np.ones(len(m)), mm / scale**2]).astype(np.float32)
    hit = np.flatnonzero(left @ right.T <= 0)
    if len(hit) > COARSE * len(queries):
        return best(queries, vectors, k, most)
    q, m = np.divmod(hit, len(vectors))
    exact, step = np.empty(len(q)), max(1, CELLS // max(1, width))
    for at in range(0, len(q), step):
        exact[at:at + step] = ((queries[q[at:at + step]] - vectors[m[at:at + step]]) ** 2).sum(1)
    near = exact <= most[q] * (1 + SLACK)
    return q[near], m[near], exact[near]


def first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["q", "d", "m"]).groupby("q").head(k)


# --- the tree -------------------------------------------------------------------


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _blocks(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("int")


def _numbers(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), count - 1))


def _block_rows(width: int) -> int:
    """Rows of a block of vectors of ``width`` components."""
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows dealt over all partitions of a shuffle: groups are few bytes and much work, which must not be coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _split(rows: DataFrame, id_type: str, width: int) -> DataFrame:
    """(m, v, cell, d): rows of cells (m, v, cell, n) in the child cells of their nearest centres."""
    fan = F.least(F.lit(FAN), F.ceil(2 * F.col("n") / LEAF_ROWS) + 1).cast("long")
    child = (F.col("cell") * FAN + F.pmod(F.xxhash64("v"), fan) + 1).alias("child")
    # one of the vectors of each range of the hash: no two centres are the same
    centres = rows.groupBy("cell", child).agg(F.min_by("v", F.xxhash64("v", F.lit(1))).alias("v"), F.max("n").alias("n"))
    blocks = _blocks(F.col("n"), _block_rows(width))
    left = rows.select("m", "v", "cell", F.pmod(F.xxhash64("m", "v"), blocks).cast("int").alias("block"))
    right = centres.select("cell", "child", "v", _numbers(blocks).alias("block"))

    def assign(part: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        out, vectors = [], stacked(centres["v"]) if len(centres) else None
        cells = centres["child"].to_numpy()
        for at in range(0, len(part), step := max(1, CELLS // max(1, len(centres)))):
            some = part.iloc[at:at + step]
            q, c, d = best(stacked(some["v"]), vectors, 1)
            nearest = first(pd.DataFrame({"q": q, "d": d, "m": cells[c]}), 1).sort_values("q")
            out.append(pd.DataFrame({"m": some["m"].to_numpy(), "v": some["v"].to_numpy(), "cell": nearest["m"].to_numpy(), "d": np.sqrt(nearest["d"].to_numpy())}))
        return pd.concat(out) if out else pd.DataFrame(columns=["m", "v", "cell", "d"], dtype=object)

    left, right = (_dealt(side, ["cell", "block"]).groupBy("cell", "block") for side in (left, right))
    return left.cogroup(right).applyInPandas(assign, f"m {id_type}, v {_type(rows, 'v')}, cell long, d double")


def _described(split: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, cell, v, n, lo, hi): child cells with their centres, sizes and distance ranges."""
    sizes = split.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min_by("v", F.struct("d", F.xxhash64("v"))).alias("v")
    )
    return sizes.select(F.floor((F.col("cell") - 1) / FAN).cast("long").alias("parent"), "cell", "v", "n", "lo", "hi")


def _measured(rows: DataFrame) -> tuple[int, int | None]:
    return tuple(rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first())


class Tree:
    """Leaves (m, v, cell) of all rows and the levels (parent, cell, v, n, lo, hi, leaf) above them."""

    def __init__(self, rows: DataFrame, measured: tuple[int, int | None] | None = None):
        """``rows``: (m, v), read several times."""
        id_type = rows.schema["m"].dataType.simpleString()
        n, width = measured or _measured(rows)
        self.levels: list[DataFrame] = []
        self.size, self.width = n, width or 0
        open_ = rows.select("m", "v", F.lit(0).cast("long").alias("cell"), F.lit(n).cast("long").alias("n"))
        if n <= LEAF_ROWS:
            self.leaves = open_
            return
        leaves = []
        for depth in range(DEPTH):
            split = materialize(_split(open_, id_type, self.width), "cells")
            whole = (F.col("n") <= LEAF_ROWS) | (F.col("hi") == 0) | F.lit(depth == DEPTH - 1)
            level = materialize(_described(split, open_).withColumn("leaf", whole), "levels")
            self.levels.append(level)
            placed = lookup_join(split.select("m", "v", "cell"), level.select("cell", "n", "leaf"), ["cell"])
            leaves.append(placed.filter("leaf").drop("leaf"))
            if depth:
                discard(open_)
            if level.filter("not leaf").isEmpty():
                break
            open_ = materialize(placed.filter("not leaf").drop("leaf"), "open")
        self.leaves = reduce(DataFrame.unionByName, leaves)  # not written again: cells and levels are


# --- queries --------------------------------------------------------------------


def _parted(asked: DataFrame, level: DataFrame, width: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Queries and child cells of each cell in parts, whose queries may all go to all of the children."""
    fan = level.groupBy(F.col("parent").alias("cell")).agg(F.count(F.lit(1)).alias("fan"))
    count = materialize(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("held")).join(fan, "cell"), "parts")
    parts = _blocks(F.col("held"), _block_rows(width))
    if every:
        parts = F.greatest(parts, _blocks(F.col("held"), F.greatest(F.lit(1), F.floor(ROUTED_BYTES / (8 * max(1, width) * F.col("fan"))))))
    left = lookup_join(asked, count, ["cell"]).withColumn("part", F.pmod(F.xxhash64("q", "v"), parts).cast("int")).drop("held", "fan")
    nodes = lookup_join(level.withColumnsRenamed({"cell": "child", "parent": "cell"}), count, ["cell"]).filter("held is not null")
    return left, nodes.select("cell", "child", "v", "lo", "hi", "leaf", _numbers(parts).alias("part"))


def _descend(asked: DataFrame, level: DataFrame, width: int, query_type: str, every: bool) -> DataFrame:
    """Queries (q, v, r, home, cell, ...) in child cells: the nearest centre's, or all but home that may hold a row within r.

    A query that meets more than ``ROUTES`` of them is one row without a vector and a cell.
    """
    kept = [c for c in asked.columns if c != "cell"]
    left, right = (_dealt(side, ["cell", "part"]).groupBy("cell", "part") for side in _parted(asked, level, width, every))

    def route(part: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cells):
            centres, child, leaf = stacked(cells["v"]), cells["child"].to_numpy(), cells["leaf"].to_numpy()
            lo, hi = cells["lo"].to_numpy() * (1 - SLACK), cells["hi"].to_numpy() * (1 + SLACK)
        for at in range(0, len(part) if len(cells) else 0, step := max(1, CELLS // max(1, len(cells)))):
            some = part.iloc[at:at + step]
            rough, off = bracketed(stacked(some["v"]), centres)
            low, high = np.sqrt(np.maximum(rough - off, 0)) * (1 - SLACK), np.sqrt(np.maximum(rough + off, 0)) * (1 + SLACK)
            if every:
                r = some["r"].to_numpy(float)[:, None] * (1 + SLACK)
                met = (low - r <= hi) & (high + r >= lo) & (low - high.min(1, keepdims=True) <= 2 * r)
            else:
                met = np.zeros(rough.shape, bool)
                met[np.arange(len(some)), rough.argmin(1)] = True
            wide = met.sum(1) > ROUTES
            # a query has met the rows of its home cell
            row, cell = np.nonzero(met & ~wide[:, None] & (child != some["home"].to_numpy()[:, None]))
            out.append(some.iloc[row][kept].assign(cell=pd.array(child[cell], "Int64"), leaf=leaf[cell]))
            if wide.any():
                out.append(some[wide][kept].assign(v=None, cell=pd.array([None] * wide.sum(), "Int64"), leaf=False))
        return pd.concat(out) if out else pd.DataFrame(columns=[*kept, "cell", "leaf"], dtype=object)

    schema = ", ".join(f"{c} {_type(asked, c)}" for c in kept) + ", cell long, leaf boolean"
    return left.cogroup(right).applyInPandas(route, schema)


def _reach(asked: DataFrame, tree: Tree, query_type: str, every: bool) -> tuple[DataFrame, DataFrame | None]:
    """(q, v, r, home, i, cell): queries (q, v, r, home, i) in leaves; and the queries that meet too many cells."""
    at, done, met = asked.withColumn("cell", F.lit(0).cast("long")), [], []
    for level in tree.levels:
        routed = materialize(_descend(at, level, tree.width, query_type, every), "routed")
        at = routed.filter("not leaf").drop("leaf")
        if every:
            met.append(materialize(routed.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("cell").isNull()).alias("wide")), "met"))
            wide = met[-1].filter(F.col("wide") | (F.col("n") > ROUTES)).select("i")
            at = at.join(wide, "i", "left_anti")  # rows that are done leave below, once all levels are counted
        done.append(routed.filter("leaf").drop("leaf"))
    routed = reduce(DataFrame.unionByName, done)
    if not every:
        return routed, None
    counts = reduce(DataFrame.unionByName, met).groupBy("i").agg(F.sum("n").alias("n"), F.max("wide").alias("wide"))
    wide = materialize(counts.filter(F.col("wide") | (F.col("n") > ROUTES)).select("i"), "wide")
    if wide.isEmpty():
        return routed, None
    return routed.join(wide, "i", "left_anti"), asked.join(wide, "i", "left_semi")


def _in_one_leaf(asked: DataFrame, tree: Tree) -> tuple[DataFrame, DataFrame]:
    held = F.lit(asked.count())
    return asked.withColumns({"cell": F.lit(0).cast("long"), "n": F.lit(tree.size), "held": held}), tree.leaves.withColumn("held", held)


def _in_leaves(routed: DataFrame, tree: Tree) -> tuple[DataFrame, DataFrame]:
    sizes = reduce(DataFrame.unionByName, [level.filter("leaf").select("cell", "n") for level in tree.levels])
    known = materialize(routed.groupBy("cell").agg(F.count(F.lit(1)).alias("held")).join(sizes, "cell"), "reached")
    # leaves that no query reaches stay out
    return lookup_join(routed, known, ["cell"]), lookup_join(tree.leaves.drop("n"), known, ["cell"]).filter("held is not null")


def _compare(asked: DataFrame, rows: DataFrame, k: int, tree: Tree) -> DataFrame:
    """(q, m, distance): the k nearest rows (m, v, cell, n, held) of each block for every query (q, v, r, cell, n, held) in its leaf."""
    query_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((asked, "q"), (rows, "m")))
    blocks, parts = (_blocks(F.col(c), _block_rows(tree.width)) for c in ("n", "held"))
    left = asked.select("q", "v", "r", "cell", F.pmod(F.xxhash64("q", "v"), parts).cast("int").alias("part"), _numbers(blocks).alias("block"))
    right = rows.select("m", "v", "cell", F.pmod(F.xxhash64("m", "v"), blocks).cast("int").alias("block"), _numbers(parts).alias("part"))

    def compare(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        kept = []
        if len(asked) and len(rows):
            ids, vectors = rows["m"].to_numpy(), stacked(rows["v"])
            for at in range(0, len(asked), step := max(1, CELLS // len(rows))):
                part = asked.iloc[at:at + step]
                q, m, d = best(stacked(part["v"]), vectors, k, part["r"].to_numpy(float) ** 2)
                near = first(pd.DataFrame({"q": q, "m": ids[m], "d": d}), k)
                kept.append(pd.DataFrame({"q": part["q"].to_numpy()[near["q"].to_numpy(int)], "m": near["m"], "distance": near["d"]}))
        return pd.concat(kept) if kept else pd.DataFrame(columns=["q", "m", "distance"], dtype=object)

    key = ["cell", "block", "part"]
    left, right = ((_dealt(side, key) if tree.levels else side).groupBy(*key) for side in (left, right))
    return left.cogroup(right).applyInPandas(compare, f"q {query_type}, m {id_type}, distance double")


# --- queries that pass by all rows ------------------------------------------------


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` rows: an array of each column, of vectors (v) their bytes."""
    names = [c for c in rows.columns if c != "v"]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        n, vectors = sum(b.num_rows for b in held), pa.concat_arrays([b.column("v") for b in held])
        if len(set(pc.list_value_length(vectors).to_pylist())) > 1:
            raise ValueError("vectors differ in their number of components")
        columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([b.column(c) for b in held])) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array([vectors.flatten().to_numpy().tobytes()], pa.binary())], [*names, "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - count))
                batch, count = batch.slice(held[-1].num_rows), count + held[-1].num_rows
                if count == size:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return rows.select(*names, "v").mapInArrow(pack, ", ".join(f"{c} array<{_type(rows, c)}>" for c in names) + ", v binary")


def _unpacked(packed: pa.BinaryScalar, rows: int, kind: str) -> np.ndarray:
    held = np.frombuffer(packed.as_buffer(), np.float32 if kind == "array<float>" else float)
    return held.reshape(rows, len(held) // rows).astype(float)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object) if column.null_count else column.to_numpy(zero_copy_only=False)


class Passing:
    """A block of queries, and the k nearest rows that it has met so far."""

    def __init__(self, ids: pa.Array, r: np.ndarray, home: np.ndarray, k: int):
        self.ids, self.home, self.k, self.most = ids, home, k, r**2
        self.found, self.fresh, self.held = None, [], 0

    def meet(self, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> None:
        """Rows of one cell come one after the other."""
        ends = np.append(np.flatnonzero(np.diff(cells)) + 1, len(cells))
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            for at in range(start, end, PIECE_ROWS):
                self._piece(queries, vectors[at:(to := min(end, at + PIECE_ROWS))], ids[at:to], cells[at])

    def _piece(self, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, cell: int) -> None:
        centre = vectors.mean(0)[None]
        far = np.sqrt(((vectors - centre) ** 2).sum(1)).max() * (1 + SLACK)
        rough, off = bracketed(queries, centre)
        near = np.flatnonzero((np.sqrt(np.maximum(rough - off, 0)) * (1 - SLACK) - far)[:, 0] <= np.sqrt(self.most) * (1 + SLACK))
        for at in range(0, len(near), step := max(1, CELLS // len(vectors))):
            some = near[at:at + step]
            q, m, d = within(queries[some], vectors, self.k, self.most[some])
            self.fresh.append(pd.DataFrame({"q": some[q], "m": ids[m], "d": d, "home": self.home[some[q]] == cell}))
            self.held += len(q)
            if self.held >= len(queries):
                self.merge()

    def merge(self) -> None:
        if self.fresh:
            self.found = first(pd.concat([*([] if self.found is None else [self.found]), *self.fresh], ignore_index=True), self.k)
            self.fresh, self.held = [], 0
            full = self.found.groupby("q")["d"].agg(["size", "max"]).query(f"size == {self.k}")
            self.most[full.index] = np.minimum(self.most[full.index], full["max"])


def _passing(asked: DataFrame, rows: DataFrame, k: int, width: int) -> DataFrame:
    """(q, m, distance): the k nearest rows (m, v, cell) of every query (q, v, r, home), without those of its home cell.

    Nothing but packed blocks is written, once: each task reads all blocks of rows for its own queries.
    """
    cores, size = asked.sparkSession.sparkContext.defaultParallelism, _packed_rows(width)
    each = min(size, max(LEAST_BLOCK, -(-asked.count() // (CORE_BLOCKS * cores))))
    kinds, (query_type, id_type) = (_type(asked, "v"), _type(rows, "v")), (_type(asked, "q"), _type(rows, "m"))
    blocks = materialize(_packed(rows.select("m", "cell", "v"), size), "passed", FILE_BLOCKS)
    mine = _packed(asked.select("q", "r", "home", "v"), each).withColumnRenamed("v", "w").withColumn("block", F.monotonically_increasing_id())
    mine = materialize(mine, "passing", 1)
    parts = max(1, -(-CORE_BLOCKS * cores // max(1, mine.count())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Passing] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                block, q, m = get("block").as_py(), get("q").values, get("m").values
                if block not in kept:  # copies: slices would keep their batches
                    ids = q.take(pa.array(np.arange(len(q))))
                    kept[block] = Passing(ids, np.array(get("r").values), np.array(get("home").values), k)
                vectors = (_unpacked(get(name), len(side), kind) for name, side, kind in zip(("w", "v"), (q, m), kinds, strict=True))
                kept[block].meet(*vectors, _ids(m), np.array(get("cell").values))
                id_kind = m.type
        for one in kept.values():
            one.merge()
            if one.found is not None:
                found = one.found[~one.found["home"]]
                columns = one.ids.take(pa.array(found["q"].to_numpy(int))), pa.array(found["m"].tolist(), id_kind), pa.array(found["d"].to_numpy(float))
                yield pa.RecordBatch.from_arrays(list(columns), ["q", "m", "distance"])

    pairs = blocks.coalesce(parts).crossJoin(mine.hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(compare, f"q {query_type}, m {id_type}, distance double")


def _packed_rows(width: int) -> int:
    return max(1, min(_block_rows(width), PACKED_BYTES // (4 * max(1, width))))


def _met_share(rows: DataFrame, asked: DataFrame, k: int, radius: float, n: int, width: int) -> float:
    """Share of the rows in cells that a query must visit if it knows its k-th distance, from some queries and one level of cells."""
    fan, kinds = min(FAN, -(-2 * n // LEAF_ROWS) + 1), (_type(rows, "v"), "array<double>")
    some = lambda df, key, count, kind: (
        df.groupBy(F.pmod(key, F.lit(count)).alias("h")).agg(F.min_by("v", key).alias("v")).select(F.lit(kind).alias("kind"), F.col("v").cast("array<double>").alias("v"))
    )
    probe = some(rows, F.xxhash64("v"), fan, 0).unionByName(some(asked, F.xxhash64("q", "v"), PROBES, 1))
    probe = _packed(probe.coalesce(1), fan + PROBES).withColumnRenamed("v", "w")
    blocks = _packed(rows.select("m", "v"), _packed_rows(width))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, kind = len(batch.column("m")[row].values), np.array(batch.column("kind")[row].values)
                vectors = _unpacked(batch.column("v")[row], size, kinds[0])
                probe = _unpacked(batch.column("w")[row], len(kind), kinds[1])
                centres, queries = probe[kind == 0], probe[kind == 1]
                d = np.sqrt(np.maximum(bracketed(vectors, centres)[0], 0))
                cells = pd.DataFrame({"at": d.argmin(1), "d": d.min(1)}).groupby("at")["d"].agg(["size", "min", "max"])
                near = np.sort(np.maximum(bracketed(queries, vectors)[0], 0), axis=1)[:, :k]
                far = np.sqrt(np.maximum(bracketed(queries, centres)[0], 0))
                some = {"at": cells.index.to_numpy(), "n": cells["size"].to_numpy(), "lo": cells["min"].to_numpy(), "hi": cells["max"].to_numpy()}
                none = [None] * len(cells)
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array([*some["at"], *(fan + np.arange(len(queries)))], pa.int64()), "n": pa.array([*some["n"], *[0] * len(queries)], pa.int64()),
                    "lo": pa.array([*some["lo"], *[None] * len(queries)], pa.float64()), "hi": pa.array([*some["hi"], *[None] * len(queries)], pa.float64()),
                    "near": pa.array([*none, *near.tolist()], pa.list_(pa.float64())), "far": pa.array([*none, *far.tolist()], pa.list_(pa.float64())),
                })

    told = blocks.crossJoin(F.broadcast(probe)).mapInArrow(tell, "at long, n long, lo double, hi double, near array<double>, far array<double>")
    nearest = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
    found = told.groupBy("at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), nearest.alias("near"), F.first("far", True).alias("far")).collect()
    cells, shares = [r for r in found if r["at"] < fan], []
    at, held, lo, hi = (np.array([r[c] for r in cells], int if c == "at" else float) for c in ("at", "n", "lo", "hi"))
    for r in (r for r in found if r["at"] >= fan):
        reach = min(radius, np.sqrt(r["near"][-1]) if len(r["near"]) == k else np.inf)
        far = np.array(r["far"])
        met = (far[at] - reach <= hi) & (far[at] + reach >= lo) & (far[at] - far.min() <= 2 * reach)
        shares.append(held[met].sum() / n)
    return float(np.mean(shares)) if shares else 0.0


def usable(vector: Column) -> Column:
    """Vectors with finite components only; others take no part."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def k_nearest(rows: DataFrame, asked: DataFrame, k: int, radius: float) -> DataFrame:
    """(q, m, distance, rank): the k nearest rows (m, v) of each query (q, v) by squared distance, none beyond ``radius``.

    Ties go to the smaller m; rows of one query id are one query with all their candidates.
    """
    importable(rows.sparkSession)
    query_type = asked.schema["q"].dataType.simpleString()
    rows = rows.filter(usable(F.col("v")))
    asked = asked.filter(usable(F.col("v"))).withColumn("r", F.lit(float(radius)))
    order = Window.partitionBy("q").orderBy("distance", "m")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    nowhere, n, width = F.lit(-1).cast("long"), *_measured(rows)
    if n > LEAF_ROWS and _met_share(rows, asked, k, radius, n, width or 0) > WIDE:
        return ranked(_passing(asked.withColumn("home", nowhere), rows.withColumn("cell", F.lit(0).cast("long")), k, width or 0))
    tree = Tree(rows, (n, width))
    if not tree.levels:
        return ranked(_compare(*_in_one_leaf(asked, tree), k, tree))
    # i need not be unique: queries of one i are sent to cells, or pass by all rows, together
    asked = materialize(asked.withColumns({"home": nowhere, "i": F.xxhash64("q", "v")}), "asked")
    home, _ = _reach(asked, tree, query_type, every=False)
    discard(asked)
    near = materialize(ranked(_compare(*_in_leaves(home, tree), k, tree)), "near")
    bounds = near.groupBy("q").agg(F.max(F.when(F.col("rank") == k, F.sqrt("distance"))).alias("bound"))
    closer = weighted_lookup(home, bounds, ["q"])
    closer = closer.select("q", "v", F.least("r", F.coalesce("bound", "r")).alias("r"), F.col("cell").alias("home"), "i")
    routed, wide = _reach(closer, tree, query_type, every=True)
    found = near.drop("rank").unionByName(_compare(*_in_leaves(routed, tree), k, tree))
    if wide is not None:
        ordered = tree.leaves.repartitionByRange("cell", F.xxhash64("m", "v")).sortWithinPartitions("cell")
        found = found.unionByName(_passing(wide, ordered, k, tree.width))
    return ranked(found)
