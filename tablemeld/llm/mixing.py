"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words.  Its documents share one expected number of
copies, target / size of the source; whole copies are certain, and the fractional rest is
rounded to 0 or 1 by pairing: two documents with open probabilities p, q and sizes a, b
trade mass (a dp = -b dq) until one of them is 0 or 1, in a random direction with odds that
keep both expectations.  The words taken do not change by a trade, so a source ends within
one document of its target.

Documents are dealt by a hash into buckets of bounded size, which tasks round on their own;
each leaves at most one open document.  The residuals of neighbouring buckets meet in the
next level of a reduction tree, a constant number at a time, until each source has one,
which is rounded at random.  All draws are hashes of the seed, the level and the bucket, so
reruns and recomputed tasks agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld.llm.common import WORD, free_name, importable, materialize

#: Documents in a bucket of the first level on average; residuals that meet in the next ones.
BUCKET, FAN_IN = 4096, 1024
#: Sources of one mix.  A mix is a short list; more sources than this are refused.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is reshared."""
    targets, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def source_targets(sized: DataFrame, source: str, size: str, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size, target, copies and a number for each source; one row each.

    Sources in code-point order, null last, take the weights in turn.
    """
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    found = sums.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.source_size for r in found]
    turns = [weights[i % len(weights)] for i in range(len(found))]
    targets = share_targets(sizes, turns, sum(sizes), most)
    rows = [(r.source, r.source_size, r.rows, t, t / r.source_size if r.source_size else 0.0, i) for i, (r, t) in enumerate(zip(found, targets, strict=True))]
    return sized.sparkSession.createDataFrame(rows, f"source {sized.schema[source].dataType.simpleString()}, source_size long, source_rows long, target double, copies double, source_no int")


def pivot(p: np.ndarray, a: np.ndarray, draws: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
    """Round open probabilities ``p`` of documents with sizes ``a`` pair by pair.

    Returns 0/1 for all but the open one, whose place is returned too (-1: none) and whose
    probability stays in the result; with ``last`` it is rounded by the last draw.  ``draws`` has
    one more than there are documents.
    """
    p, tiny, held = p.astype(float), 1e-12, -1
    for j in range(len(p)):
        if p[j] <= tiny or p[j] >= 1 - tiny:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        x, y, s, t = p[held], p[j], float(a[held]), float(a[j])
        up, down = min((1 - x) * s, y * t), min(x * s, (1 - y) * t)  # words that may move to the held one, or from it
        move = up if draws[j] * (up + down) < down else -down
        x, y = x + move / s, y - move / t
        x, y = (round(v) if v <= tiny or v >= 1 - tiny else v for v in (x, y))
        p[held], p[j] = x, y
        if 0 < y < 1:
            held = j
        elif not 0 < x < 1:
            held = -1
    if held >= 0 and last:
        p[held], held = float(draws[-1] < p[held]), -1
    return p, held


def _draws(count: int, *words: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([w & 0xFFFFFFFFFFFFFFFF for w in words]))).random(count)


def _rounder(seed: int, level: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so that a small one stays open; rows equal in all of this are interchangeable
        group = group.sort_values(["size", "order", "p"], ascending=[False, True, True], kind="stable", ignore_index=True)
        draws = _draws(len(group) + 1, seed, level, int(group.source_no[0]), int(group.bucket[0]))
        p, held = pivot(group.p.to_numpy(), group["size"].to_numpy(), draws, last)
        group["p"], group["open"] = p, np.arange(len(group)) == held
        return group

    return run


def _row_hash(key: str, source: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`").cast("string"))


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """key, ``size``, ``source_size``, ``target``, ``copies`` (whole copies taken) and ``row_hash``.

    One row for each row of ``documents``.  Sizes are words; null and empty texts have none and
    get no copies, null sources are a source of their own, and copies of a row are rounded
    apart.  ``row_hash`` (of key, source and text) tells rows with the same key apart; rows
    equal in it are interchangeable.
    """
    importable(documents.sparkSession)
    named = documents.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`").cast("string")).alias("size"),
        _row_hash(key, source, text).alias("row_hash"),
    )
    sized = materialize(named, "mix-sizes")
    targets = source_targets(sized, "source", "size", weights, most)
    # the table of sources is bounded by MAX_SOURCES
    rated = sized.join(F.broadcast(targets), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    whole = F.floor("copies")
    buckets = F.greatest(F.ceil(F.col("source_rows") / BUCKET), F.lit(1))
    order = F.xxhash64("row_hash", F.lit(seed))
    state = rated.select(
        F.col("key").cast("string"), "size", "source_size", "target", "row_hash", whole.cast("long").alias("whole"),
        F.when(F.col("size") > 0, F.col("copies") - whole).otherwise(0.0).alias("p"), "source_no", order.alias("order"),
        F.pmod(order, buckets).cast("long").alias("bucket"),
    ).withColumn("open", F.lit(True))
    most_buckets = targets.agg(F.max(F.greatest(F.ceil(F.col("source_rows") / BUCKET), F.lit(1)))).first()[0] or 1
    done, level = [], 0
    while True:
        last = most_buckets == 1
        state = materialize(state.groupBy("source_no", "bucket").applyInPandas(_rounder(seed, level, last), state.schema), f"mix-level{level}")
        done.append(state.filter(~F.col("open")))
        if last:
            break
        most_buckets, level = -(-most_buckets // FAN_IN), level + 1
        state = state.filter("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("long")).otherwise(0)
    return out.select(F.col("key").cast(documents.schema[key].dataType).alias(key), "size", "source_size", "target", copies.alias("copies"), "row_hash")


def take(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``documents`` as often as it is taken, with its own columns.

    Copies of rows that are equal in key, source and text are dealt among them evenly.
    """
    counted = mix(documents, key, text, source, weights, most, seed)
    counts = materialize(counted.groupBy("row_hash").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).filter("n > 0"), "mix-counts")
    hashed, n, of, place = (free_name(documents, x) for x in ("row_hash", "n_copies", "n_rows", "row_place"))
    counts = counts.select(F.col("row_hash").alias(hashed), F.col("n").alias(n), F.col("rows").alias(of))
    rows = documents.withColumn(hashed, _row_hash(key, source, text)).join(counts, hashed)
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(hashed).orderBy(hashed)))
    share = F.floor(F.col(n) / F.col(of)) + F.when(F.col(place) <= F.col(n) % F.col(of), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(1), share.cast("int"))).alias(place)
    return rows.select(*[F.col(f"`{c}`") for c in documents.columns], copies).drop(place)
