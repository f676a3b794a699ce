"""Target-distribution importance resampling on hashed word n-grams.

Features of a text are its runs of 1 to 3 words; each falls in one of a fixed number of buckets.
A bucket's gain is the logarithm of its share in the target over its share in all documents, a
document's weight is the sum of its features' gains, and the documents with the highest sums of
weight and Gumbel noise are drawn, which samples without replacement by weight.

Two passes over the texts count buckets and sum gains; in both, a table of each batch's n-grams
(``grams``) has slots with bucket and count, and the slots of the occurrences gather the gains.
Only counts are shuffled, one row for each bucket of a task, and then one small row for each
document, sorted by ranges.  The counts of all documents and of the target enter the gains whole.

Null and empty texts have no features and weigh nothing; repeated rows each count and may each be
drawn; rows of one score are drawn in order of their key, null keys last; null keys draw noise as
empty ones.  Very long texts make a step of their own.  With no target every t is zero, with no documents there
are no rows.  Other columns stay, and one named like a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld.llm.batches import kept_columns, plain_strings, schema_of, steps, with_inputs
from tablemeld.llm.common import free_name, importable, materialize
from tablemeld.llm.grams import GramTable, ngrams, words_of

#: Buckets that features are counted in (all counts fit in one small array), and words of the longest feature.
BUCKETS, ORDERS = 10_000, 3
MOST_BUCKETS = 1 << 20

#: Percent of the documents that is drawn, words that a document needs to be drawn, and the seed of the noise.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42

#: Bytes of text interned in one table, and documents that one task ranks.
STEP, RANKED = 1 << 20, 2_000_000

MADE = {"n_words": "bigint", "n_features": "bigint", "weight": "bigint"}


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any."""
    df = texts.select(F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in steps(batch, 0, STEP):
                words = words_of(plain_strings(part.column(0)))
                start, length, _ = ngrams(words, orders)
                grams = GramTable(words.data, start, length)
                np.add.at(total, grams.buckets(buckets), grams.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    importable(df.sparkSession)
    return df.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from two tables of bucket counts, which have one row for each bucket at most."""
    if buckets > MOST_BUCKETS:
        raise ValueError(f"at most {MOST_BUCKETS} buckets")
    s, t = dict(documents.collect()), dict(target.collect())
    all_s, all_t = sum(s.values()), sum(t.values())
    found = [
        math.floor(1000 * math.log((t.get(b, 0) + 1) * float(all_s + buckets) / ((s.get(b, 0) + 1) * float(all_t + buckets))))
        for b in range(buckets)
    ]
    return np.array(found, np.int64)


def weigh(documents: DataFrame, bucket_gains: np.ndarray, text: str = "text", orders: int = ORDERS) -> DataFrame:
    """Documents with ``n_words``, ``n_features`` and ``weight`` in place of ``text``."""
    kept = kept_columns(documents, [text, *MADE])
    df = with_inputs(documents, kept, {"text": F.col(f"`{text}`").cast("string")})
    n, shared = len(kept), importable(df.sparkSession).sparkContext.broadcast(bucket_gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in steps(batch, n, STEP):
                words = words_of(plain_strings(part.column(n)))
                start, length, row = ngrams(words, orders)
                grams = GramTable(words.data, start, length)
                of_occurrence = gain[grams.buckets(len(gain))][grams.slot]
                made = (
                    np.bincount(words.row, minlength=part.num_rows),
                    np.bincount(row, minlength=part.num_rows),
                    np.bincount(row, weights=of_occurrence, minlength=part.num_rows).astype(np.int64),  # exact below 2^53
                )
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(m, pa.int64()) for m in made)], names=[*kept, *MADE])

    return df.mapInArrow(run, schema_of(df, n, MADE))


def noise(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(weighed: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Weighed documents with ``score`` and ``rank``: 1, 2, 3 ... for the drawn ones, null for others.

    Rows are written, sorted by ranges and numbered within each range; the sizes of the ranges, one
    row each, give the numbers before it.  Equal rows get neighbouring ranks in any order.
    """
    spark = weighed.sparkSession
    weighed = weighed.drop("score", "rank")
    tie, spot = free_name(weighed, "tie"), free_name(weighed, "spot")
    scored = materialize(
        weighed.withColumn("score", F.col("weight") + noise(F.col(f"`{key}`"), seed)).withColumn(tie, F.monotonically_increasing_id()), "weighed"
    )
    able = F.col("n_words") >= least_words
    ranges = max(1, math.ceil(scored.filter(able).count() / RANKED))
    order = [F.desc("score"), F.col(f"`{key}`").asc_nulls_last(), F.col(tie)]
    ordered = scored.filter(able).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = materialize(ordered.withColumn(spot, F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright(spot, 33), F.col(spot).bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"), (F.sum("held").over(Window.partitionBy()) * percent / 100).cast("long").alias("most"))
    named = placed.select(*[F.col(f"`{c}`") for c in scored.columns], part.alias("range of rank"), within.alias("place in range"))
    place = F.col("ahead") + F.col("place in range") + 1
    joined = named.join(F.broadcast(sizes.select(F.col("part").alias("range of rank"), "ahead", "most")), "range of rank")
    ranked = joined.withColumn("rank", F.when(place <= F.col("most"), place)).select(*[F.col(f"`{c}`") for c in scored.columns], "rank")
    rest = scored.filter(F.coalesce(~able, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop(tie)


def resample(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """Documents with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` in place of ``text``."""
    found = gains(bucket_counts(documents, text, buckets, orders), bucket_counts(target, target_text, buckets, orders), buckets)
    return draw(weigh(documents, found, text, orders), key, percent, least_words, seed)
