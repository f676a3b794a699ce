"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablemeld.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node that it reaches.

    ``links`` has ``a`` and ``b`` (long).  Each round moves links towards smaller nodes; the
    smallest neighbours come from aggregates, so no task gathers a node's neighbours, and
    nodes with very many links are split by the skew handling of the joins.  The number of
    rounds grows with the logarithm of the nodes.  Rounds are written to the shared folder.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = materialize(links, "links")
    mark = _mark(links)
    while mark[0]:
        links = materialize(_small_star(materialize(_large_star(links), "links")), "links")
        after = _mark(links)
        if after == mark:
            break
        mark = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    """Count and checksum: links that did not change have not moved."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
