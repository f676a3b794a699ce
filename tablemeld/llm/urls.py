"""URL filters: nested allow and block rules, resolved by one sorted sweep.

A rule is a host and a path prefix.  It fits its host and all subdomains when the path of
the url starts with the rule's path; the longest fitting rule decides.

Canonical keys put the labels of a host in reverse, then a slash, then the path, so that a
rule becomes the interval of all keys that start with its own.  Intervals of prefixes are
nested or disjoint.  Urls and interval ends are merged in key order; the sweep holds a
stack of the rules that are open, one column for each level, and the top of the stack is
the longest rule of that host.  A url takes part once for each of its host suffixes, and
the longest of the tops wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld.llm.common import ascii_lower, free_name, materialize, partitions

_OPEN, _POINT, _CLOSE = 0, 1, 2


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path).cast("binary")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Pages with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block); ``rule`` is host and
    path of the one that decides, else null, and the verdict is then ``default``.
    Decided by length of host and path together, then by the longer host; of repeated rules
    with both verdicts block counts; rules with a null host or path are void.  A null url,
    or one without ``://``, has an empty host and path and fits no rule.  Every row of
    ``pages`` comes back once, repeated rows included; columns of the four names are replaced.
    """
    spark, n = pages.sparkSession, partitions(pages.sparkSession)
    link = F.col(f"`{url}`").cast("string")
    pages = pages.withColumns({"host": F.coalesce(url_host(link), F.lit("")), "path": F.coalesce(url_path(link), F.lit(""))}).drop("rule", "verdict")
    known = (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .dropna(subset=["host", "path"])
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("rule", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("deep"), F.concat("host", "path").alias("name"), "verdict"))
        .withColumn("key", _key(_labels(F.col("host")), F.col("path")))
    )
    deepest = known.agg(F.max(F.size(_labels(F.col("host"))))).first()[0]
    if deepest is None:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    urls = pages.select("host", "path").distinct()
    labels = _labels(F.col("host"))
    suffix = F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))).alias("j")
    points = urls.select("host", "path", suffix).select(
        _key(F.slice(labels, -F.col("j"), F.col("j")), F.col("path")).alias("key"),
        F.lit(_POINT).alias("kind"), F.lit(None).cast(known.schema["rule"].dataType).alias("rule"), "host", "path",
    )
    ends = F.array(
        F.struct(F.col("key"), F.lit(_OPEN).alias("kind"), F.col("rule")),
        F.struct(F.concat("key", F.lit(bytes([255]))).alias("key"), F.lit(_CLOSE).alias("kind"), F.col("rule")),
    )  # no UTF-8 text holds the byte 255, so this end lies behind all keys with the prefix
    bounds = known.select(F.inline(ends)).withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})
    events = points.unionByName(bounds).repartitionByRange(n, "key", "kind", "host").withColumn("run", F.spark_partition_id())
    events = materialize(events, "url-events")

    step = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _CLOSE, -1).otherwise(0)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("run").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each run (range partition), never more than the shuffle width
    entered = events.groupBy("run").agg(F.sum(step).alias("net")).select("run", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("entered"))
    marks = (
        events.filter(F.col("kind") != _POINT).withColumn("level", F.sum(step).over(within))
        .join(F.broadcast(entered), "run").withColumn("level", F.col("level") + F.col("entered"))
    )
    height = marks.agg(F.max("level")).first()[0]
    slots = [f"slot{k}" for k in range(1, height + 1)]
    opened = lambda k: (F.col("kind") == _OPEN) & (F.col("level") == k)
    left = marks.groupBy("run").agg(*[F.max_by("rule", F.when(opened(k), F.col("key"))).alias(s) for k, s in enumerate(slots, 1)])
    carried = entered.join(left, "run", "left").select("run", "entered", *[F.last(s, True).over(before).alias(f"{s}_before") for s in slots])
    swept = events.join(F.broadcast(carried), "run").withColumn("level", F.sum(step).over(within) + F.col("entered"))
    for k, s in enumerate(slots, 1):
        swept = swept.withColumn(s, F.coalesce(F.last(F.when(opened(k), F.col("rule")), True).over(within), F.col(f"{s}_before")))
    top = F.when(F.col("level") > 0, F.element_at(F.array(*slots), F.col("level").cast("int")))
    found = (
        swept.filter(F.col("kind") == _POINT).withColumn("top", top).filter(F.col("top").isNotNull())
        .groupBy("host", "path").agg(F.max("top").alias("top"))
    )
    whose, which, hit = free_name(pages, "found_host"), free_name(pages, "found_path"), free_name(pages, "found_rule")
    found = found.select(F.col("host").alias(whose), F.col("path").alias(which), F.col("top").alias(hit))
    joined = pages.join(found, (F.col("host") == F.col(whose)) & (F.col("path") == F.col(which)), "left")
    return joined.withColumns({"rule": F.col(f"{hit}.name"), "verdict": F.coalesce(F.col(f"{hit}.verdict"), F.lit(default))}).drop(whose, which, hit)
