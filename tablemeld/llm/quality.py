"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a feature reaches a cutoff.  Cutoffs are chosen for each
stratum (language) from a fixed grid by labelled holdouts: a cutoff is certified when the
exact binomial test shows that it rejects at most ``risk`` of the stratum's good documents.
With k of n good holdout documents rejected, that is P(Bin(n, risk) <= k) <= error / tests,
where ``tests`` counts all strata, features and grid points (Bonferroni), so that with
probability 1 - error every certified cutoff keeps its promise, whichever one is picked.
The risk is shared evenly by the features: a good document is falsely rejected by any rule
with probability ``risk`` at most.  Of the certified cutoffs the one that best separates is
taken, and none where nothing is certified: such a stratum keeps its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld.llm.common import WORD, free_name, materialize, word_array

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Cutoffs that are tried for every feature; fixed before any label is seen.
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Features as shares of words (or of lines); larger is worse.
FEATURES = ("symbol_share", "shout_share", "upper_share", "dup_line_share", "repeat_share")
#: What is counted in a text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")
#: A cutoff must reject at least this share of the low-quality holdouts for each unit of good ones rejected.
PRICE = 10.0
#: Terms of the lower binomial tail that are added one by one; the rest is bounded from above.
TAIL_TERMS = 4096


def text_measures(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts that the rules read, for every whole text.

    Null and empty texts have no words and zero counts.  ``n_repeat_words`` counts words in
    three-word windows that occur twice or more in the text, the first included.
    """
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    df = documents.select(*[F.col(f"`{c}`") for c in keep], content.alias("_text"))
    df = df.select(*keep, "_text", word_array(F.col("_text")).alias("_words"), lines.alias("_lines"))
    windows = F.when(
        F.size("_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    count = lambda chars: F.length("_text") - F.length(F.translate(F.col("_text"), chars, ""))
    df = df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        count("!").cast("long").alias("n_shouts"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    df = df.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    # windows sorted by content: equal neighbours are repeats; then the words they cover, by place
    placed = F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h: bigint, i: int>>")
    )
    df = df.withColumn("_placed", placed).drop("_windows")
    again = F.transform(
        F.filter(
            F.transform("_placed", lambda x, i: F.when((x["h"] == F.get("_placed", i - 1)["h"]) | (x["h"] == F.get("_placed", i + 1)["h"]), x["i"])),
            lambda i: i.isNotNull(),
        ),
        lambda i: F.coalesce(i, F.lit(0)),
    )
    covered = F.aggregate(
        F.sort_array(again),
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(F.lit(3), i - s["at"])).alias("n")),
        lambda s: s["n"],
    )
    counts = [F.col(c) for c in MEASURES[:-1]] + [covered.alias("n_repeat_words")]
    # inlined as one element: the optimizer does not count a text again wherever a count is used
    return df.select(*keep, F.inline(F.array(F.struct(*counts))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": share("n_symbols", "n_words"),
        "shout_share": share("n_shouts", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, exact to about 1e-12."""
    z = x + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x + 1.0
    for k in range(2, 9):
        product = product * (x + float(k))
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """An upper bound, tight to rounding, of P(Bin(n, p) <= k); 1 where k >= n p."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p))
    ratio = lambda j: (k - j) * (1 - p) / ((n - k + j + 1) * p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(TAIL_TERMS))).cast("int"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * ratio(j.cast("double"))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    tail = F.aggregate(steps, start, add)
    r = ratio(F.least(k, F.lit(float(TAIL_TERMS + 1))))
    return F.when(k < n * p, top * (tail["total"] + tail["term"] * r / (1 - r))).otherwise(1.0)


def fit_cutoffs(measures: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """stratum, feature, cutoff, n_good, k_good, n_bad, k_bad: at most one row for each stratum and feature.

    ``labels`` has the key and ``quality`` (0 or 1); a key with both labels counts as good, null
    keys and labels are left out, and base failures, which no cutoff can change, are no holdouts.
    A null stratum is a stratum.  Holdouts are joined as counts; no text moves.
    """
    known = labels.select(F.col(key).alias("_key"), "quality").dropna().groupBy("_key").agg(F.max("quality").alias("_good"))
    shares = features()
    rows = measures.filter(~base_failed()).join(known, F.col(key) == F.col("_key"))
    rows = rows.select(F.col(stratum).alias("stratum"), (F.col("_good") > 0).alias("good"), *[c.alias(f) for f, c in shares.items()])
    grid = F.array(*[F.lit(x) for x in GRID])
    # a value counts for the highest cutoff that it reaches; cutoffs below get it by a running sum
    reached = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.size(F.filter(grid, F.col(f).__ge__)).alias("reach")) for f in FEATURES]))
    counts = rows.select("stratum", "good", reached.alias("x")).groupBy("stratum", "x.feature", "x.reach").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    cells = counts.groupBy("stratum", "feature").agg(F.collect_list(F.struct("reach", "good", "bad")).alias("at"), F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
    total = lambda what, i: F.aggregate(F.filter("at", lambda x: x["reach"] > i), F.lit(0).cast("long"), lambda a, x: a + x[what])
    tried = cells.select("stratum", "feature", "n_good", "n_bad", F.posexplode(F.transform(grid, lambda g, i: F.struct(g.alias("cutoff"), total("good", i).alias("k_good"), total("bad", i).alias("k_bad")))).alias("i", "x"))
    tried = tried.select("stratum", "feature", "n_good", "n_bad", "x.*")
    tests = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    tried = tried.withColumn("tail", binomial_tail(F.col("k_good"), F.col("n_good"), F.lit(risk / len(FEATURES)))).withColumn("tests", tests)
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - PRICE * F.col("k_good") / F.greatest("n_good", F.lit(1))
    certified = tried.filter(F.col("tail") <= error / F.col("tests")).withColumn("gain", gain).filter("gain > 0")
    best = Window.partitionBy("stratum", "feature").orderBy(F.col("gain").desc(), F.col("cutoff").desc())
    return certified.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "gain", "tail", "tests")


def cutoff_columns(cutoffs: DataFrame) -> DataFrame:
    """One row for each stratum with a column for each feature's cutoff (null: none)."""
    return cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("feature") == f, F.col("cutoff"))).alias(f"cut_{f}") for f in FEATURES])


def rejected() -> Column:
    fails = F.lit(False)
    for f, share in features().items():
        fails = fails | F.coalesce(share >= F.col(f"cut_{f}"), F.lit(False))
    return fails


def judge(measures: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Measures with ``base_failed`` and ``kept``; rows whose stratum has no cutoffs pass the method.

    Strata with a certified cutoff are few: each needs dozens of labelled documents.  Their
    table is joined by equality, and Spark broadcasts it only below its own size threshold.
    """
    judged = measures.join(cutoff_columns(cutoffs), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    judged = judged.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected())
    return judged.drop("stratum", *[f"cut_{f}" for f in FEATURES])


def quality_rules(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """key, stratum, the counts, ``base_failed`` and ``kept`` for every row of ``documents``.

    Texts are read once; the counts are written to the shared folder, and labels, cutoffs and
    verdicts work on them.  Without labels nothing is certified and only the base rules reject.
    """
    measures = materialize(text_measures(documents, text, [key, stratum]), "quality-measures")
    return judge(measures, fit_cutoffs(measures, labels, key, stratum, risk, error), stratum)


def keep_good(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Texts are measured a second time instead of being shuffled to their verdicts.
    """
    measures = materialize(text_measures(documents, text, [key, stratum]), "quality-measures")
    cutoffs = materialize(fit_cutoffs(measures, labels, key, stratum, risk, error), "quality-cutoffs")
    row = free_name(documents, "row")
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(row), F.col(f"`{text}`").alias("text"), F.col(f"`{stratum}`").alias("lang"))
    return judge(text_measures(whole, "text", [row, "lang"]), cutoffs, "lang").filter("kept").select(f"{row}.*")
