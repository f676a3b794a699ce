"""Queries over the corpus tables, each next to its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemeld.llm import bpe, importance, infilling, licenses, merges, mixing, quality, search, secrets, simhash, substrings, tokens, urls
from tablemeld.llm.common import table
from tablemeld.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


# --- 8: url filters ----------------------------------------------------------------

#: Fixed rules of the query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

URL_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
names AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
         arg_max(rule_verdict, (length(rule_host || rule_path), length(rule_host))) AS verdict
  FROM names JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""


@query("op8_url_filters", URL_SQL)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# --- 9: secret scans ---------------------------------------------------------------


def _spans_sql(place: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{
        'begin': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0),
        'size': length(w[i]), 'part': length(k[i])}}), lambda s: s.part >= {rule.least})) AS s
      FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {rule.part}) AS k FROM d)"""


SECRET_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT doc_id, place, kind, s.begin::BIGINT AS begin, (s.begin + s.size)::BIGINT AS finish FROM ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES))})),
named AS (SELECT *, kind || ':' || begin || ':' || finish AS name, place < {len(secrets.BASE)} AS base FROM spans),
listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
         string_agg(name, ',' ORDER BY begin, place) FILTER (base) AS base, string_agg(name, ',' ORDER BY begin, place) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed ON d.doc_id = listed.doc_id
"""


@query("op9_secret_scans", SECRET_SQL)
def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    scanned = secrets.scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return scanned.select(
        "doc_id",
        *[F.size(F.filter(F.transform("secrets", lambda s: s["kind"]), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


# --- 10: quality rules -------------------------------------------------------------


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts,
         len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats ON d.doc_id = repeats.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
shares AS (
  SELECT doc_id, lang, base_failed, unnest([
    {'feature': 'symbol_share', 'share': CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END}, {'feature': 'shout_share', 'share': CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END},
    {'feature': 'upper_share', 'share': CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END}, {'feature': 'dup_line_share', 'share': CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END},
    {'feature': 'repeat_share', 'share': CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END}], recursive := true)
  FROM judged),
known AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
tried AS (
  SELECT lang, feature, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
         count(*) FILTER (good AND share >= cutoff) AS k_good, count(*) FILTER (NOT good AND share >= cutoff) AS k_bad, count(*) OVER () AS tests
  FROM shares JOIN known USING (doc_id), (SELECT unnest([""" + ", ".join(f"{g}::DOUBLE" for g in quality.GRID) + r"""]) AS cutoff) WHERE NOT base_failed GROUP BY lang, feature, cutoff),
certified AS (
  SELECT *, k_bad / greatest(n_bad, 1) - """ + str(quality.PRICE) + r""" * k_good / greatest(n_good, 1) AS gain FROM tried
  WHERE k_good < n_good * 0.05 / 5 AND list_sum(list_transform(range(0, k_good + 1), lambda i:
    exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.05 / 5) + (n_good - i) * ln(1 - 0.05 / 5)))) <= 0.05 / tests),
cutoffs AS (SELECT lang, feature, arg_max(cutoff, (gain, cutoff)) AS cutoff FROM certified WHERE gain > 0 GROUP BY lang, feature),
rejected AS (SELECT DISTINCT doc_id FROM shares JOIN cutoffs ON shares.feature = cutoffs.feature AND shares.lang IS NOT DISTINCT FROM cutoffs.lang WHERE share >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM judged
"""


@query("op10_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = quality.quality_rules(documents, table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# --- 5: mixing sources to target weights ---------------------------------------------


@query("op5_source_mix")
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# --- 4: byte-level BPE ---------------------------------------------------------------


def bpe_vocabulary(spark: SparkSession, path: str | None = None):
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.vocabulary(spark.sparkContext, Path(path).read_bytes(), public_tokenizers.PATTERN)


@query("op4_bpe_encode")
def bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digest(table(spark, folder, "documents").select("doc_id", "text"), bpe_vocabulary(spark))


# --- 6: SimHash near-duplicates ------------------------------------------------------


@query("op6_simhash_neardup")
def simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.cluster(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- 7: token-id files ----------------------------------------------------------------


@query("op7_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    target = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokens.write_tokens(table(spark, folder, "documents").select("doc_id", "text"), tokens.tokenizer(spark.sparkContext, definition), target)
    return tokens.read_digest(spark, target)


# --- 3: exact top-k search -------------------------------------------------------------

SEARCH_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op3_maxscore_topk", SEARCH_SQL)
def maxscore_topk(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


# --- 2: substring deduplication -----------------------------------------------------------

SUBSTRING_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM split WHERE len(words) >= 20),
hashed AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 19], ' ')) AS w FROM windows),
placed AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS place FROM hashed),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM placed WHERE place > 1),
listed AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT split.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
         array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ') AS kept
  FROM split LEFT JOIN listed ON split.doc_id = listed.doc_id)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM kept
"""


@query("op2_substring_dedup", SUBSTRING_SQL)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = substrings.remove_copies(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# --- 1: license scans ----------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({_quoted(name)}, [{', '.join(map(_quoted, licenses.template_bigrams(body)))}])" for name, body in licenses.TEMPLATES)

LICENSE_SQL = f"""
WITH templates(license, pairs) AS (VALUES {_TEMPLATE_ROWS}),
paragraphs AS (SELECT doc_id, text, regexp_split_to_array(coalesce(text, ''), '\\n[\\x20\\x09-\\x0D]*\\n') AS parts FROM documents),
units AS (
  SELECT doc_id, 'line' AS unit, generate_subscripts(lines, 1) - 1 AS place, unnest(lines) AS body
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', generate_subscripts(parts, 1) - 1, unnest(parts) AS body FROM paragraphs) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'document', 0, text FROM paragraphs WHERE len(parts) > 1),
worded AS (
  SELECT doc_id, unit, place, regexp_extract_all(translate(body, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.WORDS}') AS words FROM units),
paired AS (
  SELECT doc_id, unit, place, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs FROM worded WHERE len(words) > 1),
scored AS (
  SELECT doc_id, unit, place, license, 2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice
  FROM paired p JOIN templates t ON len(p.pairs) BETWEEN len(t.pairs) * {licenses.THRESHOLD} / (2 - {licenses.THRESHOLD}) AND len(t.pairs) * (2 - {licenses.THRESHOLD}) / {licenses.THRESHOLD}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license) AS best FROM scored WHERE dice >= {licenses.THRESHOLD})
SELECT doc_id, unit, place::INTEGER AS place, license, dice FROM ranked WHERE best = 1
"""


@query("op1_license_scan", LICENSE_SQL)
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))


# --- 12: fill-in-the-middle ------------------------------------------------------------------

INFILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 AS plain,
         ('0x' || h[25:32])::BIGINT % 100 < 20 AS spm
  FROM d),
cut AS (
  SELECT *, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
         substr(t, 1, least(a, b)) AS prefix, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(t, greatest(a, b) + 1) AS suffix
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN p END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN m END::BIGINT AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


@query("op12_fill_in_middle", INFILL_SQL)
def fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    done = infilling.transform(table(spark, folder, "documents").select("doc_id", "text"))
    named = done.withColumnsRenamed({"prefix_units": "prefix_chars", "middle_units": "middle_chars"}).withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    return infilling.restore(named).withColumn("restored_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


# --- 13: BPE by merge ranks --------------------------------------------------------------------


@query("op13_bpe_merges")
def bpe_merges(spark: SparkSession, folder: str) -> DataFrame:
    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    shared = merges.vocabulary(spark.sparkContext, definition)
    coded = merges.encode(table(spark, folder, "documents").select("doc_id", "text"), shared, decoded="decoded")  # one worker for each task, not two
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


# --- 11: importance resampling -------------------------------------------------------------------


@query("op11_importance_resampling")
def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    drawn = importance.resample(documents, table(spark, folder, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
