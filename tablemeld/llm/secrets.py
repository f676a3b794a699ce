"""Secret scans over an incremental blob ledger.

Texts are addressed by their content (SHA-256), so that every version of a path that was
ever seen is one blob, however many paths hold it.  A ledger table records which blob was
scanned by which rule version, with the spans found.  A scan looks only at pairs of blob and
rule version that the ledger lacks, appends them, and joins the findings back to all paths.
Everything is DataFrame work: spans come from splitting a text at its matches and adding up
the lengths of the pieces.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablemeld.llm.common import free_name
from tablemeld.storage import materialize, shared_folder


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``part`` has ``least`` characters.

    A change to a rule needs a new version; the ledger then scans all blobs again for it.
    """

    kind: str
    pattern: str
    least: int
    part: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: A private key: the header, the lines of an encrypted one, the body (base64, white space, escaped
#: line breaks; quotes and commas of source code before an END line) and the END line.  Without
#: END the body has to begin with 16 characters of base64, so that prose on a header stays.
_HEADER, _SPACE = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"\x20\x09-\x0D\\"
_FIELDS = rf"(?:[{_SPACE}rn]*[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:[A-Za-z0-9,\x20-]*){{0,4}}"
_PEM = rf"""{_HEADER}(?:{_FIELDS}(?:[A-Za-z0-9+/={_SPACE}"',;>#*]*-----END [A-Z ]{{0,40}}PRIVATE KEY-----|[{_SPACE}]*[A-Za-z0-9+/]{{16}}[A-Za-z0-9+/={_SPACE}]*))?"""
#: Further kinds that public scanners look for.
MORE = (
    Rule("pem", _PEM, 20, version=2),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 24),
)
RULES = BASE + MORE

SPANS = "array<struct<start: int, end: int>>"
FINDINGS = "blob string, rule string, spans array<struct<start: int, end: int>>"


def rule_spans(text: Column, rule: Rule) -> Column:
    """Code-point spans (end exclusive) of a rule's matches, in order; empty without a match."""
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    kept = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1 + rule.part))
    none = F.array().cast("array<struct<start: int, end: int, part: int>>")

    def place(found: Column, i: Column) -> Column:
        start = F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0)) + F.length(F.get(pieces, i))
        end = start + F.length(F.get(whole, i))
        return F.array_append(found, F.struct(start.alias("start"), end.alias("end"), F.length(F.get(kept, i)).alias("part")))

    placed = F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), none, place)
    long = F.transform(F.filter(placed, lambda x: x["part"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(rule.pattern), long).otherwise(F.array()).cast(SPANS)


def matches_any(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule can have a span in a text; never null."""
    return F.coalesce(functools.reduce(Column.__or__, [text.rlike(r.pattern) for r in rules], F.lit(False)), F.lit(False))


def blob_of(text: Column) -> Column:
    """The content address of a text; null texts are empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """Scanned pairs of blob and rule version in a folder that all executors share."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
        self.empty = True if folder is None else not self._exists()

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        if self.empty:
            return self.spark.createDataFrame([], FINDINGS)
        return self.spark.read.schema(FINDINGS).parquet(self.folder)

    def scan(self, documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan blobs of ``documents`` that the ledger lacks for some rule, and append them.

        An append is one Spark write, so a lost executor or a failed job leaves no part of it.
        Only texts that some rule matches are shuffled; of the others the address is enough.
        """
        content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        blobs = documents.select(blob_of(content).alias("blob"), F.when(matches_any(content, rules), content).alias("content")).groupBy("blob").agg(F.any_value("content").alias("content"))
        names = F.array(*[F.lit(r.name) for r in rules])
        if self.empty:
            unseen = blobs.withColumn("lacks", names)
        else:
            seen = self.rows().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            lacks = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
            unseen = blobs.join(seen, "blob", "left").withColumn("lacks", lacks).filter(F.size("lacks") > 0)
        spans = [
            F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("lacks", r.name), rule_spans(F.col("content"), r)).alias("spans"))
            for r in rules
        ]
        found = unseen.select("blob", F.inline(F.array(*spans))).filter(F.col("spans").isNotNull())
        found.write.mode("append").parquet(self.folder)
        self.empty = False

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, ``found``: spans of the given rule versions as (start, place of the rule, kind, end), sorted."""
        order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
        kind = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
        return (
            self.rows().filter(F.col("rule").isin([r.name for r in rules]) & (F.size("spans") > 0))
            .select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("place"), kind[F.col("rule")].alias("kind"), s["end"].alias("end"))).alias("one"))
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("one"))).alias("found"))
        )


def scan_secrets(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """Documents with ``secrets``: array of (start, place, kind, end), sorted by start, then rule.

    Every row of ``documents`` comes back once; null and empty texts hold nothing, copies share
    one scan, and an older column ``secrets`` is replaced.
    """
    ledger = ledger or Ledger(documents.sparkSession)
    ledger.scan(documents, text, rules)
    documents = documents.drop("secrets")
    address, other = free_name(documents, "blob"), free_name(documents, "found_blob")
    # written first: a join of two plain shuffles can be split where one blob has very many paths
    found = materialize(ledger.findings(rules), "secret-findings").select(F.col("blob").alias(other), F.col("found").alias("secrets"))
    # a text that no rule matches has no findings to meet, and stays where it is
    content = F.col(f"`{text}`").cast("string")
    matched = matches_any(content, rules)
    joined = documents.filter(matched).withColumn(address, blob_of(content)).join(found, F.col(address) == F.col(other), "left").drop(address, other)
    none = F.array().cast(joined.schema["secrets"].dataType)
    return joined.withColumn("secrets", F.coalesce("secrets", none)).unionByName(documents.filter(~matched).withColumn("secrets", none))


def redact(text: Column, secrets: Column, mask: str = "[secret]") -> Column:
    """The text with its secrets masked; overlapping and touching spans share one mask."""
    def merge(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        alone = F.array_append(done, F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), joined).otherwise(alone)

    merged = F.aggregate(secrets, F.array().cast(SPANS), merge)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    cut = F.aggregate(merged, state, lambda s, m: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit(mask)).alias("out"), m["end"].alias("at")))
    return F.when(F.size(secrets) == 0, text).otherwise(F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text))))
