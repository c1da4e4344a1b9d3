"""Incremental secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet table, holds the findings of each
pair of blob and rule version; a scan reads only blobs without an entry for the present rules, appends their findings and
joins the ledger back to all paths that ever held the blob. All steps are DataFrame functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroloom.llm.text import whole_texts
from hydroloom.session import cut_lineage, scratch_path

LEDGER = "sha string, rule_version string, findings array<struct<kind:string,rank:int,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match counts when its group `part` has at least `least` characters."""

    kind: str
    pattern: str
    part: int
    least: int


# The three kinds of the contract. A lower bound stands in the pattern where no shorter match can hide a
# later one; the assignment's bound must be tested after matching.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)


def rule_version(rules: tuple[Rule, ...]) -> str:
    """Version of a rule set: a digest of its content."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def rule_findings(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points: matches and the pieces between them alternate, so lengths add up to positions."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part))
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), parts.alias("part"))
    empty = F.array().cast("array<struct<kind:string,rank:int,start:long,end:long>>")
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        lambda held, p: F.struct(
            (held["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).alias("at"),
            F.when(
                F.length(p["part"]) >= rule.least,
                F.concat(held["spans"], F.array(F.struct(
                    F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"),
                    (held["at"] + F.length(p["gap"])).alias("start"),
                    (held["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"),
                ))),
            ).otherwise(held["spans"]).alias("spans"),
        ),
        lambda held: held["spans"],
    )
    return F.when(text.rlike(rule.pattern), walked).otherwise(empty)


def scan_text(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All findings of a text by start, then in the order of the rules."""
    spans = F.concat(*[rule_findings(text, rule, rank) for rank, rule in enumerate(rules)])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.transform(ordered, lambda s: F.struct(
        s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`; an empty one where nothing has been written yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores behind it while a column has it (in either case)."""
    held = {c.lower() for c in taken}
    while name in held:
        name += "_"
    return name


def scan_versions(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every version: the columns of `versions` but `text`, then `sha, findings`.

    Only blobs that the ledger has not seen with these rules are scanned; they are appended to it. One text of equal ones
    meets the others before the shuffle (partial aggregation), so a hot blob is one row per task. A null text is the
    empty blob. Several runs must not append to one ledger at the same time; a run that is repeated finds its blobs there.
    A column of the caller named `sha` or `findings` stays as it is; the result's own then ends in an underscore.
    """
    spark = versions.sparkSession
    version = rule_version(rules)
    texts = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    blobs = texts.groupBy("sha").agg(F.first("text").alias("text"))
    seen = open_ledger(spark, ledger_path).filter(F.col("rule_version") == version).select("sha")
    (
        blobs.join(seen, "sha", "left_anti")
        .select("sha", F.lit(version).alias("rule_version"), scan_text(F.col("text"), rules).alias("findings"))
        .write.mode("append").parquet(ledger_path)
    )
    own = [c for c in versions.columns if c != "text"]
    sha, findings = _free_name("sha", own), _free_name("findings", own)
    # Blobs without findings need no join: whatever finds no partner has none.
    hits = open_ledger(spark, ledger_path).filter((F.col("rule_version") == version) & (F.size("findings") > 0))
    # A table of its own, so that adaptive execution can split the join on a hot blob.
    hits = cut_lineage(hits.groupBy(F.col("sha").alias(sha)).agg(F.first("findings").alias(findings)), "secret-hits")
    paths = versions.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    empty = F.array().cast("array<struct<kind:string,rank:int,start:long,end:long>>")
    return paths.join(hits, sha, "left").withColumn(findings, F.coalesce(findings, empty)).select(*[f"`{c}`" for c in own], sha, findings)


def document_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """`doc_id, n_assign, n_access, n_hex, base_sha256, spans` of every document (one path with one version each).

    The ledger adds no spans of its own, so `spans` lists the base ones. Without `ledger_path` the scan keeps a new ledger
    in the shared folder. Repeated rows have equal results; an empty table gives none.
    """
    path = ledger_path or scratch_path(docs.sparkSession, "secret-ledger")
    found = scan_versions(whole_texts(docs), path)
    line = F.array_join(
        F.transform("findings", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(findings, s -> s.kind = '{rule.kind}')) as long)").alias(f"n_{rule.kind}") for rule in RULES],
        F.sha2(line, 256).alias("base_sha256"),
        line.alias("spans"),
    )
