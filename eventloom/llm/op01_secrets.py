"""Secret scans over an incremental ledger of blobs.

Every version of every file is content-addressed by the SHA-256 of its text. A ledger holds, for each
(blob, rule version), what that blob contains; only pairs that the ledger lacks are scanned, each blob once
however many paths share it, and findings are joined back to all paths. Rules come in sets, each with a version of its
own, so that a new set is scanned alone; all sets that a blob lacks are scanned in one pass over it. `Ledger` stores the
rows in a folder that only grows: an increment appends what it scanned.

Defined cases: a null text counts as empty; equal texts share one scan; a version of the rules that the ledger
has never seen scans every blob again; repeated rows of the ledger count once; an empty table gives an empty result;
extra columns are left alone, whatever their names: they travel inside one struct, apart from the columns made here;
very long texts are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, packed, shared_dir, table, unpacked

LEDGER = "blob_id string, rule_version string, findings array<struct<kind:string,start:int,end:int>>"


def _either(letters: str) -> str:
    """The letters in either case, without the wider folding that a case flag brings in some engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in letters)


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and the fewest characters that `group` of a match must have. A match doesn't follow one of
    the characters of `after_none`: what begins inside a long run is not tried again at each of its places."""

    kind: str
    pattern: str
    group: int
    least: int
    after_none: str = ""

    @property
    def regex(self) -> str:
        return rf"(?<![{self.after_none}]){self.pattern}" if self.after_none else self.pattern


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
#: The base kinds, then those that are added to them; the order breaks ties between spans of equal start.
BASE = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, "A-Za-z0-9_-"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
RULES, RULE_VERSION = BASE + MORE, "3"
#: The sets that the query scans, each under a version of its own.
RULE_SETS = {"base-1": BASE, "more-2": MORE}
#: What is masked: a key goes from its BEGIN line to its END line, or to the end of the text where that is missing.
_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"
MASKED, MASKED_VERSION = tuple(Rule("pem", _KEY, 0, 0) if r.kind == "pem" else r for r in RULES), "4"


def find_secrets(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each rule, in code points; matches that are too short are dropped."""
    found = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.regex, text) if len(m[r.group]) >= r.least]
    return [(rules[k].kind, start, end) for start, k, end in sorted(found)]


def with_blob_id(versions: DataFrame, text: str = "text") -> DataFrame:
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for the blobs of versions(blob_id, text) that the ledger lacks under this rule version."""
    return scan_unseen_sets(versions, ledger, {rule_version: rules})


def scan_unseen_sets(versions: DataFrame, ledger: DataFrame | None, rule_sets: dict[str, tuple[Rule, ...]]) -> DataFrame:
    """Ledger rows for the pairs of a blob of versions(blob_id, text) and a rule set that the ledger lacks."""
    blobs = versions.groupBy("blob_id").agg(F.first(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    every = F.array(*map(F.lit, rule_sets))
    lacking = every
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version").isin(*rule_sets)).groupBy("blob_id").agg(F.collect_set("rule_version").alias("seen"))
        blobs = blobs.join(seen, "blob_id", "left")
        lacking = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.withColumn("lacking", lacking).filter(F.size("lacking") > 0)

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [(blob, version, [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(text, rule_sets[version])]) for blob, text, lacking in zip(*(batch.column(c).to_pylist() for c in ("blob_id", "text", "lacking")), strict=True) for version in lacking]
            blob, version, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(version, pa.string()), pa.array(found, kind)], names=["blob_id", "rule_version", "findings"])

    return mapped(blobs.select("blob_id", "text", "lacking"), scan, LEDGER)


class Ledger:
    """The ledger as a table in a folder. An increment appends the rows that it scanned, and no other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else None

    def update(self, versions: DataFrame, rule_sets: dict[str, tuple[Rule, ...]] | None = None) -> DataFrame:
        """All rows, after the blobs of versions(blob_id, text) were scanned for what was unseen of them. A run that was
        broken off and is repeated scans what its first attempt didn't store."""
        scan_unseen_sets(versions, self.rows(), rule_sets or RULE_SETS).write.mode("append").parquet(self.path)
        return self.rows()


def findings_by_path(versions: DataFrame, ledger: DataFrame, *rule_versions: str) -> DataFrame:
    """Every row of versions(.., blob_id) with the findings of its blob under these rule versions, by start and kind."""
    own = ledger.filter(F.col("rule_version").isin(*(rule_versions or (RULE_VERSION,)))).dropDuplicates(["blob_id", "rule_version"])
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    keyed = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    merged = F.array_sort(F.flatten(F.collect_list(keyed)))  # as many lists as rule versions
    own = own.groupBy("blob_id").agg(F.transform(merged, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))
    return versions.join(own, "blob_id", "left")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with each stretch of found spans replaced by mark and n_chars brought in line; no row is dropped."""
    names = docs.columns
    rows = with_blob_id(packed(docs, "text"))
    ledger = scan_unseen(rows.select("blob_id", "text"), rules=MASKED, rule_version=MASKED_VERSION).filter(F.size("findings") > 0)
    piece = lambda start, n: F.substring(F.col("text"), start + 1, n)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, f: F.struct(
        F.when(f["start"] >= a["at"], F.concat(a["out"], piece(a["at"], f["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], f["end"]).alias("at"),
    )
    rest = lambda a: F.concat(a["out"], piece(a["at"], F.length(F.col("text"))))
    text = F.when(F.col("findings").isNull(), F.col("text")).otherwise(F.aggregate("findings", start, step, rest))
    found = findings_by_path(rows, ledger, MASKED_VERSION).select("row", F.col("findings").isNotNull().alias("hit"), text.alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in names:
        made["n_chars"] = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(found, names, **made)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_blob_id(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ledger = Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}").update(docs.select("blob_id", "text"))
    found = findings_by_path(docs.select("doc_id", "blob_id"), ledger, *RULE_SETS)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return found.select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), "blob_id",
    )


def _sql_spans(rule: Rule, order: int) -> str:
    """The rule's spans in SQL: matches are wrapped in two private-use characters, and lengths between them add up to positions."""
    a, b, pattern = "chr(57344)", "chr(57345)", rule.pattern.replace("'", "''")
    whole, marked = (f"(^|[^{rule.after_none}])({pattern})", f"'\\1' || {a} || '\\2' || {b}") if rule.after_none else (f"({pattern})", f"{a} || '\\1' || {b}")
    parts = f"string_split(regexp_replace(t, '{whole}', {marked}, 'g'), {a})"
    return f"""SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, st, st + length(m) AS en FROM (
      SELECT doc_id, length(p[1]) + coalesce(list_sum(list_transform(p[2:i-1], lambda x: length(x) - 1)), 0) AS st, split_part(p[i], {b}, 1) AS m
      FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT doc_id, {parts} AS p FROM d))) s
      WHERE length({f"regexp_extract(m, '{pattern}', {rule.group})" if rule.group else "m"}) >= {rule.least}"""


_TEXT = "coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k){}, '')"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  sha256({_TEXT.format(f" FILTER (k < {len(BASE)})")}) AS base_sha256, {_TEXT.format('')} AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)},
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob_id
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
