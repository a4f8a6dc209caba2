"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once over each whole text; the ledger keeps the measurements and one bit per failed
rule. A policy is a versioned set of rules: applying one, or measuring what each of its rules alone removes,
reads the ledger's bits and never the texts again.

Defined cases: a null, empty or blank text has no words, and so fails `short`; repeated rows are judged one by
one; an empty table gives an empty ledger; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words

#: Rule: failed when, as SQL over the measurements (the same text is Spark's and the check's). Its place is its bit.
RULES = {
    "short": "n_words < 50",
    "repeated_phrases": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BIT = {rule: 1 << k for k, rule in enumerate(RULES)}
#: A policy's version and the rules that it applies.
POLICIES = {"base-1": ("short", "repeated_phrases"), "web-1": tuple(RULES)}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are sorted as (hash, position) packed in
    one long, equal neighbours are compared word by word, and the sorted positions' union is measured."""
    n = F.size(w)

    def packed(span: Column) -> Column:  # span: a power of two above every position
        low = span - 1
        one = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))

        def repeated(s: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
                equal = [F.get(w, i + k) == F.get(w, j + k) for k in range(3)]
                return (a.bitwiseXOR(b) <= low) & (a.bitwiseXOR(b) >= 0) & equal[0] & equal[1] & equal[2]

            hits = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            spots = F.sort_array(F.transform(hits, lambda x: x.bitwiseAND(low)))
            start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end"))
            return F.aggregate(spots, start, lambda a, p: F.struct((a["sum"] + p + 3 - F.greatest(p, a["end"])).alias("sum"), (p + 3).alias("end")), lambda a: a["sum"])

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), one)), repeated)

    span = F.expr("1L") * F.pow(F.lit(2.0), F.ceil(F.log2(n + 1))).cast("long")
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(span, packed))


def _lines(text: Column) -> Column:
    """Lines with a word, and how many of them equal an earlier one."""
    own = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    again = lambda s: F.size(F.filter(s, lambda x, i: x == F.get(s, i - 1)))
    return let(F.sort_array(own), lambda s: F.struct(F.size(s).cast("long").alias("n_lines"), again(s).cast("long").alias("n_dup_lines")))


def rule_ledger(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, the measurements and fail_bits. Narrow: no shuffle, no Python."""
    text = F.coalesce(F.col("text"), F.lit(""))
    per_word = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")
    measured = docs.select("doc_id", per_word.alias("w"), _lines(text).alias("l"), symbols.alias("n_symbols"))
    flat = measured.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    bits = " | ".join(f"CASE WHEN {when} THEN {BIT[rule]}L ELSE 0L END" for rule, when in RULES.items())
    return flat.withColumn("fail_bits", F.expr(bits))


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with `kept`: true where no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that no other rule of the policy removes."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    sums = [F.count_if(f(BIT[r])).alias(f"{k}_{r}") for r in POLICIES[policy] for k, f in (("fails", lambda b: failed.bitwiseAND(F.lit(b)) != 0), ("only", lambda b: failed == b))]
    one = ledger.agg(F.count(F.lit(1)).alias("documents"), F.bit_or("fail_bits").alias("any_bits"), *sums)
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"fails_{r}").alias("fails"), F.col(f"only_{r}").alias("only_this")) for r in POLICIES[policy]))
    return one.select("documents", "any_bits", F.explode(rows).alias("r")).select("documents", "any_bits", "r.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "web-1")
    return ledger.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base-1"))) != 0)


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n >= 2 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN l ON d.doc_id = l.doc_id),
b AS (SELECT *, ({' | '.join(f"CASE WHEN {when} THEN {BIT[rule]}::BIGINT ELSE 0 END" for rule, when in RULES.items())}) AS fail_bits FROM m)
SELECT *, (fail_bits & {mask('web-1')}) = 0 AS kept, (fail_bits & {mask('base-1')}) <> 0 AS base_failed FROM b"""
