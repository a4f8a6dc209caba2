"""Queries of record linkage, lookups, health, history, carry-forward and the publish gate."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import linkage
from ..operators.gate import violations
from ..operators.normalize import still_listable
from ..operators.runs import carry_forward, history_entry, sparkline, totals
from .registry import register
from .windows import _E, _TODAY, _reasons, events


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_events(spark, sf_dir):
    """Documents read as listings: the title is the first line, the day comes from the id."""
    d = _t(spark, sf_dir, "documents")
    none = F.lit(None)
    return d.select(
        F.col("doc_id").cast("string").alias("id"), "source", F.col("doc_id").alias("seq"), F.split("text", "\n")[0].alias("title"),
        F.concat(F.lit("https://www.example.org/"), F.md5(F.col("text").cast("binary")), F.lit("/?utm_source=x")).alias("url"), F.date_add(F.lit("2026-10-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        F.when(F.col("doc_id") % 3 > 0, F.format_string("%02d:30", (F.col("doc_id") % 4 + 17).cast("int"))).alias("time"), none.cast("timestamp").alias("start"), none.cast("string").alias("location"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("description"), F.array().cast("array<string>").alias("speakers"), none.cast("boolean").alias("free"), none.cast("boolean").alias("online"),
        none.cast("string").alias("price"), F.array().cast("array<struct<source:string,url:string>>").alias("also_at"),
    )


@register("exact_dedupe_documents", "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedupe_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_RICH = """(SELECT doc_id, md5(text) AS k, CAST(doc_id % 30 AS INT) AS day, source, CASE WHEN doc_id % 3 > 0 THEN lpad((doc_id % 4 + 17)::VARCHAR, 2, '0') || ':30' END AS time, CASE WHEN doc_id % 2 = 0 THEN text END AS description,
CASE WHEN doc_id % 3 > 0 THEN 4 ELSE 0 END + least(coalesce(length(CASE WHEN doc_id % 2 = 0 THEN text END), 0) / 80, 4.0) AS rich FROM documents)"""


@register("richness_score", f"SELECT doc_id, rich::DOUBLE AS richness FROM {_RICH}")
def richness_score(spark, sf_dir):
    return documents_as_events(spark, sf_dir).select(F.col("seq").alias("doc_id"), linkage.richness().cast("double").alias("richness"))


@register("survivor_max_by", f"SELECT k, day, arg_max(doc_id, rich * 1e9 - doc_id) AS doc_id FROM {_RICH} GROUP BY k, day")
def survivor_max_by(spark, sf_dir):
    e = documents_as_events(spark, sf_dir).withColumn("rich", linkage.richness())
    best = e.groupBy(F.substring("url", 25, 32).alias("k"), (F.col("seq") % 30).cast("int").alias("day")).agg(F.max_by("seq", F.struct(F.col("rich"), -F.col("seq"))).alias("doc_id"))
    return best


_TOKENS = "list_distinct(list_filter(string_split(regexp_replace(regexp_replace(strip_accents(lower(split_part(text, chr(10), 1))), '[''’]s\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains(['{}'], w)))"


@register("title_token_pairs", f"""WITH t AS (SELECT doc_id, source, lang, {_TOKENS.format("', '".join(text.X.STOPWORDS))} AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS na, len(b.w) AS nb FROM t a JOIN t b ON a.source = b.source AND a.lang = b.lang AND a.doc_id < b.doc_id)
SELECT a, b FROM p WHERE least(na, nb) >= 2 AND CASE WHEN least(na, nb) >= 3 THEN greatest(shared / (na + nb - shared), shared / least(na, nb) * 0.9) ELSE shared / (na + nb - shared) END >= 0.8""")
def title_token_pairs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    e = d.select(F.col("doc_id").alias("seq"), "source", "lang", text.title_tokens(text.fold(F.substring_index("text", "\n", 1))).alias("tokens")).filter(F.size("tokens") >= 2)
    p = linkage.similar_pairs(e, "source", "lang")
    return p.select(F.least("a.seq", "b.seq").alias("a"), F.greatest("a.seq", "b.seq").alias("b"))


_KEEP = """list_reduce(list(struct_pack(seq := doc_id, source := source, time := time, description := description, also := 0) ORDER BY doc_id), lambda k, e: struct_pack(
 seq := k.seq, source := CASE WHEN {e} > {k} THEN e.source ELSE k.source END,
 time := CASE WHEN k.time IS NULL THEN e.time WHEN e.time IS NULL THEN k.time ELSE least(k.time, e.time) END,
 description := CASE WHEN {e} > {k} THEN coalesce(e.description, k.description) ELSE coalesce(k.description, e.description) END,
 also := CASE WHEN {e} > {k} THEN 0 ELSE k.also END + CASE WHEN k.source IS DISTINCT FROM e.source THEN 1 ELSE 0 END))"""
_RICH_OF = "(CASE WHEN {0}.time IS NOT NULL THEN 4 ELSE 0 END + least(coalesce(length({0}.description), 0) / 80, 4.0))"
_TITLE_TOKENS = _TOKENS.replace("split_part(text, chr(10), 1)", "title")
#: Both passes in order. x is pass 1: the copies of a text on one day, folded. p are the pairs of the same event, in the
#: order in which one run meets them; s walks them one by one with what each record holds by then.
_MERGED = f"""WITH RECURSIVE d AS (SELECT doc_id, source, text, doc_id % 30 AS day, CASE WHEN doc_id % 3 > 0 THEN lpad((doc_id % 4 + 17)::VARCHAR, 2, '0') || ':30' END AS time, CASE WHEN doc_id % 2 = 0 THEN text END AS description FROM documents),
x AS MATERIALIZED (SELECT r.seq AS seq, r.source AS source, r.time AS time, length(r.description) AS said, r.also AS also, day, title FROM (SELECT day, split_part(text, chr(10), 1) AS title, {_KEEP.format(e=_RICH_OF.format("e"), k=_RICH_OF.format("k"))} AS r FROM d WHERE text IS NOT NULL GROUP BY text, day)
 UNION ALL SELECT doc_id, source, time, NULL, 0, day, NULL FROM d WHERE text IS NULL),
t AS (SELECT seq, source, day, time, {_TITLE_TOKENS.format("', '".join(text.X.STOPWORDS))} AS w FROM x WHERE title IS NOT NULL),
c AS (SELECT a.seq AS a, b.seq AS b, a.source IS NOT DISTINCT FROM b.source AS one, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS na, len(b.w) AS nb FROM t a JOIN t b ON a.day = b.day AND a.seq < b.seq WHERE len(a.w) >= 2 AND len(b.w) >= 2 AND list_has_any(a.w, b.w)),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b) AS k, a, b, one FROM c WHERE CASE WHEN least(na, nb) >= 3 THEN greatest(shared / (na + nb - shared), shared / least(na, nb) * 0.9) ELSE shared / (na + nb - shared) END >= CASE WHEN one THEN 0.95 ELSE 0.8 END),
u AS (SELECT a AS seq FROM p UNION SELECT b FROM p),
s(k, gone, times, said, also) AS (
 SELECT 0::BIGINT, CAST([] AS BIGINT[]), coalesce(map_from_entries(list((x.seq, time))), MAP {{}}), coalesce(map_from_entries(list((x.seq, said))), MAP {{}}), coalesce(map_from_entries(list((x.seq, also))), MAP {{}}) FROM x JOIN u ON x.seq = u.seq
 UNION ALL SELECT k, CASE WHEN ok THEN list_append(gone, lost) ELSE gone END, CASE WHEN ok THEN map_concat(times, MAP {{kept: coalesce(times[kept], times[lost])}}) ELSE times END,
  CASE WHEN ok THEN map_concat(said, MAP {{kept: coalesce(said[kept], said[lost])}}) ELSE said END, CASE WHEN ok THEN map_concat(also, MAP {{kept: (also[kept] + also[lost] + CASE WHEN one THEN 0 ELSE 1 END)::INTEGER}}) ELSE also END
 FROM (SELECT next AS k, one, gone, times, said, also, CASE WHEN richer THEN b ELSE a END AS kept, CASE WHEN richer THEN a ELSE b END AS lost, NOT list_contains(gone, a) AND NOT list_contains(gone, b) AND CASE WHEN one THEN times[a] IS NOT DISTINCT FROM times[b]
   ELSE coalesce(abs((left(times[a], 2)::INT * 60 + right(times[a], 2)::INT) - (left(times[b], 2)::INT * 60 + right(times[b], 2)::INT)) <= 30, true) END AS ok
  FROM (SELECT gone, times, said, also, p.k AS next, a, b, one, CASE WHEN times[b] IS NULL THEN 0 ELSE 4 END + least(coalesce(said[b], 0) / 80, 4) > CASE WHEN times[a] IS NULL THEN 0 ELSE 4 END + least(coalesce(said[a], 0) / 80, 4) AS richer FROM s JOIN p ON p.k = s.k + 1) q)
)"""
_LAST = "(SELECT * FROM s ORDER BY k DESC LIMIT 1)"


@register("fuzzy_dedupe_greedy", f"""{_MERGED} SELECT seq, source, title, DATE '2026-10-01' + day::INT AS date, CASE WHEN map_contains(l.times, seq) THEN l.times[seq] ELSE x.time END AS time, CASE WHEN map_contains(l.also, seq) THEN l.also[seq] ELSE x.also END AS elsewhere
FROM x, {_LAST} l WHERE NOT list_contains(l.gone, seq)""")
def fuzzy_dedupe_greedy(spark, sf_dir):
    """Both passes over documents read as listings."""
    kept = linkage.dedupe(documents_as_events(spark, sf_dir), descriptions=False)
    return kept.select("seq", "source", "title", "date", "time", F.size("also_at").alias("elsewhere"))


@register("dedupe_counts_documents", f"""{_MERGED} SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM x) AS exact_duplicates, len(l.gone) AS cross_source_duplicates, (SELECT count(*) FROM d) - (SELECT count(*) FROM x) + len(l.gone) AS duplicates_removed FROM {_LAST} l""")
def dedupe_counts_documents(spark, sf_dir):
    """How many records each pass merges away."""
    return linkage.dedupe_counts(documents_as_events(spark, sf_dir))


@register("lookup_left_enrich", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def lookup_left_enrich(spark, sf_dir):
    o, c, n = (_t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n.filter("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@register("semi_join_flag", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS large FROM customer")
def semi_join_flag(spark, sf_dir):
    large = _t(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_custkey").distinct()
    return _t(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("large"))


@register("anti_join_unknown", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_unknown(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    return _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def _runs(spark, sf_dir):
    """One run a day: what each source brought, and its status by count."""
    e = events(spark, sf_dir).groupBy("date", "source").agg(F.count(F.lit(1)).alias("n"))
    status = F.when((F.col("n") % 7) == 0, "error").when((F.col("n") % 11) == 0, "empty").otherwise("ok")
    return e.withColumn("status", status)


_RUNS = f"(SELECT date, source, n, CASE WHEN n % 7 = 0 THEN 'error' WHEN n % 11 = 0 THEN 'empty' ELSE 'ok' END AS status FROM (SELECT date, source, count(*) AS n FROM {_E} GROUP BY date, source))"


@register("status_case", f"SELECT date, source, n, status FROM {_RUNS}")
def status_case(spark, sf_dir):
    return _runs(spark, sf_dir)


@register("totals_count_if", f"SELECT date, count(*) AS sources, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'error') AS failed, sum(n)::BIGINT AS events FROM {_RUNS} GROUP BY date")
def totals_count_if(spark, sf_dir):
    return totals(_runs(spark, sf_dir), "date")


@register("history_counts_map", f"SELECT date, source, CASE status WHEN 'error' THEN -1 WHEN 'empty' THEN 0 ELSE n END AS n FROM {_RUNS}")
def history_counts_map(spark, sf_dir):
    return history_entry(_runs(spark, sf_dir), "date").select("date", F.explode("counts").alias("source", "n"))


@register("last_n_runs", f"SELECT date, events FROM (SELECT date, sum(n)::BIGINT AS events FROM {_RUNS} GROUP BY date) ORDER BY date DESC LIMIT 10")
def last_n_runs(spark, sf_dir):
    return totals(_runs(spark, sf_dir), "date").select("date", "events").orderBy(F.desc("date")).limit(10)


@register("sparkline_scale", f"""SELECT source, date, CASE WHEN status = 'error' THEN 100 ELSE greatest(8, round(CASE WHEN status = 'empty' THEN 0 ELSE n END / greatest(1, max(CASE WHEN status = 'ok' THEN n ELSE 0 END) OVER (PARTITION BY source)) * 100))::INT END AS height FROM {_RUNS}""")
def sparkline_scale(spark, sf_dir):
    return sparkline(_runs(spark, sf_dir))


@register("carry_forward_union", f"""WITH g AS (SELECT * FROM {_RUNS}),
e AS (SELECT event_id, source, date, date + (event_id % 12)::INT AS listed, event_id % 13 = 0 AS online, event_id % 10 = 3 OR event_id % 17 = 0 AS closed FROM {_E}),
c AS (SELECT f.source, f.date AS day, g.date AS good FROM g f ASOF JOIN (SELECT source, date FROM g WHERE status <> 'error') g ON f.source = g.source AND f.date >= g.date WHERE f.status = 'error')
SELECT event_id, e.source, e.date AS day, listed AS date, false AS carried, (event_id % 5 = 0)::INT AS elsewhere FROM e JOIN g ON e.source = g.source AND e.date = g.date WHERE g.status <> 'error'
UNION ALL SELECT event_id, e.source, day, listed, true, 0 FROM c JOIN e ON e.source = c.source AND e.date = c.good WHERE day - good <= 7 AND listed >= day AND listed < day + 45 AND NOT online AND NOT closed""")
def carry_forward_union(spark, sf_dir):
    """A run a day: each event is a listing of some days ahead, and a failed source shows its last good run."""
    every = lambda n, k=0: F.col("event_id") % n == k
    at = lambda hour: F.col("date").cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    given = {
        "title": F.when(every(10, 3), "Autumn Exhibition").otherwise("A talk"), "description": F.when(every(17), "For members only"), "location": F.lit("Senate House, London"),
        "online": every(13), "also_at": F.when(every(5), F.array(F.struct(F.lit("b").alias("source"), F.lit("/b").alias("url")))).otherwise(F.array().cast("array<struct<source:string,url:string>>")),
    }
    seen = events(spark, sf_dir).select("event_id", "source", "date").withColumns({"scraped_at": at(9), "at": at(10)}).withColumns(given).withColumn("date", F.date_add("date", (F.col("event_id") % 12).cast("int")))
    runs_ = _runs(spark, sf_dir).select("source", "status", at(9).alias("scraped_at"), at(10).alias("at"))
    good = seen.join(runs_.filter("status <> 'error'").select("source", "scraped_at"), ["source", "scraped_at"], "left_semi")
    got = carry_forward(good.drop("scraped_at"), runs_.filter("status = 'error'").select("source", "at"), good.drop("at"), still_listable(good, F.col("at"), 45))
    return got.select("event_id", "source", dates.london_date(F.col("at")).alias("day"), "date", "carried", F.size("also_at").alias("elsewhere"))


@register("validation_violations", f"""SELECT 'bad-value' AS rule, event_id AS entity FROM {_E} WHERE value IS NULL OR value < 0 UNION ALL SELECT 'far-date', event_id FROM {_E} WHERE date >= {_TODAY} + 14
UNION ALL SELECT 'late-price', event_id FROM {_E} WHERE free AND time >= '22:00'""")
def validation_violations(spark, sf_dir):
    checks = {"bad-value": F.col("value").isNull() | (F.col("value") < 0), "far-date": F.col("date") >= F.date_add(F.lit("2024-01-10").cast("date"), 14), "late-price": F.col("free") & (F.col("time") >= "22:00")}
    return violations(events(spark, sf_dir), checks, "event_id")


@register("sorted_lag_check", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE ts < before")
def sorted_lag_check(spark, sf_dir):
    e = events(spark, sf_dir)
    before = F.lag("instant").over(W.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("before", before).filter("instant < before").select("event_id")


@register("unique_id_check", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def unique_id_check(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register("union_distinct_candidates", "SELECT host FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages UNION SELECT 'extra.example.org')")
def union_distinct_candidates(spark, sf_dir):
    hosts = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return hosts.union(spark.range(1).select(F.lit("extra.example.org").alias("host"))).distinct()


@register("explode_sessions", "SELECT conv_id, turn, nth, word FROM (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS nth FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))")
def explode_sessions(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("nth", "word")).select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), "word")


@register("first_wins_distinct", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations) WHERE nth = 1")
def first_wins_distinct(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn"))
    return _t(spark, sf_dir, "conversations").withColumn("nth", nth).filter("nth = 1").select("conv_id", "turn", "role")


@register("kept_after_rules", f"SELECT source, count(*) AS scraped, count(*) FILTER (reason IS NULL) AS kept FROM (SELECT source, CASE WHEN event_id % 97 = 0 THEN 'invalid' WHEN date < {_TODAY} THEN 'past' WHEN source = 'purchase' AND value > 90 THEN 'members-only' WHEN date >= {_TODAY} + 14 THEN 'beyond-horizon' WHEN source = 'scroll' THEN 'not-a-talk' END AS reason FROM {_E}) GROUP BY source")
def kept_after_rules(spark, sf_dir):
    return _reasons(events(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("scraped"), F.count_if(F.col("reason").isNull()).alias("kept"))
