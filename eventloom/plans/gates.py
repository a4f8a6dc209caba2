"""Queries of the publish gate. Orders are read as published records, customers as sources; the rules are broken at
places that the tables' own keys give, and the SQL judges the same rows by rules of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import gate, linkage
from .registry import register
from .windows import _E, _TODAY, events

# --- records ----------------------------------------------------------------------------------------------------

_PUBLISHED = """(SELECT k, source, st + CASE WHEN k % 29 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS start, CAST(wall AS DATE) AS date, CASE WHEN k % 13 = 0 THEN '25:00' ELSE strftime(wall, '%H:%M') END AS time, st,
 CASE WHEN k % 41 = 0 THEN left(sha1('order|same'), 12) ELSE left(sha1('order|' || k), CASE WHEN k % 50 = 0 THEN 11 ELSE 12 END) END AS id, CASE WHEN k % 7 = 0 THEN 'Hi' WHEN k % 9 = 0 THEN 'A <b>bold</b> talk' ELSE 'A talk' END AS title,
 CASE WHEN k % 11 = 0 THEN '/o/' || k ELSE 'https://www.example.org/o/' || (k // 2) || CASE WHEN k % 2 = 1 THEN '?utm_source=mail' ELSE '/' END END AS url, CASE WHEN k % 11 = 0 THEN '/o/' || k ELSE 'https://example.org/o/' || (k // 2) END AS link,
 CASE WHEN k % 19 <> 0 THEN ['Ada'] END AS speakers, repeat('d', CASE WHEN k % 23 = 0 THEN 501 ELSE 500 END) AS description
FROM (SELECT *, st AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS wall FROM (SELECT o_orderkey AS k, o_orderpriority AS source, TIMESTAMP '1992-01-01 10:00:00' + to_days((o_orderkey // 64)::INT) + to_minutes((o_orderkey % 64) * 5) AS st FROM orders)))"""


def published(spark, sf_dir):
    """Every order a published record, in the order of its key."""
    k = F.col("position")
    every = lambda n: k % n == 0
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("source"))
    o = o.withColumn("st", F.timestamp_seconds(F.unix_timestamp(F.lit("1992-01-01 10:00:00").cast("timestamp")) + F.floor(k / 64) * 86400 + (k % 64) * 300))
    digest = lambda of: F.sha1(F.concat(F.lit("order|"), of).cast("binary"))
    return o.select(
        "position", "source", F.when(every(41), F.substring(digest(F.lit("same")), 1, 12)).otherwise(F.substring(digest(k.cast("string")), F.lit(1), F.when(every(50), 11).otherwise(12))).alias("id"),
        F.when(every(7), "Hi").when(every(9), "A <b>bold</b> talk").otherwise("A talk").alias("title"),
        F.when(every(11), F.concat(F.lit("/o/"), k)).otherwise(F.concat(F.lit("https://www.example.org/o/"), F.floor(k / 2), F.when(k % 2 == 1, "?utm_source=mail").otherwise("/"))).alias("url"),
        dates.london_date(F.col("st")).alias("date"), F.when(every(13), "25:00").otherwise(dates.london_time(F.col("st"))).alias("time"),
        (F.col("st") + F.when(every(29), F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))).alias("start"),
        F.when(~every(19), F.array(F.lit("Ada"))).alias("speakers"), F.repeat(F.lit("d"), F.when(every(23), 501).otherwise(500)).alias("description"),
    )


@register("gate_orders", f"""WITH e AS (SELECT * FROM {_PUBLISHED})
SELECT 'bad-id' AS rule, k AS entity FROM e WHERE NOT regexp_full_match(id, '[0-9a-f]{{12}}') UNION ALL SELECT 'unknown-source', k FROM e WHERE source = '1-URGENT'
UNION ALL SELECT 'bad-title', k FROM e WHERE length(title) < 3 OR regexp_matches(title, '<[A-Za-z/]') UNION ALL SELECT 'bad-url', k FROM e WHERE NOT regexp_matches(url, '^https?://')
UNION ALL SELECT 'bad-time', k FROM e WHERE NOT regexp_full_match(time, '([01][0-9]|2[0-3]):[0-5][0-9]') UNION ALL SELECT 'no-speakers-list', k FROM e WHERE speakers IS NULL UNION ALL SELECT 'long-description', k FROM e WHERE length(description) > 500
UNION ALL SELECT 'start-disagrees', k FROM e WHERE try_cast(date || ' ' || time AS TIMESTAMP) IS NULL OR (try_cast(date || ' ' || time AS TIMESTAMP) AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC' <> start
UNION ALL SELECT 'duplicate-id', k FROM (SELECT k, row_number() OVER (PARTITION BY id ORDER BY k) AS nth FROM e) WHERE nth > 1 UNION ALL SELECT 'duplicate-page', k FROM (SELECT k, row_number() OVER (PARTITION BY link, date ORDER BY k) AS nth FROM e) WHERE nth > 1
UNION ALL SELECT 'not-sorted', k FROM (SELECT k, start, lag(start) OVER (ORDER BY k) AS before FROM e) WHERE start < before""")
def gate_orders(spark, sf_dir):
    """The gate over every order, compared with its neighbours across stretches of 1,000 positions."""
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("id")).distinct().filter("id <> '1-URGENT'")
    return gate.event_violations(published(spark, sf_dir), known, stretch=1000)


@register("listing_positions_orders", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, title, o_orderkey) - 1 AS position FROM (SELECT o_orderkey, o_orderdate, 'talk ' || (o_orderkey % 7) AS title FROM orders)""")
def listing_positions_orders(spark, sf_dir):
    """Every order's place in the published list: by start, then by title."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("start"), F.concat(F.lit("talk "), (F.col("o_orderkey") % 7).cast("string")).alias("title"))
    return linkage.listing_positions(o).select("o_orderkey", "position")


# --- a run's tables against each other --------------------------------------------------------------------------

_MADE = "TIMESTAMP '1998-01-01 06:00:00'"
_HEALTH = f"""(SELECT c_custkey AS source, CASE WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'ok' END AS status, coalesce(n, 0) + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS count, {_MADE} AS last_ok_at FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def customers_health(spark, sf_dir):
    """Customers as sources with what a run says of them, some of it wrong."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet").join(n, "c_custkey", "left"), F.col("c_custkey")
    count = F.coalesce("n", F.lit(0)) + F.when(k % 17 == 0, 1).otherwise(0)
    return c.select(k.alias("id"), F.when(k % 7 == 0, "error").otherwise("ok").alias("status"), count.alias("count"), F.lit("1998-01-01 06:00:00").cast("timestamp").alias("last_ok_at"))


@register("gate_reconciled", f"""WITH h AS (SELECT * FROM {_HEALTH}), e AS (SELECT o_custkey AS source, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS path_id, CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey END AS id, CASE WHEN c_custkey % 13 = 0 THEN {_MADE} - INTERVAL 1 DAY WHEN c_custkey % 37 <> 0 THEN {_MADE} END AS scraped, c_custkey % 31 <> 0 AS list FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT h.source, status, count, last_ok_at, coalesce(n, 0) AS n, path_id, scraped, id IS DISTINCT FROM h.source OR NOT list OR scraped IS NULL AS bad FROM h LEFT JOIN e ON h.source = e.source LEFT JOIN s ON h.source = path_id)
SELECT 'count-disagrees' AS rule, source AS entity FROM j WHERE n <> count UNION ALL SELECT 'snapshot-missing', source FROM j WHERE path_id IS NULL AND status <> 'error'
UNION ALL SELECT 'snapshot-malformed', source FROM j WHERE path_id IS NOT NULL AND bad UNION ALL SELECT 'snapshot-of-another-run', source FROM j WHERE path_id IS NOT NULL AND NOT bad AND scraped <> last_ok_at""")
def gate_reconciled(spark, sf_dir):
    """What a run says of its sources against the records that it published and the snapshots that it left."""
    shown = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("source"))
    k, made = F.col("c_custkey"), F.lit("1998-01-01 06:00:00").cast("timestamp")
    kept = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(k % 5 != 0).select(
        k.alias("path_id"), F.when(k % 11 == 0, -1).otherwise(k).alias("id"), F.when(k % 13 == 0, made - F.expr("INTERVAL 1 DAY")).when(k % 37 != 0, made).alias("scraped_at"), (k % 31 != 0).alias("events"),
    )
    return gate.reconciled(customers_health(spark, sf_dir), shown, kept)


@register("gate_run_events", f"""WITH e AS (SELECT * FROM {_E} WHERE date >= {_TODAY} - 3), h AS (SELECT source, count(*) % 2 = 0 AS ok FROM e GROUP BY source),
r AS (SELECT (SELECT count(*) FROM h) AS listed, (SELECT count(*) FROM h) + 1 AS sources, (SELECT count(*) FILTER (ok) FROM h) AS ok, (SELECT count(*) FROM e) AS n, (SELECT min(date) FROM e) AS first)
SELECT 'sources-disagree' AS rule, 'run' AS entity FROM r WHERE sources <> listed UNION ALL SELECT 'events-disagree', 'run' FROM r WHERE n // 2 <> n UNION ALL SELECT 'few-sources-ok', 'run' FROM r WHERE sources > 1 AND ok / sources < 0.9
UNION ALL SELECT 'few-events', 'run' FROM r WHERE n < 1000000000 UNION ALL SELECT 'starts-in-the-past', 'run' FROM r WHERE first < {_TODAY} - 1""")
def gate_run_events(spark, sf_dir):
    """A run's totals against its lists: the events since some days ago, with totals that are off."""
    e = events(spark, sf_dir).filter(F.col("date") >= F.date_sub(F.lit("2024-01-10").cast("date"), 3)).withColumn("position", F.unix_timestamp("instant"))
    health = e.groupBy("source").agg((F.count(F.lit(1)) % 2 == 0).alias("ok"))
    totals = health.agg((F.count(F.lit(1)) + 1).alias("sources"), F.count_if("ok").alias("ok")).withColumn("events", e.agg(F.floor(F.count(F.lit(1)) / 2)).scalar())
    return gate.run_violations(totals, health, e, F.lit("2024-01-10 09:00:00").cast("timestamp"), 1_000_000_000, 0.9)
