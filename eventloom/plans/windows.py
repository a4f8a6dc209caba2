"""Queries over the event table: horizon, date windows, facets, search, drop reasons, day listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import fold
from .query import QuerySpec, facet_counts, in_window, price_matches
from .registry import register

#: The pinned clock of all queries over the events table, and its horizon.
NOW, DAYS = "2024-01-10 09:00:00", 14


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a listing: type is the source, value the price (negative: unknown, below 20: free)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("event_type").alias("source"), "user_id", F.col("ts").cast("timestamp").alias("instant"), F.to_date("ts").alias("date"), F.date_format("ts", "HH:mm").alias("time"), "value", (F.col("value") < 20).alias("free"), "props")


_E = "(SELECT event_id, event_type AS source, user_id, ts AS instant, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time, value, value < 20 AS free, props FROM events)"
_TODAY = "DATE '2024-01-10'"
_WINDOWS = {"today": (0, 1), "tomorrow": (1, 2), "week": (0, 7), "month": (0, 30)}


def _today():
    return F.lit("2024-01-10").cast("date")


@register("horizon_filter", f"SELECT event_id, source, date, time FROM {_E} WHERE date >= {_TODAY} AND date < {_TODAY} + {DAYS}")
def horizon_filter(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter((F.col("date") >= _today()) & (F.col("date") < F.date_add(_today(), DAYS))).select("event_id", "source", "date", "time")


def _window(when):
    a, b = _WINDOWS[when]

    @register(f"window_{when}", f"SELECT event_id, source, date FROM {_E} WHERE date >= {_TODAY} + {a} AND date < {_TODAY} + {b}")
    def run(spark, sf_dir):
        return events(spark, sf_dir).filter(in_window(F.col("date"), when, _today())).select("event_id", "source", "date")


for _when in _WINDOWS:
    _window(_when)


@register("picked_date", f"SELECT event_id, source, date FROM {_E} WHERE date = DATE '2024-01-15'")
def picked_date(spark, sf_dir):
    return events(spark, sf_dir).filter(in_window(F.col("date"), "date", _today(), F.lit("2024-01-15").cast("date"))).select("event_id", "source", "date")


@register("facet_price", f"SELECT price, count(*) AS n FROM (SELECT 'any' AS price FROM {_E} UNION ALL SELECT 'free' FROM {_E} WHERE free UNION ALL SELECT 'paid' FROM {_E} WHERE NOT free) GROUP BY price")
def facet_price(spark, sf_dir):
    e = events(spark, sf_dir)
    kinds = F.array_compact(F.array(*(F.when(price_matches(F.col("free"), p), F.lit(p)) for p in ("any", "free", "paid"))))
    return e.select(F.explode(kinds).alias("price")).groupBy("price").agg(F.count(F.lit(1)).alias("n"))


@register("facet_counts_before_toggle", f"""WITH s AS (SELECT DISTINCT source FROM {_E}), f AS (SELECT source, count(*) AS n FROM {_E} WHERE date >= {_TODAY} AND date < {_TODAY} + 7 AND free GROUP BY source)
SELECT s.source, coalesce(n, 0) AS n FROM s LEFT JOIN f ON s.source = f.source""")
def facet_counts_before_toggle(spark, sf_dir):
    return facet_counts(events(spark, sf_dir), QuerySpec(when="week", price="free", off=("click",)), _today())


@register("source_toggle_off", f"SELECT event_id, source FROM {_E} WHERE date >= {_TODAY} AND date < {_TODAY} + 7 AND source NOT IN ('click', 'view')")
def source_toggle_off(spark, sf_dir):
    return QuerySpec(when="week", off=("click", "view")).rows(events(spark, sf_dir), _today()).select("event_id", "source")


@register("search_all_terms_accent_fold", """SELECT doc_id FROM (SELECT doc_id, strip_accents(lower(coalesce(text, '') || ' ' || chr(1) || ' ' || coalesce(source, ''))) AS hay FROM documents)
WHERE contains(hay, 'leau') AND contains(hay, 'ere')""")
def search_all_terms_accent_fold(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hay = fold(F.concat(F.coalesce("text", F.lit("")), F.lit(" \x01 "), F.coalesce("source", F.lit(""))))
    return d.select("doc_id", hay.alias("hay")).filter(QuerySpec(q="Leau éRe").matches(F.col("hay"))).select("doc_id")


@register("day_grouped_sorted_topk", f"""SELECT event_id, source, date, time, row_number() OVER (PARTITION BY date ORDER BY time, event_id) AS place
FROM (SELECT *, row_number() OVER (ORDER BY date, time, event_id) AS nth FROM {_E} WHERE date >= {_TODAY} AND date < {_TODAY} + 7) WHERE nth <= 250""")
def day_grouped_sorted_topk(spark, sf_dir):
    week = events(spark, sf_dir).filter(in_window(F.col("date"), "week", _today()))
    top = week.orderBy("date", F.col("time").asc_nulls_last(), "event_id").limit(250)
    place = F.row_number().over(W.partitionBy("date").orderBy(F.col("time").asc_nulls_last(), "event_id"))
    return top.select("event_id", "source", "date", "time", place.cast("long").alias("place"))


_REASON = f"CASE WHEN event_id % 97 = 0 THEN 'invalid' WHEN date < {_TODAY} THEN 'past' WHEN source = 'purchase' AND value > 90 THEN 'members-only' WHEN date >= {_TODAY} + {DAYS} THEN 'beyond-horizon' WHEN source = 'scroll' THEN 'not-a-talk' END"


def _reasons(e):
    """The precedence of the rules over the events table: the first that fails names the reason."""
    today = _today()
    rules = [
        (F.col("event_id") % 97 == 0, "invalid"), (F.col("date") < today, "past"), ((F.col("source") == "purchase") & (F.col("value") > 90), "members-only"),
        (F.col("date") >= F.date_add(today, DAYS), "beyond-horizon"), (F.col("source") == "scroll", "not-a-talk"),
    ]
    out = F.lit(None).cast("string")
    for when, reason in reversed(rules):
        out = F.when(when, F.lit(reason)).otherwise(out)
    return e.withColumn("reason", out)


@register("drop_reason_first_match", f"SELECT event_id, {_REASON} AS reason FROM {_E}")
def drop_reason_first_match(spark, sf_dir):
    return _reasons(events(spark, sf_dir)).select("event_id", "reason")


@register("drop_reason_counts", f"SELECT source, reason, count(*) AS n FROM (SELECT source, {_REASON} AS reason FROM {_E}) WHERE reason IS NOT NULL GROUP BY source, reason")
def drop_reason_counts(spark, sf_dir):
    return _reasons(events(spark, sf_dir)).filter("reason IS NOT NULL").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("drop_samples_top8", f"""SELECT source, nth, reason || ': ' || event_id AS sample FROM (SELECT source, reason, event_id, row_number() OVER (PARTITION BY source ORDER BY event_id) AS nth
FROM (SELECT source, event_id, {_REASON} AS reason FROM {_E}) WHERE reason IS NOT NULL AND reason NOT IN ('past', 'beyond-horizon')) WHERE nth <= 8""")
def drop_samples_top8(spark, sf_dir):
    dropped = _reasons(events(spark, sf_dir)).filter("reason IS NOT NULL AND reason NOT IN ('past', 'beyond-horizon')")
    nth = F.row_number().over(W.partitionBy("source").orderBy("event_id")).cast("long")
    return dropped.withColumn("nth", nth).filter("nth <= 8").select("source", "nth", F.concat_ws(": ", "reason", F.col("event_id").cast("string")).alias("sample"))


@register("london_wall_clock", "SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS DATE) AS date, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London', '%H:%M') AS time FROM events")
def london_wall_clock(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", dates.london_date(F.col("instant")).alias("date"), dates.london_time(F.col("instant")).alias("time"))


@register("london_roundtrip", "SELECT o_orderkey, o_orderdate AS start FROM orders")
def london_roundtrip(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("i"))
    return o.select("o_orderkey", dates.from_london(dates.london_date(F.col("i")), dates.london_time(F.col("i"))).cast("timestamp_ntz").alias("start"))


@register("midnight_is_null", "SELECT event_id, nullif(strftime(date_trunc('hour', ts), '%H:%M'), '00:00') AS time FROM events")
def midnight_is_null(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", dates.none_if_midnight(F.date_format(F.date_trunc("hour", "instant"), "HH:mm")).alias("time"))


@register("time_tolerance_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND a.event_id < b.event_id AND abs((extract(hour FROM a.ts) * 60 + extract(minute FROM a.ts)) - (extract(hour FROM b.ts) * 60 + extract(minute FROM b.ts))) <= 30")
def time_tolerance_join(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "date", (F.hour("instant") * 60 + F.minute("instant")).alias("m"))
    a, b = e.select("user_id", "date", F.col("event_id").alias("a"), F.col("m").alias("ma")), e.select("user_id", "date", F.col("event_id").alias("b"), F.col("m").alias("mb"))
    return a.join(b, ["user_id", "date"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ma") - F.col("mb")) <= 30)).select("a", "b")
