"""Queries that run the listing engine itself: the rule chain, health, the gate, linkage and the report.

Listings are made from `orders` (every order a listing, with titles, places and prices of several kinds, so that all
rules meet the table's dates), or are stated case by case where a rule needs a text of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import linkage, normalize, runs
from .golden import literal, values
from .query import QuerySpec, facet_lock, header
from .records import _KEEP, _RICH_OF, documents_as_events
from .registry import register, state
from .windows import _E, _TODAY, _today, events

NOW, DAYS = "2026-09-25 09:00:00", 45

_BASE = {"source": "test", "title": "A Talk About Maps", "url": "https://example.org/events/maps", "start_date": "2026-10-01", "start_time": "18:30"}
#: Raw listings (what differs from _BASE), the reason that drops them, and what it says.
REASONS: list[tuple[dict, str | None, str | None]] = [
    ({}, None, None),
    ({"title": "<i> </i>"}, "invalid", "missing title"),
    ({"title": None}, "invalid", "missing title"),
    ({"title": "CANCELLED: A Talk About Maps"}, "cancelled", "A Talk About Maps"),
    ({"title": "Postponed - A Talk", "url": "/x"}, "cancelled", "A Talk"),
    ({"url": "/relative"}, "invalid", 'bad url for "A Talk About Maps"'),
    ({"url": "ftp://example.org/x"}, "invalid", 'bad url for "A Talk About Maps"'),
    ({"start_date": "2026-02-30"}, "invalid", 'bad date for "A Talk About Maps"'),
    ({"end_date": "2026-10-07"}, None, None),
    ({"end_date": "2026-10-08"}, "long-run", "A Talk About Maps"),
    ({"start_date": "2026-09-24"}, "past", None),
    ({"start_date": "2026-09-25", "start_time": "08:00"}, None, None),
    ({"start_date": "2026-11-08"}, None, None),
    ({"start_date": "2026-11-09"}, "beyond-horizon", None),
    ({"title": "Fellows' Evening"}, "members-only", "Fellows' Evening"),
    ({"title": "Members only: curator tour"}, "members-only", "Members only: curator tour"),
    ({"title": "Autumn Lecture", "description": "This event is for members only."}, "members-only", "Autumn Lecture"),
    ({"title": "Autumn Lecture", "description": "Open to all; members get priority booking."}, None, None),
    ({"title": "Autumn Exhibition"}, "not-a-talk", "Autumn Exhibition"),
    ({"title": "The Science of Stress: A 4-week course"}, "not-a-talk", "The Science of Stress: A 4-week course"),
    ({"title": "Frida: The Making of an Icon: Exhibition Talk"}, None, None),
    ({"title": "A crash course in climate science"}, None, None),
    ({"location": "Online"}, "online-only", "A Talk About Maps"),
    ({"title": "A Talk About Maps (Online)", "source": "home"}, "online-only", "A Talk About Maps"),
    ({"online": True, "location": "Senate House, WC1E 7HU"}, "online-only", "A Talk About Maps"),
    ({"description": "This is an online event, held on Zoom."}, "online-only", "A Talk About Maps"),
    ({"location": "Test Hall and online"}, None, None),
    ({"location": "Assembly Rooms, Edinburgh"}, "outside-london", "A Talk About Maps @ Assembly Rooms, Edinburgh"),
    ({"title": "A private view"}, "excluded", "A private view"),
]
#: Raw listings and the fields of their records: title, date, time, start (UTC), location, description, speakers,
#: free, online, price.
RECORDS: list[tuple[dict, tuple]] = [
    ({"description": "<p>Maps &amp; more</p>", "price_text": "Free", "location": "Room 1, Senate House, WC1E 7HU"}, ("A Talk About Maps", "2026-10-01", "18:30", "2026-10-01 17:30", "Room 1, Senate House, WC1E 7HU", "Maps & more", "", "true", "false", "Free")),
    ({"source": "home"}, ("A Talk About Maps", "2026-10-01", "18:30", "2026-10-01 17:30", "Test Hall, 1 Test Street, WC1E 7HU", None, "", "true", "false", None)),
    ({"start_time": "00:00"}, ("A Talk About Maps", "2026-10-01", None, "2026-09-30 23:00", None, None, "", None, None, None)),
    ({"start_date": None, "start_time": None, "start_instant": "2026-10-26 19:00:00"}, ("A Talk About Maps", "2026-10-26", "19:00", "2026-10-26 19:00", None, None, "", None, None, None)),
    ({"title": "SOLD OUT: An evening with Mary Beard", "price_text": "Tickets £12 https://example.org/buy"}, ("An evening with Mary Beard", "2026-10-01", "18:30", "2026-10-01 17:30", None, None, "Mary Beard", "false", None, "Tickets £12")),
    ({"title": "Mary Beard", "speakers": ["Mary Beard", "Professor Ben Okri FRS", "Ben Okri", "X"]}, ("Mary Beard", "2026-10-01", "18:30", "2026-10-01 17:30", None, None, "Professor Ben Okri", None, None, None)),
    ({"title": "In-Person: On Maps", "description": "on maps"}, ("On Maps", "2026-10-01", "18:30", "2026-10-01 17:30", None, None, "", None, "false", None)),
    ({"title": "THE BIG DEBATE", "hints": ["", "Free entry"]}, ("The Big Debate", "2026-10-01", "18:30", "2026-10-01 17:30", None, None, "", "true", None, None)),
    ({"title": "Long", "description": "word " * 100}, ("Long", "2026-10-01", "18:30", "2026-10-01 17:30", None, ("word " * 83).strip() + "…", "", None, None, None)),
]


def sources(spark) -> DataFrame:
    rows = [("test", "Test", "https://example.org", None, None, None), ("home", "Home", "https://example.org", True, None, "Test Hall, 1 Test Street, WC1E 7HU"), ("quiet", "The Quiet", "https://example.org", None, None, None), ("broken", "Broken", "https://example.org", None, None, None)]
    return spark.createDataFrame(rows, schemas.SOURCE)


def stated(spark, rows: list[dict]) -> DataFrame:
    """Raw listings of the stated ones, normalized."""
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.RAW_EVENT).schema}
    plain = spark.createDataFrame([tuple((_BASE | {"seq": i} | r).get(n) for n in kinds) for i, r in enumerate(rows)], ", ".join(f"{n} {'string' if n in ('start_instant', 'end_date') else k.simpleString()}" for n, k in kinds.items()))
    raw = plain.withColumns({"start_instant": F.col("start_instant").cast("timestamp"), "end_date": F.col("end_date").cast("date")})
    return normalize.normalize(raw, sources(spark), F.lit(NOW).cast("timestamp"), DAYS, include=~F.contains(F.lower("title"), F.lit("private view")))


@state("normalize_reasons", values([(i, reason, detail) for i, (_, reason, detail) in enumerate(REASONS)], "seq, drop_reason, drop_detail"))
def normalize_reasons(spark, sf_dir):
    return stated(spark, [r for r, _, _ in REASONS]).select(F.col("seq").cast("int").alias("seq"), "drop_reason", "drop_detail")


_FIELDS = "title, date, time, start, location, description, speakers, free, online, price"


@state("normalize_records", f"""SELECT *, left(sha1(source || '|' || 'https://example.org/events/maps|' || date || '|' || coalesce(time, '')), 12) AS id
FROM ({values([(i, row.get("source", "test"), *fields) for i, (row, fields) in enumerate(RECORDS)], "seq, source, " + _FIELDS)})""")
def normalize_records(spark, sf_dir):
    e = stated(spark, [r for r, _ in RECORDS])
    flag = lambda c: F.when(F.col(c), "true").when(~F.col(c), "false").alias(c)
    return e.select(F.col("seq").cast("int").alias("seq"), "source", "title", F.col("date").cast("string").alias("date"), "time", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "location", "description", F.array_join("speakers", "|").alias("speakers"), flag("free"), flag("online"), "price", "id")


# --- every order a listing --------------------------------------------------------------------------------------

_TITLES = ("A Talk About Maps", "CANCELLED: On Rivers", "Autumn Exhibition", "Members only: curator tour", "On", "SOLD OUT: An evening with Mary Beard", "Gallery Tour")
_BARE = ("A Talk About Maps", "On Rivers", "Autumn Exhibition", "Members only: curator tour", "On", "An evening with Mary Beard", "Gallery Tour")
_PLACES = ("Senate House, WC1E 7HU", None, "Assembly Rooms, Edinburgh", "Online", "Conway Hall and online")
_CLOCK, _HORIZON = "1995-06-15 09:00:00", 400


def orders_as_raw(spark, sf_dir) -> DataFrame:
    """Every order a raw listing: kinds of titles and places by its key, its days those of the order and of its last
    shipment."""
    ends = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("fin"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pick = lambda options: F.element_at(F.array(*(F.lit(x) for x in options)), (F.col("o_orderkey") % len(options) + 1).cast("int"))
    given = {
        "source": F.col("o_orderpriority"), "seq": F.col("o_orderkey"), "title": pick(_TITLES), "url": F.concat(F.when(F.col("o_orderkey") % 11 == 0, "/").otherwise("https://example.org/"), F.col("o_orderkey")),
        "start_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "start_time": F.date_format("o_orderdate", "HH:mm"), "end_date": F.when(F.col("o_orderkey") % 3 == 0, F.col("fin")), "location": pick(_PLACES),
        "price_text": F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("£"), F.ceil("o_totalprice").cast("string"))),
    }
    names = spark.createDataFrame([], schemas.RAW_EVENT).schema
    return o.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in names))


def priorities(spark, sf_dir) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("id")).distinct()
    none = F.lit(None)
    return ids.select("id", F.col("id").alias("name"), F.lit("https://example.org").alias("homepage"), none.cast("boolean").alias("default_free"), none.cast("boolean").alias("default_online"), none.cast("string").alias("default_location"))


def orders_normalized(spark, sf_dir) -> DataFrame:
    return normalize.normalize(orders_as_raw(spark, sf_dir), priorities(spark, sf_dir), F.lit(_CLOCK).cast("timestamp"), _HORIZON)


def _of(options) -> str:
    return f"([{', '.join(literal(x) for x in options)}])[o_orderkey % {len(options)} + 1]"


_DAY = "CAST(o_orderdate AS DATE)"
_ORDERS = f"""(SELECT *, CASE
 WHEN length(title) < 3 THEN 'invalid' WHEN o_orderkey % {len(_TITLES)} = 1 THEN 'cancelled' WHEN o_orderkey % 11 = 0 THEN 'invalid' WHEN o_orderkey % 3 = 0 AND date_diff('day', date, fin) + 1 > 7 THEN 'long-run'
 WHEN date < DATE '1995-06-15' THEN 'past' WHEN o_orderkey % {len(_TITLES)} = 3 THEN 'members-only' WHEN date >= DATE '1995-06-15' + {_HORIZON} THEN 'beyond-horizon' WHEN o_orderkey % {len(_TITLES)} = 2 THEN 'not-a-talk'
 WHEN place = 'Online' THEN 'online-only' WHEN place LIKE '%Edinburgh' THEN 'outside-london' END AS drop_reason
FROM (SELECT o_orderkey, o_orderpriority AS source, {_DAY} AS date, nullif(strftime(o_orderdate, '%H:%M'), '00:00') AS time, o_totalprice, {_of(_BARE)} AS title, {_of(_PLACES)} AS place, fin
FROM orders LEFT JOIN (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS fin FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey))"""


@register("normalize_orders", f"""SELECT o_orderkey AS seq, drop_reason, title, date, time, left(sha1(source || '|https://example.org/' || o_orderkey || '|' || date || '|' || coalesce(time, '')), 12) AS id, place AS location,
CASE WHEN place IN ('Senate House, WC1E 7HU', 'Conway Hall and online') THEN false WHEN place IS NULL OR place LIKE '%Edinburgh' THEN CASE WHEN place IS NOT NULL THEN false END END AS online,
CASE WHEN o_orderkey % 2 = 0 THEN false END AS free, CASE WHEN o_orderkey % 2 = 0 THEN '£' || CAST(ceil(o_totalprice) AS BIGINT) END AS price, CASE WHEN title LIKE '%Mary Beard' THEN 'Mary Beard' ELSE '' END AS speakers FROM {_ORDERS} WHERE drop_reason IS NULL
UNION ALL SELECT o_orderkey, drop_reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {_ORDERS} WHERE drop_reason IS NOT NULL""")
def normalize_orders(spark, sf_dir):
    """The whole chain over every order; what is dropped shows its reason only."""
    e = orders_normalized(spark, sf_dir)
    kept = F.col("drop_reason").isNull()
    return e.select("seq", "drop_reason", *(F.when(kept, F.col(c)).alias(c) for c in ("title", "date", "time", "id", "location", "online", "free", "price")), F.when(kept, F.array_join("speakers", "|")).alias("speakers"))


@register("health_orders", f"""SELECT id AS source, CASE WHEN id = '5-LOW' THEN 'error' WHEN coalesce(scraped, 0) = 0 THEN 'empty' ELSE 'ok' END AS status, coalesce(scraped, 0) AS scraped, coalesce(kept, 0) AS kept, reason, n
FROM (SELECT DISTINCT o_orderpriority AS id FROM orders UNION SELECT 'nothing') LEFT JOIN (SELECT source, count(*) AS scraped, count(*) FILTER (drop_reason IS NULL) AS kept FROM {_ORDERS} GROUP BY source) c ON id = c.source
LEFT JOIN (SELECT source, drop_reason AS reason, count(*) AS n FROM {_ORDERS} WHERE drop_reason IS NOT NULL GROUP BY ALL) d ON id = d.source""")
def health_orders(spark, sf_dir):
    """runs.health over every order, its counts of dropped listings as rows."""
    extra = spark.createDataFrame([("nothing", "Nothing", None, None, None, None)], schemas.SOURCE)
    errors = spark.createDataFrame([("5-LOW", "HTTP 500")], "source string, error string")
    got = runs.health(orders_normalized(spark, sf_dir), priorities(spark, sf_dir).unionByName(extra), errors)
    return got.select("source", "status", "scraped", "kept", F.explode_outer("dropped").alias("reason", "n"))


@register("health_samples_orders", f"""SELECT source, nth, sample FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY o_orderkey) AS nth,
left(drop_reason || coalesce(': ' || CASE WHEN drop_reason = 'invalid' AND length(title) < 3 THEN 'missing title' WHEN drop_reason = 'invalid' THEN 'bad url for "' || title || '"' WHEN drop_reason = 'outside-london' THEN title || ' @ ' || place ELSE title END, ''), 140) AS sample
FROM {_ORDERS} WHERE drop_reason IS NOT NULL AND drop_reason NOT IN ('past', 'beyond-horizon')) WHERE nth <= 8""")
def health_samples_orders(spark, sf_dir):
    got = runs.health(orders_normalized(spark, sf_dir), priorities(spark, sf_dir), spark.createDataFrame([], "source string, error string"))
    return got.select("source", F.posexplode("drop_samples").alias("nth", "sample")).select("source", (F.col("nth") + 1).cast("long").alias("nth"), "sample")


@state("still_listable_cases", values([(0, "true"), (1, "false"), (2, "false"), (3, "false"), (4, "false"), (5, "false"), (6, "false")], "nth, listable"))
def still_listable_cases(spark, sf_dir):
    rows = [(0, "2026-10-01", False, "Senate House, London", "A talk", None), (1, "2026-09-01", None, None, "A talk", None), (2, "2026-12-01", None, None, "A talk", None), (3, "2026-10-01", True, None, "A talk", None), (4, "2026-10-01", None, "Leeds", "A talk", None), (5, "2026-10-01", None, None, "Autumn Exhibition", None), (6, "2026-10-01", None, None, "A talk", "For members only")]
    e = spark.createDataFrame(rows, "nth int, day string, online boolean, location string, title string, description string").withColumn("date", F.col("day").cast("date"))
    return e.select("nth", normalize.still_listable(e, F.lit(NOW).cast("timestamp"), DAYS).cast("string").alias("listable"))


# --- linkage ----------------------------------------------------------------------------------------------------

def documents_by_text(spark, sf_dir) -> DataFrame:
    """Documents as listings whose page and day come from the text, so that copies are one page on one day."""
    days = F.coalesce(F.length("title"), F.lit(0)) % 30
    return documents_as_events(spark, sf_dir).filter("url IS NOT NULL").withColumn("date", F.date_add(F.lit("2026-10-01").cast("date"), days.cast("int")))


@register("exact_dedupe_folded", f"""WITH t AS (SELECT doc_id, source, text, CASE WHEN doc_id % 3 > 0 THEN lpad((doc_id % 4 + 17)::VARCHAR, 2, '0') || ':30' END AS time, CASE WHEN doc_id % 2 = 0 THEN text END AS description FROM documents WHERE text IS NOT NULL),
f AS (SELECT {_KEEP.format(e=_RICH_OF.format('e'), k=_RICH_OF.format('k'))} AS r FROM t GROUP BY text) SELECT r.seq AS seq, r.source AS source, r.time AS time, length(r.description) AS described, r.also AS elsewhere FROM f""")
def exact_dedupe_folded(spark, sf_dir):
    """The fold of every (page, day), records of one copy and of many alike."""
    kept = linkage.exact_duplicates(documents_by_text(spark, sf_dir))
    return kept.select("seq", "source", "time", F.length("description").cast("long").alias("described"), F.size("also_at").alias("elsewhere"))


# --- runs and the page ------------------------------------------------------------------------------------------


@state("report_cases", values([("broken", "Broken", "error", "Blocked at e.org", "", "Thu 24 Sep", "Thu 24 Sep", "100 8"), ("quiet", "The Quiet", "empty", None, "", None, None, "8"), ("test", "Test", "ok", None, "past 7, cancelled 2", "Fri 25 Sep", None, "100 50"), ("home", "Home", "unknown", None, "", None, None, "")], "source, name, status, error, dropped, last_ok, carried_from, bars"))
def report_cases(spark, sf_dir):
    health = spark.createDataFrame([("test", "ok", None, 10, {"cancelled": 2, "past": 7}, "2026-09-25 09:00:00", 0), ("quiet", "empty", None, 0, None, None, 0), ("broken", "error", "Blocked at https://e.org/x/y (challenge did not clear)", 0, None, "2026-09-24 09:00:00", 3)], "source string, status string, error string, scraped long, dropped map<string,long>, at string, carried long")
    health = health.withColumn("last_ok_at", F.col("at").cast("timestamp")).drop("at")
    history = spark.createDataFrame([("2026-09-24 09:00:00", {"test": 8, "broken": -1}), ("2026-09-25 09:00:00", {"test": 4, "quiet": 0, "broken": 0})], "t string, counts map<string,int>").select(F.col("t").cast("timestamp").alias("at"), "counts")
    return runs.report(health, history, sources(spark)).select("source", "name", "status", "error", "dropped", "last_ok", "carried_from", F.array_join(F.transform("bars", lambda b: b["height"].cast("string")), " ").alias("bars"))


@state("better_run_cases", values([("a", "ok", 5), ("b", "ok", 3), ("c", "ok", 9), ("d", "error", 0)], "source, status, kept"))
def better_run_cases(spark, sf_dir):
    first = spark.createDataFrame([("a", "error", 0), ("b", "ok", 3), ("c", "ok", 4), ("d", "error", 0)], "source string, status string, kept int")
    return runs.better_run(first, spark.createDataFrame([("a", "ok", 5), ("b", "ok", 2), ("c", "ok", 9)], "source string, status string, kept int"))


@state("blocked_cases", values([(0, "true"), (1, "false"), (2, "true"), (3, "false")], "nth, blocked"))
def blocked_cases(spark, sf_dir):
    rows = [(0, "Blocked by Cloudflare bot protection", []), (1, "HTTP 500", ["slow"]), (2, None, ["stopped paginating at page 3: bot check"]), (3, None, ["bot check on the first"])]
    return spark.createDataFrame(rows, "nth int, error string, warnings array<string>").select("nth", runs.blocked(F.col("error"), F.col("warnings")).cast("string").alias("blocked"))


@state("read_back_cases", values([("a", 1)], "id, n"))
def read_back_cases(spark, sf_dir):
    e = lambda d: ("t", "https://e.org", d, "2026-10-01T18:00:00Z", ["x"])
    rows = [("a", "a", "2026-09-25T09:00:00Z", [e("2026-10-01"), e("soon"), (None, "u", "2026-10-01", "s", [])]), ("b", "c", "2026-09-25T09:00:00Z", [e("2026-10-01")]), ("d", "d", "never", [e("2026-10-01")])]
    df = spark.createDataFrame(rows, "id string, path_id string, scraped_at string, events array<struct<title:string,url:string,date:string,start:string,speakers:array<string>>>")
    return runs.read_back(df).select("id", F.size("events").alias("n"))


@register("listed_counts_events", f"SELECT s.source AS source, coalesce(n, 0) AS count FROM (SELECT DISTINCT event_type AS source FROM events UNION SELECT 'nothing') s LEFT JOIN (SELECT source, count(*) AS n FROM {_E} WHERE date = {_TODAY} GROUP BY source) c ON s.source = c.source")
def listed_counts_events(spark, sf_dir):
    e = events(spark, sf_dir)
    ids = e.select(F.col("source").alias("id")).distinct().unionByName(spark.createDataFrame([("nothing",)], "id string"))
    return runs.listed_counts(e.filter(F.col("date") == _today()), ids)


@register("result_header", f"SELECT format('{{:,}}', count(*)) || ' events in the next 7 days · 3 of 5 sources' AS header FROM {_E} WHERE date >= {_TODAY} AND date < {_TODAY} + 7 AND source NOT IN ('click', 'view')")
def result_header(spark, sf_dir):
    spec = QuerySpec(when="week", off=("click", "view"))
    return header(spec, spec.rows(events(spark, sf_dir), _today()), 5)


@register("facet_lock_events", f"""SELECT t.source AS source, coalesce(n, 0) AS n, total, last_date, coalesce(n, 0) = 0 AS locked, CASE WHEN coalesce(n, 0) = 0 THEN 'No events match the current filters' END AS hint
FROM (SELECT source, count(*) AS total, max(date) AS last_date FROM {_E} GROUP BY source) t LEFT JOIN (SELECT source, count(*) AS n FROM {_E} WHERE date = DATE '2024-01-15' AND free AND source <> 'scroll' AND source IN (SELECT source FROM {_E} WHERE date = DATE '2024-01-15' AND free) GROUP BY source) f ON t.source = f.source""")
def facet_lock_events(spark, sf_dir):
    e = events(spark, sf_dir)
    # one source never has free places, so that it is locked
    e = e.withColumn("free", F.when(F.col("source") == "scroll", False).otherwise(F.col("free")))
    return facet_lock(e, QuerySpec(when="date", date="2024-01-15", price="free"), _today())


@state("highlight_cases", values([(0, "<mark>Élan</mark> &amp; &quot;vital&quot;"), (1, "&lt;b&gt;"), (2, "b<mark>anan</mark>a")], "nth, result"))
def highlight_cases(spark, sf_dir):
    rows = spark.createDataFrame([(0, 'Élan & "vital"'), (1, "<b>"), (2, "banana")], "nth int, v string")
    return rows.select("nth", text.highlight(F.col("v"), ["elan", "anan", "x"]).alias("result"))


@register("highlight_documents", "SELECT doc_id, length(replace(marked, '<mark>', '<mark>#')) - length(marked) AS marks FROM (SELECT doc_id, replace(lower(coalesce(text, '')), 'leau', '<mark>') AS marked FROM documents)")
def highlight_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.highlight(F.lower("text"), ["leau"]).alias("h"))
    return d.select("doc_id", F.size(F.regexp_extract_all("h", F.lit("<mark>"), F.lit(0))).cast("long").alias("marks"))


#: Pairs of records (what differs from a common one), and how many remain, with how many other sources.
DUPLICATES = [
    ({"url": "https://example.org/talk?utm_medium=email"}, {"url": "https://www.example.org/talk/", "description": "A long description of the talk that is useful."}, 1, 0),
    ({"url": "https://example.org/series"}, {"url": "https://example.org/series", "day": 16}, 2, 0),
    ({"title": "The secret life of sewers", "speakers": ["Rosemary Ashton"]}, {"source": "b", "title": "The Secret Life of Sewers: a panel discussion", "time": "18:45"}, 1, 1),
    ({}, {"source": "b", "location": "Conway Hall, Red Lion Square"}, 2, 0),
    ({}, {"source": "b", "time": "10:00"}, 2, 0),
    ({}, {}, 1, 0),
    ({}, {"time": "18:45"}, 2, 0),
    ({"source": "c", "time": None, "location": None}, {"source": "b", "time": "18:30"}, 1, 1),
    ({"title": "Maps"}, {"source": "b", "title": "Maps"}, 2, 0),
]


@state("fuzzy_dedupe_cases", values([(i, n, others) for i, (_, _, n, others) in enumerate(DUPLICATES)], "nth, kept, elsewhere"))
def fuzzy_dedupe_cases(spark, sf_dir):
    """Both passes over pairs of records, each pair on a day of its own."""
    base = {"source": "a", "title": "The Secret Life of Sewers", "time": "18:30", "location": "The British Academy, Carlton House Terrace", "speakers": [], "also_at": [], "day": 0}
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.EVENT).schema}
    rows = []
    for i, (a, b, _, _) in enumerate(DUPLICATES):
        for j, r in enumerate((a, b)):
            e = base | {"seq": 2 * i + j, "id": str(i), "url": f"https://example.org/e/{2 * i + j}"} | r
            rows.append(tuple((e | {"date": f"2026-10-{10 + i}" if not e["day"] else f"2026-11-{e['day']}"}).get(n) for n in kinds))
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('date', 'start') else k.simpleString()}" for n, k in kinds.items()))
    df = df.withColumns({"date": F.col("date").cast("date"), "start": F.col("start").cast("timestamp")})
    kept = linkage.dedupe(df).groupBy((F.col("id").cast("int")).alias("nth"))
    return kept.agg(F.count(F.lit(1)).cast("int").alias("kept"), F.sum(F.size("also_at")).cast("int").alias("elsewhere"))
