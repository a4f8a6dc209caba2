"""Queries of the connectors over responses that are made from the tables: every customer's orders as an API response,
a feed or a page, written by Spark's own JSON writer and read back by the connector. The SQL says what the orders hold;
it knows nothing of the formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions import text
from ..operators import runs
from ..sources import catalogue, readers
from ..storage import new_folder
from .records import _RUNS, _runs
from .registry import register
from .windows import events



def _key():
    return F.col("o_orderkey")


def _every(n: int, k: int = 0):
    return _key() % n == k


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark, sf_dir) -> DataFrame:
    """Orders with the fields that the formats below write."""
    low = F.when(_every(3), 0).otherwise(_key() % 50 + 1)
    given = {
        "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "hour": F.format_string("%02d:%02d", (_key() % 14 + 8).cast("int"), ((_key() % 4) * 15).cast("int")), "low": low, "high": low + _key() % 4,
        "title": F.concat(F.lit("Talk "), _key().cast("string"), F.lit(" & more")), "link": F.concat(F.lit("https://t.org/o/"), _key().cast("string")),
    }
    return _t(spark, sf_dir, "orders").withColumns(given)


_O = """(SELECT *, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, lpad((o_orderkey % 14 + 8)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 4 * 15)::VARCHAR, 2, '0') AS hour,
 CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 50 + 1 END AS low, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 50 + 1 END + o_orderkey % 4 AS high, 'Talk ' || o_orderkey || ' & more' AS title, 'https://t.org/o/' || o_orderkey AS link FROM orders)"""


def _by_customer(rows: DataFrame, item) -> DataFrame:
    """(page, items): a customer's orders, some dozens, as an array in the order of their keys."""
    return rows.groupBy(F.col("o_custkey").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct(_key().alias("k"), item.alias("item")))), lambda x: x["item"]).alias("items"))


@register("ticketing_orders", f"""SELECT title, link AS url, day AS start_date, hour AS start_time, CASE WHEN k % 5 = 0 THEN 'Online' ELSE 'Hall ' || o_orderpriority || ', 1 Road' END AS location, k % 5 = 0 AS online, CASE WHEN k % 7 = 0 THEN true END AS free,
CASE WHEN k % 7 = 0 THEN 'Free' WHEN low = 0 AND high > 0 THEN 'Free – £' || high || '.00' WHEN low = 0 THEN 'Free' WHEN high > low THEN '£' || low || '.00 – £' || high || '.00' ELSE '£' || low || '.00' END AS price_text,
o_custkey * 1000 + row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS seq, place AS place FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'api' ELSE 'page' END AS place, k % 11 <> 0 AND k % 13 <> 0 AS whole FROM {_O}) QUALIFY whole""")
def ticketing_orders(spark, sf_dir):
    """A ticketing platform's API for customers of even keys, its pages with embedded state for the others."""
    item = F.struct(
        F.when(_every(13), "").otherwise(F.col("title")).alias("name"), F.concat("link", F.lit("?aff=x")).alias("url"), F.col("day").alias("start_date"), F.concat("hour", F.lit(":00")).alias("start_time"), _every(5).alias("is_online_event"), _every(11).alias("is_cancelled"),
        F.struct(F.concat(F.lit("Hall "), "o_orderpriority").alias("name"), F.struct(F.lit("1 Road").alias("localized_address_display")).alias("address")).alias("primary_venue"),
        F.struct(_every(7).alias("is_free"), F.struct(F.format_string("%d.00", "low").alias("major_value"), F.lit("GBP").alias("currency")).alias("minimum_ticket_price"), F.struct(F.format_string("%d.00", "high").alias("major_value")).alias("maximum_ticket_price")).alias("ticket_availability"),
    )
    pages = _by_customer(orders(spark, sf_dir), item)
    state = F.to_json(F.struct(F.struct(F.struct(F.col("items").alias("upcomingEvents")).alias("pageProps")).alias("props")))
    body = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.col("items").alias("events")))).otherwise(F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></html>")))
    got = readers.ticketing(pages.select("page", body.alias("body")), "tickets")
    return got.select("title", "url", "start_date", "start_time", "location", "online", "free", "price_text", "seq", F.when(F.floor(F.col("seq") / 1000) % 2 == 0, "api").otherwise("page").alias("place"))


@register("json_feed_orders", f"SELECT title, link AS url, CAST(o_orderdate AS TIMESTAMP) AS start_instant, c_name AS location FROM {_O} JOIN customer ON o_custkey = c_custkey WHERE k % 6 <> 0 AND o_custkey % 9 <> 0")
def json_feed_orders(spark, sf_dir):
    """A feed of venues with events inside, for each customer one; some feeds are broken."""
    o = orders(spark, sf_dir).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    item = F.struct("title", F.col("link").alias("event_url"), F.unix_timestamp("o_orderdate").alias("start_at"), F.when(_every(6), "draft").otherwise("published").alias("status"), F.col("c_name").alias("venue"))
    pages = _by_customer(o, item)
    whole = F.to_json(F.struct(F.array(F.struct(F.col("items").alias("upcoming_events"))).alias("venues")))
    body = F.when(F.col("page") % 9 == 0, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    got = readers.json_feed(pages.select(body.alias("body")), "pubs", "$.venues[*].upcoming_events[*]", {"title": "$.title", "url": "$.event_url", "start_instant": "epoch:$.start_at", "location": "$.venue"}, where="try_variant_get(v, '$.status', 'string') = 'published'")
    return got.select("title", "url", F.col("start_instant").cast("timestamp_ntz").alias("start_instant"), "location")


def linked_data(spark, sf_dir) -> DataFrame:
    """A page for each order with one linked-data script: a node, a graph or an array, some of them broken."""
    o = orders(spark, sf_dir)
    kind = F.when(_every(6, 5), "Organization").otherwise("EducationEvent")
    node = F.to_json(F.struct(
        kind.alias("@type"), F.col("title").alias("name"), F.concat("day", F.lit("T"), "hour", F.when(_every(2), ":00+01:00").otherwise(":00")).alias("startDate"),
        F.struct(F.col("o_orderpriority").alias("name"), F.struct(F.lit("1 Road").alias("streetAddress"), F.lit("WC1E 7HU").alias("postalCode")).alias("address")).alias("location"),
        F.struct(F.col("low").alias("lowPrice"), F.col("high").alias("highPrice")).alias("offers"), F.when(_every(4), "https://schema.org/OnlineEventAttendanceMode").when(_every(4, 1), "https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
    ))
    other = F.lit(',{"@type":"Organization","name":"Us"}]')
    shaped = F.when(_every(17), F.concat(F.lit("["), node)).when(_every(3), F.concat(F.lit('{"@graph":['), node, other, F.lit("}"))).when(_every(3, 1), F.concat(F.lit("["), node, other)).otherwise(node)
    return o.select(F.col("link").alias("url"), F.concat(F.lit('<html><head><script type="application/ld+json">'), shaped, F.lit("</script></head></html>")).alias("body"))


@register("json_ld_orders", f"""SELECT title, link AS url, CASE WHEN k % 2 = 0 THEN CAST(day || ' ' || hour AS TIMESTAMP) - INTERVAL 1 HOUR END AS start_instant, CASE WHEN k % 2 = 1 THEN day END AS start_date, CASE WHEN k % 2 = 1 THEN hour END AS start_time, o_orderpriority || ', 1 Road, WC1E 7HU' AS location,
CASE WHEN high = 0 THEN 'Free' WHEN low = 0 THEN 'Free – £' || high || '.00' WHEN low < high THEN '£' || low || '.00 – £' || high || '.00' ELSE '£' || high || '.00' END AS price_text, CASE WHEN k % 4 = 0 THEN true WHEN k % 4 = 1 THEN false END AS online FROM {_O} WHERE k % 17 <> 0 AND k % 6 <> 5""")
def json_ld_orders(spark, sf_dir):
    got = readers.json_ld_events(linked_data(spark, sf_dir), "ld")
    return got.select("title", "url", F.col("start_instant").cast("timestamp_ntz").alias("start_instant"), "start_date", "start_time", "location", "price_text", "online")


@register("rss_orders", f"SELECT o_custkey AS feed, (row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1)::INT AS nth, CASE WHEN k % 2 = 0 THEN title ELSE 'Talk ' || k END AS title, link, day AS published FROM {_O}")
def rss_orders(spark, sf_dir):
    """A feed for each customer, its titles plain or in CDATA sections."""
    title = F.when(_every(2), F.concat(F.lit("<![CDATA["), "title", F.lit("]]>"))).otherwise(F.concat(F.lit("Talk "), _key().cast("string")))
    item = F.concat(F.lit("<item>\n<title>"), title, F.lit("</title><link>"), "link", F.lit("</link><pubDate>"), "day", F.lit("</pubDate></item>"))
    feeds = _by_customer(orders(spark, sf_dir), item).select(F.col("page").cast("string").alias("url"), F.concat(F.lit("<rss><channel>"), F.array_join("items", "\n"), F.lit("</channel></rss>")).alias("body"))
    return readers.rss_items(feeds).select(F.col("url").cast("long").alias("feed"), "nth", "title", "link", "published")


@register("labelled_orders", f"""SELECT 'Talk ' || k || ' on ' || o_orderpriority AS title, day AS start_date, hour AS start_time, CASE WHEN k % 8 <> 0 THEN 'Room ' || o_orderstatus || ', Senate House' END AS location, CASE WHEN k % 3 = 0 THEN 'Free' ELSE '£' || low END AS price_text
FROM {_O} WHERE k % 10 <> 0""")
def labelled_orders(spark, sf_dir):
    """A page for each order that says when and where in lines "label: value"; some list three dates and are round-ups."""
    more = F.when(_every(10), F.concat(F.lit("<p>"), F.date_format(F.date_add("o_orderdate", 40), "d MMMM yyyy"), F.lit("</p><p>"), F.date_format(F.date_add("o_orderdate", 80), "d MMMM yyyy"), F.lit("</p>"))).otherwise("")
    venue = F.when(~_every(8), F.concat(F.when(_every(2), "<p>Venue:</p><p>").otherwise("<p>Venue: "), F.lit("Room "), "o_orderstatus", F.lit(", Senate House</p>"))).otherwise("")
    body = F.concat(
        F.lit("<h1>Talk "), _key().cast("string"), F.lit(" <i>on</i> "), "o_orderpriority", F.lit("</h1><p>Date: "), F.date_format("o_orderdate", "EEEE d MMMM yyyy"), F.lit("</p><ul><li>Time: Doors 7am, talk "), "hour", F.lit("</li></ul>"), venue, F.lit("<div>Price: "), F.when(_every(3), "Free").otherwise(F.concat(F.lit("£"), F.col("low").cast("string"))), F.lit("</div>"), more,
    )
    pages = orders(spark, sf_dir).select(F.col("link").alias("url"), body.alias("body"))
    got = readers.labelled_pages(pages, "s", {"date": "date", "time": "time", "venue": "venue", "price": "price"}, F.lit("1998-01-01").cast("date"))
    return got.select("title", "start_date", "start_time", "location", "price_text")


@register("pagination_guard_orders", f"""WITH p AS (SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS page, CASE WHEN k % 19 = 0 THEN 'HTTP 50' || k % 10 END AS error FROM {_O}), b AS (SELECT source, min(page) AS stop, arg_min(error, page) AS why FROM p WHERE error IS NOT NULL GROUP BY source)
SELECT p.source, page::INT AS page, NULL AS error, NULL AS fatal FROM p LEFT JOIN b ON p.source = b.source WHERE stop IS NULL OR page < stop UNION ALL SELECT source, stop, CASE WHEN stop = 0 THEN why ELSE 'stopped paginating at page ' || stop || ': ' || why END, stop = 0 FROM b""")
def pagination_guard_orders(spark, sf_dir):
    """Each customer's orders as pages, of which some fail: what comes after the first failure isn't read."""
    error = F.when(_every(19), F.concat(F.lit("HTTP 50"), (_key() % 10).cast("string"), F.lit("\nat line 1")))
    pages = _by_customer(orders(spark, sf_dir), F.struct(error.alias("error"), _key().alias("order"))).select(F.col("page").alias("source"), F.posexplode("items").alias("page", "x")).select("source", "page", "x.error")
    read, stopped = readers.later_pages(pages)
    return read.select("source", "page", F.lit(None).cast("string").alias("error"), F.lit(None).cast("boolean").alias("fatal")).unionByName(stopped)


@register("settled_orders", "SELECT o_orderkey AS item, CASE WHEN o_orderkey % 6 = 0 THEN left('HTTP ' || o_orderpriority || ' ' || repeat('x', (o_orderkey % 400)::INT), 300) END AS error FROM orders")
def settled_orders(spark, sf_dir):
    """Items that failed are rows with the first line of their error; the others go on."""
    error = F.when(_every(6), F.concat(F.lit("HTTP "), "o_orderpriority", F.lit(" "), F.repeat(F.lit("x"), (_key() % 400).cast("int")), F.lit("\nTrace: y")))
    good, bad = readers.settled(orders(spark, sf_dir).select(_key().alias("item"), error.alias("error")))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


@register("parsed_orders", f"""SELECT link AS url, CASE WHEN k % 5 = 0 THEN 'invalid JSON at ' || link WHEN k % 7 = 0 THEN 'Cloudflare bot protection at ' || link WHEN k % 9 = 0 THEN 'access blocked (WAF) at ' || link END AS error,
CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 9 <> 0 THEN CASE WHEN k % 2 = 0 THEN o_orderpriority || chr(10) || k ELSE title END END AS title FROM {_O}""")
def parsed_orders(spark, sf_dir):
    """JSON bodies, some with raw line breaks inside texts, some cut off, some a wall in place of an answer."""
    whole = F.when(_every(2), F.concat(F.lit('{"a":1,"title":"'), "o_orderpriority", F.lit("\n"), _key().cast("string"), F.lit('"}'))).otherwise(F.to_json(F.struct("title")))
    body = F.when(_every(5), F.substring(whole, F.lit(1), F.length(whole) - 1)).when(_every(7), F.lit("<title>Just a moment...</title>")).when(_every(9), F.lit("<h1>Access Denied</h1>")).otherwise(whole)
    got = readers.parsed(orders(spark, sf_dir).select(F.col("link").alias("url"), F.when(_every(9), 403).otherwise(200).alias("status"), body.alias("body")))
    return got.select("url", "error", F.try_variant_get("v", "$.title", "string").alias("title"))


@register("walls_of_pages", """SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'Cloudflare bot protection' WHEN page_id % 6 = 2 THEN 'SiteGround captcha' WHEN page_id % 6 = 3 THEN 'access blocked (WAF)' END AS wall,
page_id % 6 IN (1, 2) AND length(html) + CASE page_id % 6 WHEN 1 THEN 28 ELSE 9 END <= 8000 * 5 AS interstitial FROM pages""")
def walls_of_pages(spark, sf_dir):
    """Every page as a response, with a wall's marks in front of some."""
    n = F.col("page_id") % 6
    body = F.concat(F.when(n == 1, "<title>Just a moment...</tit").when(n == 2, "sgcaptcha").when((n == 3) | (n == 4), "Access Denied").otherwise(""), "html")
    p = _t(spark, sf_dir, "pages").select("page_id", body.alias("body"), F.when(n == 3, 403).otherwise(200).alias("status"))
    return p.select("page_id", readers.wall(F.col("status"), F.col("body")).alias("wall"), readers.interstitial(F.col("body")).alias("interstitial"))


@register("fallback_orders", f"""SELECT k, CASE WHEN k % 4 = 3 THEN CASE WHEN k % 3 = 0 THEN 'second ' || k END WHEN k % 4 IN (1, 2) THEN CASE WHEN k % 3 = 0 THEN 'second ' || k WHEN k % 4 = 1 THEN 'refused' ELSE 'Just a moment...' END ELSE 'first ' || k END AS body FROM {_O} WHERE k % 4 <> 3 OR k % 3 = 0""")
def fallback_orders(spark, sf_dir):
    """Two transports: the first is refused for some orders, meets a wall for some, has none of some; the second has a third."""
    o = orders(spark, sf_dir)
    first = o.filter(~_every(4, 3)).select(_key().alias("k"), F.when(_every(4, 1), 403).otherwise(200).alias("status"), F.when(_every(4, 1), "refused").when(_every(4, 2), "Just a moment...").otherwise(F.concat(F.lit("first "), _key().cast("string"))).alias("body"))
    return readers.fallback(first, o.filter(_every(3)).select(_key().alias("k"), F.concat(F.lit("second "), _key().cast("string")).alias("body")), "k")


@register("enriched_orders", f"""SELECT k, coalesce(CASE WHEN k % 4 = 0 THEN 'own' END, CASE WHEN o_custkey % 5 <> 0 THEN c_mktsegment END) AS location, coalesce(CASE WHEN k % 3 = 0 THEN 'own' END, CASE WHEN o_custkey % 5 <> 0 THEN c_name END) AS description FROM {_O} LEFT JOIN customer ON o_custkey = c_custkey""")
def enriched_orders(spark, sf_dir):
    """Listings with what their detail pages add, one look-up for each page; pages that failed add nothing."""
    link = lambda c: F.concat(F.lit("https://t.org/c/"), c.cast("string")).alias("url")
    listing = orders(spark, sf_dir).select(_key().alias("k"), link(F.col("o_custkey")), F.when(_every(4), "own").alias("location"), F.when(_every(3), "own").alias("description"))
    details = _t(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(link(F.col("c_custkey")), F.col("c_mktsegment").alias("location"), F.col("c_name").alias("description"))
    return readers.enrich(listing, details, ("location", "description")).select("k", "location", "description")


@register("captured_orders", """WITH r AS (SELECT o_custkey, sha1('GET https://t.org/c/' || o_custkey || ' ') AS key, o_orderdate AS day, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 100000 MINUTE)
SELECT key, 'https://t.org/c/' || o_custkey AS url, arg_max(o_orderkey, day::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0'))::VARCHAR AS body FROM r GROUP BY ALL""")
def captured_orders(spark, sf_dir):
    """Responses captured in a table: the newest for each request, if it isn't too old."""
    url = F.concat(F.lit("https://t.org/c/"), F.col("o_custkey").cast("string"))
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(_key() / 1_000_000).cast("decimal(18,6)"))  # no two at once
    rows = _t(spark, sf_dir, "orders").select(readers.request_key(F.lit("GET"), url, F.lit(None).cast("string")).alias("key"), url.alias("url"), F.lit(200).alias("status"), _key().cast("string").alias("body"), at.alias("fetched_at"))
    path = new_folder(spark, "captured")
    rows.write.parquet(path)
    return readers.captured(spark, path, F.lit("1998-08-01").cast("timestamp"), 100_000).select("key", "url", "body")


@register("resolved_links", "SELECT page_id, nth, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS link FROM (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS nth FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1) AS l FROM pages))")
def resolved_links(spark, sf_dir):
    """Every link of every page as an absolute one."""
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    p = _t(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links).alias("nth", "href"))
    return p.select("page_id", (F.col("nth") + 1).cast("long").alias("nth"), urls.resolve_url(F.col("href"), F.col("url")).alias("link"))


@register("absolute_urls", "SELECT page_id, CASE WHEN page_id % 4 IN (0, 3) THEN url END AS url FROM pages")
def absolute_urls(spark, sf_dir):
    """Links as pages give them: with spaces around, with spaces inside, relative."""
    n, u = F.col("page_id") % 4, F.col("url")
    given = F.when(n == 0, F.concat(F.lit(" "), u, F.lit("  "))).when(n == 1, F.concat(u, F.lit(" x"))).when(n == 2, F.regexp_replace(u, "^https?:/", "")).otherwise(u)
    return _t(spark, sf_dir, "pages").select("page_id", urls.absolute_url(given).alias("url"))


# --- what a run says of its sources -----------------------------------------------------------------------------


@register("blocked_events", "SELECT event_id, event_type = 'error' AND event_id % 3 = 0 OR event_id % 5 = 0 AND event_id % 2 = 0 AS blocked FROM events")
def blocked_events(spark, sf_dir):
    """Which attempts met a wall, by their errors and warnings."""
    e, n = _t(spark, sf_dir, "events"), F.col("event_id")
    error = F.when((F.col("event_type") == "error") & (n % 3 == 0), F.concat(F.lit("Blocked by "), "event_type")).when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), n.cast("string")))
    warnings = F.array(F.when(n % 5 == 0, F.concat(F.lit("stopped paginating at page 3: "), F.when(n % 2 == 0, "captcha").otherwise("HTTP 500"))).otherwise("bot check on the first"))
    return e.select("event_id", runs.blocked(error, warnings).alias("blocked"))


@register("better_run_events", f"""WITH a AS (SELECT date, source, status, n FROM {_RUNS}), b AS (SELECT date, source, CASE WHEN n % 3 = 0 THEN 'error' ELSE 'ok' END AS status, n + n % 5 - 2 AS n FROM a WHERE n % 2 = 0)
SELECT a.date, a.source, CASE WHEN better THEN b.status ELSE a.status END AS status, CASE WHEN better THEN b.n ELSE a.n END AS kept FROM (SELECT a.date, a.source, coalesce(b.status = 'ok' AND (a.status <> 'ok' OR b.n > a.n), false) AS better FROM a LEFT JOIN b USING (date, source)) c JOIN a USING (date, source) LEFT JOIN b USING (date, source)""")
def better_run_events(spark, sf_dir):
    """A second attempt in place of the first where it did better: sources are told apart by their day."""
    name = F.concat_ws("|", F.col("date").cast("string"), "source").alias("source")
    first = _runs(spark, sf_dir).select(name, "status", F.col("n").alias("kept"))
    again = first.filter("kept % 2 = 0").select("source", F.when(F.col("kept") % 3 == 0, "error").otherwise("ok").alias("status"), (F.col("kept") + F.col("kept") % 5 - 2).alias("kept"))
    got = runs.better_run(first, again)
    return got.select(F.split("source", "\\|")[0].cast("date").alias("date"), F.split("source", "\\|")[1].alias("source"), "status", "kept")


@register("read_back_orders", f"SELECT o_custkey::VARCHAR AS id, count(*) FILTER (k % 3 <> 0 AND k % 4 <> 1 AND k % 5 <> 2) AS n FROM {_O} WHERE o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 GROUP BY 1")
def read_back_orders(spark, sf_dir):
    """Snapshots of customers' orders: which can be trusted, and how many of their records."""
    item = F.struct(F.when(~_every(3), F.col("title")).alias("title"), F.col("link").alias("url"), F.when(_every(4, 1), "soon").otherwise(F.col("day")).alias("date"), F.when(~_every(5, 2), F.lit("x")).alias("start"), F.array(F.lit("Ada")).alias("speakers"))
    pages, page = _by_customer(orders(spark, sf_dir), item), F.col("page")
    got = runs.read_back(pages.select(page.cast("string").alias("id"), F.when(page % 7 == 0, "other").otherwise(page.cast("string")).alias("path_id"), F.when(page % 11 == 0, "never").otherwise("2026-09-25T09:00:00Z").alias("scraped_at"), F.col("items").alias("events")))
    return got.select("id", F.size("events").cast("long").alias("n"))


@register("report_events", f"""WITH r AS (SELECT date, source, status, CASE status WHEN 'error' THEN -1 WHEN 'empty' THEN 0 ELSE n END AS n FROM {_RUNS}), d AS (SELECT DISTINCT date FROM r ORDER BY date DESC LIMIT 5), h AS (SELECT r.* FROM r JOIN d ON r.date = d.date),
m AS (SELECT source, max(n) AS most FROM h GROUP BY source), t AS (SELECT source, arg_max(status, date) AS status FROM r GROUP BY source)
SELECT s.source, upper(s.source) AS name, coalesce(t.status, 'unknown') AS status, coalesce(b.bars, '') AS bars FROM (SELECT source FROM t UNION ALL SELECT 'nothing') s LEFT JOIN t ON s.source = t.source
LEFT JOIN (SELECT h.source, string_agg(CASE WHEN n < 0 THEN 100 ELSE greatest(8, round(n / greatest(1, most) * 100)::INT) END || CASE WHEN n < 0 THEN ':bad:' || strftime(date, '%-d %b') || ': failed' WHEN n = 0 THEN ':warn:' || strftime(date, '%-d %b') || ': 0 events' ELSE '::' || strftime(date, '%-d %b') || ': ' || n || ' events' END, '|' ORDER BY date) AS bars FROM h JOIN m ON h.source = m.source GROUP BY h.source) b ON s.source = b.source""")
def report_events(spark, sf_dir):
    """The page about the last run: each source's status and the bars of its last five runs."""
    r = _runs(spark, sf_dir)
    health = r.groupBy("source").agg(F.max_by("status", "date").alias("status")).withColumns({"name": F.col("source"), "scraped": F.lit(0), "error": F.lit(None).cast("string"), "dropped": F.lit(None).cast("map<string,bigint>"), "last_ok_at": F.lit(None).cast("timestamp"), "carried": F.lit(0)})
    history = runs.history_entry(r, "date").select(F.col("date").cast("timestamp").alias("at"), "counts")
    ids = r.select(F.col("source").alias("id")).distinct().unionByName(spark.createDataFrame([("nothing",)], "id string")).withColumn("name", F.upper("id"))
    got = runs.report(health, history, ids, recent=5)
    return got.select("source", F.when(F.col("source") == "nothing", "NOTHING").otherwise(F.col("name")).alias("name"), "status", F.array_join(F.transform("bars", lambda b: F.concat_ws(":", b["height"].cast("string"), b["kind"], b["label"])), "|").alias("bars"))


# --- sums over cards --------------------------------------------------------------------------------------------


@register("price_range_orders", """SELECT l_orderkey, CASE WHEN hi = 0 THEN 'Free' WHEN lo = 0 THEN 'Free – £' || hi || '.00' WHEN lo < hi THEN '£' || lo || '.00 – £' || hi || '.00' ELSE '£' || hi || '.00' END AS price_text FROM (SELECT l_orderkey, min(l_quantity - l_linenumber % 2 * l_quantity)::INT AS lo, max(l_quantity - l_linenumber % 2 * l_quantity)::INT AS hi FROM lineitem GROUP BY l_orderkey)""")
def price_range_orders(spark, sf_dir):
    """The least and the largest price of each order's items, as a price text."""
    p = F.col("l_quantity") - F.col("l_linenumber") % 2 * F.col("l_quantity")
    n = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(p).alias("low"), F.max(p).alias("high"))
    return n.select("l_orderkey", readers.ticket_price(F.col("low"), F.col("high")).alias("price_text"))


@register("paging_stop_orders", "SELECT l_orderkey AS page, bool_and(CAST(l_shipdate AS DATE) >= DATE '1998-01-01') AS stop FROM lineitem GROUP BY l_orderkey")
def paging_stop_orders(spark, sf_dir):
    """Whether all that an order ships lies past the horizon, so that paging may end there."""
    return catalogue.later_than(_t(spark, sf_dir, "lineitem").withColumn("page", F.col("l_orderkey")), F.to_date("l_shipdate"), F.lit("1998-01-01").cast("date")).select("page", "stop")


@register("listed_ranks_orders", "SELECT l_orderkey, max(l_linenumber)::INT AS last, arg_max(l_quantity::INT, l_linenumber * 1000 + l_quantity) AS total, max(l_linenumber) >= arg_max(l_quantity::INT, l_linenumber * 1000 + l_quantity) AS done FROM lineitem GROUP BY l_orderkey")
def listed_ranks_orders(spark, sf_dir):
    """The largest rank of each order's items, and whether it reaches the count that its last one names."""
    cards = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("rank"), F.col("l_quantity").cast("int").cast("string").alias("total"))
    return catalogue.listed_ranks(cards, "l_orderkey", "rank", "total")


@register("short_errors_of_pages", "SELECT page_id, 'Blocked at ' || regexp_extract(url, '^https?://([^/\\s)]+)', 1) || CASE WHEN page_id % 2 = 0 THEN '' ELSE ' (' || page_id || ')' END AS error FROM pages")
def short_errors_of_pages(spark, sf_dir):
    """Errors that name every page, with its host in place of the link and without what was tried."""
    tried = F.when(F.col("page_id") % 2 == 0, " (challenge did not clear in 20 s)").otherwise(F.concat(F.lit(" ("), F.col("page_id").cast("string"), F.lit(")")))
    return _t(spark, sf_dir, "pages").select("page_id", text.short_error(F.concat(F.lit("Blocked at "), F.regexp_replace("url", r"[\s)]", ""), tried)).alias("error"))


@register("staleness_events", "SELECT event_id, CASE WHEN date_diff('second', ts, TIMESTAMP '2024-01-10 09:00:00') / 3600.0 > 36 THEN floor(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-10 09:00:00') / 86400.0)::BIGINT END AS days FROM events")
def staleness_events(spark, sf_dir):
    """How many days old a build of each event's time would be."""
    return events(spark, sf_dir).select("event_id", runs.staleness_days(F.col("instant"), F.lit("2024-01-10 09:00:00").cast("timestamp")).alias("days"))
