"""Listings of many formats as raw events.

A connector is a table function from captured responses (url, body) to rows of schemas.RAW_EVENT; what differs
between sources of one format is data: field paths, selectors and defaults. Captured responses are a Parquet table
keyed by a hash of the request, so every source can be run again without a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text
from ..functions import fixed as X
from ..functions.html import app_state, html_lines, json_ld
from ..functions.regex import matches, part, swap
from ..functions.text import clean, error_text, lenient_json
from ..schemas import RAW_EVENT


def request_key(method: Column, url: Column, body: Column) -> Column:
    return F.sha1(F.concat_ws(" ", method, url, F.coalesce(body, F.lit(""))).cast("binary"))


def captured(spark: SparkSession, path: str, now: Column, ttl_minutes: int | None = None) -> DataFrame:
    """The newest captured response for each request, none older than ttl_minutes."""
    rows = spark.read.parquet(path)
    if ttl_minutes is not None:
        rows = rows.filter(F.col("fetched_at") >= now - F.make_dt_interval(mins=F.lit(ttl_minutes)))
    newest = rows.groupBy("key").agg(F.max_by(F.struct("url", "status", "body"), "fetched_at").alias("r"))
    return newest.select("key", "r.*")


def wall(status: Column, body: Column) -> Column:
    """The kind of wall that a response is, or null."""
    lead = F.substring(F.coalesce(body, F.lit("")), 1, X.WALL_LEAD)
    out = F.lit(None).cast("string")
    for kind, pattern in reversed((*X.WALL_TEXT, X.WALL_DENIED)):
        met = matches(lead, pattern)
        out = F.when(met & (status == 403) if kind == X.WALL_DENIED[0] else met, kind).otherwise(out)
    return out


def interstitial(body: Column) -> Column:
    """Whether a small response is a check of the visitor, not a page."""
    return (F.length(body) <= X.INTERSTITIAL_MOST) & matches(F.substring(body, 1, X.WALL_LEAD), X.INTERSTITIAL)


def later_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(source, page, error, ...) to those before a source's first failure, and a row (source, page, error,
    fatal) for each failure; it is fatal on the first page, after that paging stops there."""
    bad = pages.filter("error IS NOT NULL").groupBy("source").agg(F.min("page").alias("stop"), F.min_by("error", "page").alias("why"))
    start = pages.groupBy("source").agg(F.min("page").alias("start"))
    read = pages.join(bad, "source", "left").filter("stop IS NULL OR page < stop").select(*pages.columns)
    fatal = F.col("stop") <= F.col("start")
    message = F.when(fatal, error_text(F.col("why"))).otherwise(F.concat(F.lit("stopped paginating at page "), F.col("stop").cast("string"), F.lit(": "), error_text(F.col("why"))))
    return read, bad.join(start, "source").select("source", F.col("stop").alias("page"), message.alias("error"), fatal.alias("fatal"))


def settled(items: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Items that worked, and those that failed, each as a row with the first line of its error."""
    return items.filter(F.col(error).isNull()).drop(error), items.filter(F.col(error).isNotNull()).withColumn(error, error_text(F.col(error)))


def parsed(responses: DataFrame) -> DataFrame:
    """responses(url, status, body) with v, the body as a variant, and error where it is no JSON, naming a wall."""
    v = lenient_json(F.col("body"))
    named = F.coalesce(wall(F.col("status"), F.col("body")), F.lit("invalid JSON"))
    return responses.withColumn("v", v).withColumn("error", F.when(F.col("v").isNull(), F.concat(named, F.lit(" at "), F.col("url"))))


def fallback(primary: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Primary's responses, or the second transport's where the primary met a wall, was refused or has none."""
    met = wall(F.col("status"), F.col("body")).isNotNull() | interstitial(F.col("body")) | F.col("status").isin(401, 403, 429, 503)
    p = primary.withColumn("blocked", F.coalesce(met, F.lit(False)))
    s = second.select(key, F.col("body").alias("other"))
    joined = p.join(s, key, "full")
    return joined.select(key, F.when(~F.col("blocked") & F.col("body").isNotNull(), F.col("body")).otherwise(F.coalesce("other", "body")).alias("body"))


def raw_events(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of RAW_EVENT from the given columns; what isn't given is null."""
    schema = T._parse_datatype_string(RAW_EVENT)
    return df.select(*((columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def json_feed(responses: DataFrame, source: str, rows: str, fields: dict[str, str], where: str | None = None, seq: Column | None = None) -> DataFrame:
    """A JSON API or feed. rows is the path of the array of listings ('[*]' steps may nest); fields map columns of
    RAW_EVENT to paths within a listing, `epoch:` and `wall:` marking times in seconds and wall-clock text."""
    v = responses.withColumn("v", lenient_json(F.col("body"))).filter("v IS NOT NULL")
    position = []
    for i, step in enumerate(s for s in rows.split("[*]") if s not in ("", "$")):
        path = step if step.startswith("$") else f"${step}"
        v = v.select("*", F.posexplode(F.try_variant_get("v", path, "array<variant>")).alias(f"p{i}", "child")).drop("v").withColumnRenamed("child", "v")
        position.append(f"p{i}")
    columns: dict[str, Column] = {"source": F.lit(source), "seq": seq if seq is not None else F.monotonically_increasing_id()}
    for name, path in fields.items():
        kind, _, p = path.rpartition(":")
        if kind == "epoch":
            columns["start_instant"] = F.timestamp_seconds(F.try_variant_get("v", p, "bigint"))
        elif kind == "wall":
            both = dates.parse_wall_clock(F.try_variant_get("v", p, "string"))
            columns |= {"start_date": both["date"], "start_time": both["time"]}
        elif name == "speakers":
            columns[name] = F.try_variant_get("v", p, "array<string>")
        else:
            columns[name] = F.try_variant_get("v", p, "string")
    if where:
        v = v.filter(where)
    return raw_events(v, **columns)


def ticket_price(low: Column, high: Column) -> Column:
    """Free, Free – £x, £a – £b or £a from the least and the largest ticket price."""
    shown = lambda p: F.concat(F.lit("£"), F.format_string("%.2f", p))
    return F.when(high == 0, "Free").when(low == 0, F.concat(F.lit("Free – "), shown(high))).when(low < high, F.concat(shown(low), F.lit(" – "), shown(high))).otherwise(shown(low))


def json_ld_events(pages: DataFrame, source: str) -> DataFrame:
    """Events among the JSON-LD nodes of pages(url, body): @type ending in Event."""
    nodes = json_ld(pages, "url", "body")
    get = lambda p, kind="string": F.try_variant_get("node", p, kind)
    types = F.coalesce(get("$.@type", "array<string>"), F.array(get("$.@type")))
    events = nodes.filter(F.exists(types, lambda t: t.rlike("Event$")))
    start = get("$.startDate")
    both = dates.parse_wall_clock(start)
    place = F.concat_ws(", ", get("$.location.name"), F.coalesce(get("$.location.address.streetAddress"), get("$.location.address")), get("$.location.address.postalCode"))
    low, high = get("$.offers.lowPrice", "double"), get("$.offers.highPrice", "double")
    instant = dates.parse_instant(start)
    mode = get("$.eventAttendanceMode")
    return raw_events(
        events, source=F.lit(source), seq=F.monotonically_increasing_id(), title=get("$.name"), url=F.coalesce(get("$.url"), F.col("url")), start_instant=instant,
        start_date=F.when(instant.isNull(), both["date"]), start_time=F.when(instant.isNull(), both["time"]), end_date=dates.parse_wall_clock(get("$.endDate"))["date"], location=text.none_if_empty(place),
        description=get("$.description"), price_text=F.when(low.isNotNull(), ticket_price(low, F.coalesce(high, low))), online=F.when(mode.endswith("OnlineEventAttendanceMode") & ~mode.contains("Mixed"), True).when(mode.endswith("OfflineEventAttendanceMode"), False),
    )


def rss_items(feeds: DataFrame) -> DataFrame:
    """(url, nth, title, link, published, body) of the items of RSS feeds(url, body)."""
    items = feeds.select("url", F.posexplode(F.regexp_extract_all("body", F.lit("(?is)<item[ >](.*?)</item>"), F.lit(1))).alias("nth", "item"))
    inner = lambda tag: F.regexp_replace(F.trim(F.regexp_extract("item", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), r"(?s)^<!\[CDATA\[(.*)\]\]>\z", "$1")
    return items.select("url", "nth", inner("title").alias("title"), inner("link").alias("link"), inner("pubDate").alias("published"), inner("description").alias("body"))


def labelled_pages(pages: DataFrame, source: str, labels: dict[str, str], now_date: Column) -> DataFrame:
    """Pages(url, body) that give an event as lines "Label: value": labels map date, time, venue, price, speaker and
    title to patterns. A page with more than two different dates is a round-up and gives no event."""
    # lines and values are bound: the filters would have each page parsed again, and each value looked for again
    p = text.bound(pages.withColumn("read", html_lines("body")), lines=F.col("read")).filter(F.size("lines") > 0)
    days = F.array_distinct(F.array_compact(F.transform("lines", lambda line: dates.parse_date(line, now_date))))
    p = text.bound(p, days=days).filter(F.size("days") <= 2)
    p = text.bound(p, **{f"value_{name}": text.labelled(F.col("lines"), pattern) for name, pattern in labels.items()})
    value = {name: F.col(f"value_{name}") for name in labels}
    none = F.lit(None).cast("string")
    return raw_events(
        p, source=F.lit(source), seq=F.monotonically_increasing_id(), title=value.get("title", F.get("lines", F.lit(0))), url=F.col("url"), start_date=dates.parse_date(value.get("date", none), now_date),
        start_time=dates.parse_time(F.coalesce(value.get("time", none), value.get("date", none))), location=value.get("venue", none), price_text=value.get("price", none), speakers=F.when(value.get("speaker", none).isNotNull(), F.array(value.get("speaker", none))),
    )


def enrich(listing: DataFrame, details: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each listing row with what its detail page adds; a row whose page failed stays. One lookup per distinct URL."""
    one = details.groupBy("url").agg(*(F.first(f, ignorenulls=True).alias(f"detail_{f}") for f in fields))
    joined = listing.join(one, "url", "left")
    return joined.withColumns({f: F.coalesce(f, f"detail_{f}") for f in fields}).select(*listing.columns)


def first_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row, by seq, of each key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), "seq").alias("r")).select(*keys, "r.*").select(*rows.columns)


def ticketing(responses: DataFrame, source: str) -> DataFrame:
    """Events of a ticketing platform: responses(url, page, body) of its API, or where that isn't JSON the events
    embedded in the page's application state. Cancelled and incomplete ones are left out."""
    rows = responses.withColumns({"api": F.try_parse_json("body"), "state": app_state(F.col("body"))})
    listed = F.coalesce(F.try_variant_get("api", "$.events", "array<variant>"), F.try_variant_get("state", "$.props.pageProps.upcomingEvents", "array<variant>"))
    e = rows.select("page", F.posexplode(listed).alias("nth", "v"))
    get = lambda p, kind="string": F.try_variant_get("v", p, kind)
    venue = text.none_if_empty(clean(F.concat_ws(", ", text.none_if_empty(get("$.primary_venue.name")), text.none_if_empty(get("$.primary_venue.address.localized_address_display")))))
    tickets = "$.ticket_availability."
    low, high, free = get(tickets + "minimum_ticket_price.major_value", "double"), get(tickets + "maximum_ticket_price.major_value", "double"), get(tickets + "is_free", "boolean")
    sign = F.when(F.coalesce(get(tickets + "minimum_ticket_price.currency"), F.lit("GBP")) == "GBP", "£").otherwise("")
    shown = lambda x: F.concat(sign, F.format_string("%.2f", x))
    price = (
        F.when(free, "Free").when((low == 0) & (high > 0), F.concat(F.lit("Free – "), shown(high))).when(low == 0, "Free")
        .when((low > 0) & (high > low), F.concat(shown(low), F.lit(" – "), shown(high))).when(low > 0, shown(low)).otherwise(get(tickets + "minimum_ticket_price.display"))
    )
    online = get("$.is_online_event", "boolean")
    whole = (F.coalesce(get("$.name"), F.lit("")) != "") & (F.coalesce(get("$.url"), F.lit("")) != "") & (F.coalesce(get("$.start_date"), F.lit("")) != "") & ~F.coalesce(get("$.is_cancelled", "boolean"), F.lit(False))
    return raw_events(
        e.filter(whole), source=F.lit(source), seq=F.col("page").cast("long") * 1000 + F.col("nth"), title=get("$.name"), url=F.split(get("$.url"), "\\?")[0], start_date=get("$.start_date"),
        start_time=F.substring(get("$.start_time"), 1, 5), location=F.when(online, "Online").otherwise(venue), online=online, description=text.none_if_empty(get("$.summary")), price_text=price, free=F.when(free, True),
    )


def conway_price(page_text: Column) -> Column:
    """The price in a page's text: the standard one, else the first, without levies."""
    block = part(clean(page_text), r"\bPrice:\s*(.{0,400})", 1)
    for levy in X.VENUE_LEVY:
        block = swap(block, levy, " ")
    amount = r"£\s?(\d+(?:\.\d{2})?)"
    standard, first = text.none_if_empty(part(block, rf"standard\s*{amount}", 1)), text.none_if_empty(part(block, amount, 1))
    return (
        F.when(matches(block, r"^\s*free\b"), "Free").when(standard.isNotNull(), F.concat(F.lit("£"), standard, F.lit(" (standard)")))
        .when(first.isNotNull(), F.concat(F.lit("£"), first)).when(matches(F.substring(block, 1, 80), r"\bfree\b"), "Free")
    )
