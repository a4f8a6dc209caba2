"""Raw events to strict records, or to the first rule that drops them.

Every rule is a column, a CASE takes the first that fails, and the caller splits on it. A source's defaults come from a
small dimension table, a row for each source, which is broadcast: joined by a shuffle, few sources would be few tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, names, text, urls
from ..functions import fixed as X
from ..functions.html import html_text
from ..functions.regex import matches, swap


def horizon(now: Column, days: int = X.HORIZON_DAYS) -> tuple[Column, Column]:
    """First London date shown and the first no longer shown."""
    today = dates.london_date(now)
    return today, F.date_add(today, days)


#: Neither pattern of members matches without one of these words: most texts have none, and are spared the patterns.
_MEMBERS_HINT = "[mf](?:embers|ellows|riends)"


def is_exhibition_or_course(title: Column) -> Column:
    return matches(title, X.EXHIBITION) & ~matches(title, X.BUT_A_TALK)


def is_members_only(title: Column, description: Column) -> Column:
    lead = F.substring(description, 1, 400)
    return matches(title, _MEMBERS_HINT) & matches(title, X.MEMBERS_TITLE) | matches(lead, _MEMBERS_HINT) & matches(lead, X.MEMBERS_LEAD)


def still_listable(events: DataFrame, now: Column, days: int = X.HORIZON_DAYS) -> Column:
    """Whether a record of an earlier run would still be listed."""
    first, beyond = horizon(now, days)
    return (
        (F.col("date") >= first) & (F.col("date") < beyond) & ~F.col("online").eqNullSafe(True) & ~classify.outside_london(F.col("location"))
        & ~is_exhibition_or_course(F.col("title")) & ~is_members_only(F.col("title"), F.coalesce("description", F.lit("")))
    )


def _first(rules: list[tuple[Column, str, Column]]) -> Column:
    """struct(reason, detail) of the first rule that holds, else null."""
    failed = F.lit(None).cast("struct<reason:string,detail:string>")
    for when, reason, detail in reversed(rules):
        failed = F.when(when, F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))).otherwise(failed)
    return failed


def normalize(raw: DataFrame, sources: DataFrame, now: Column, days: int = X.HORIZON_DAYS, include: Column | None = None, given_names: Iterable[str] = ()) -> DataFrame:
    """raw (schemas.RAW_EVENT) with sources (schemas.SOURCE) to records plus drop_reason and drop_detail.

    include is a predicate over the records; rows that it turns down are `excluded`. Speakers that a source doesn't
    give are read from the title; given_names are the first names that names.speakers_from_title believes. Rows without a drop_reason
    are the records to publish. Rules go in order, so a row that its title, link or days drop is read no further: of it, and
    of one beyond the horizon, location, description, speakers, free, online and price are null.
    """
    first, beyond = horizon(now, days)
    defaults = sources.select(F.col("id").alias("source"), "default_free", "default_online", "default_location")
    e = raw.join(F.broadcast(defaults), "source", "left")
    quoted = lambda what, t: F.concat(F.lit(f'{what} for "'), t, F.lit('"'))
    nothing = F.lit(None).cast("string")

    # title, link and days
    e = text.bound(e.withColumn("title_text", html_text("title")), status=text.title_status(F.col("title_text")))
    title, marked_online = text.format_marker(F.col("status.title"))
    wall = F.col("start_instant").isNotNull()
    day = F.when(wall, dates.london_date(F.col("start_instant"))).otherwise(F.when(F.col("start_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.col("start_date").try_cast("date")))
    time = dates.none_if_midnight(F.when(wall, dates.london_time(F.col("start_instant"))).otherwise(F.col("start_time")))
    e = text.bound(e, title=title, marked_online=marked_online, link=urls.absolute_url(F.col("url")), date=day, time=time)
    e = text.bound(e, early=_first([
        (F.length("title") < 3, "invalid", F.lit("missing title")),
        (F.col("status.cancelled"), "cancelled", F.col("title")),
        (F.col("link").isNull(), "invalid", quoted("bad url", F.col("title"))),
        (F.col("date").isNull(), "invalid", quoted("bad date", F.col("title"))),
        (F.coalesce(F.datediff("end_date", "date") + 1 > X.MAX_RUN_DAYS, F.lit(False)), "long-run", F.col("title")),
        (F.col("date") < first, "past", nothing),
    ]))

    # what is left to read: the description up to the horizon's rule, the rest within the horizon
    near = F.col("early").isNull() & (F.col("date") < beyond)
    e = e.withColumns({"full": html_text(F.when(F.col("early").isNull(), F.col("description"))), "where": html_text(F.when(near, F.col("location")))})
    price = text.none_if_empty(text.clean(swap(F.coalesce("price_text", F.lit("")), r"https?:\/\/[^\s]+", " ")))
    place = text.none_if_empty(text.clean(F.col("where")))
    e = text.bound(e, near=near)
    e = text.bound(
        e, place=F.when(F.col("near") & place.isNotNull(), text.truncate(place, X.LOCATION_MAX)), price=F.when(F.col("near") & price.isNotNull(), text.truncate(price, X.PRICE_MAX)),
        hint_texts=F.when(F.col("near"), F.filter(F.transform(F.coalesce("hints", F.array().cast("array<string>")), text.clean), lambda h: h != "")),
    )
    is_free = F.coalesce("free", classify.free(F.col("price"), F.concat(F.array("full"), F.col("hint_texts"))), F.col("default_free"))
    in_title = F.when(matches(F.col("title"), X.ONLINE_IN_TITLE) & ~matches(F.coalesce("place", F.lit("")), r"\b(?:hybrid|in[\s-]person)\b"), True)
    at_home = F.when(F.col("place").isNull() & F.col("default_location").isNotNull(), False)
    is_online = F.coalesce("online", "marked_online", in_title, classify.online_by_location(F.col("place")), classify.online_by_prose(F.concat("hint_texts", F.array("full"))), "default_online", at_home)
    e = text.bound(e, online=F.when(F.col("near"), is_online), location=F.when(F.col("near"), F.coalesce("place", "default_location")))
    late = F.when(F.col("early").isNotNull(), F.col("early")).otherwise(_first([
        (is_members_only(F.col("title"), F.col("full")), "members-only", F.col("title")),
        (F.col("date") >= beyond, "beyond-horizon", nothing),
        (is_exhibition_or_course(F.col("title")), "not-a-talk", F.col("title")),
        (F.col("online").eqNullSafe(True), "online-only", F.col("title")),
        (classify.outside_london(F.col("location")), "outside-london", F.concat_ws(" @ ", "title", "location")),
    ]))
    e = text.bound(e, failed=late)

    described = F.when((F.col("full") != "") & (F.lower("full") != F.lower("title")), text.truncate(F.col("full"), X.DESCRIPTION_MAX))
    said = F.when(F.col("near"), F.coalesce("speakers", F.array().cast("array<string>")))
    found = names.speakers_from_title(F.when(F.size(said) == 0, F.col("title")), nothing, given_names)
    people = F.filter(names.unique_names(F.when(F.size(said) > 0, said).otherwise(found)), lambda s: F.length(s).between(3, 80))
    people = F.slice(F.filter(people, lambda s: F.lower(s) != F.lower(F.col("title"))), 1, X.SPEAKERS_MAX)
    only = lambda c: F.when(F.col("near"), c)
    out = e.select(
        urls.event_id(F.col("source"), F.col("link"), F.col("date"), F.col("time")).alias("id"), "source", "seq", "title", F.col("link").alias("url"), "date", "time",
        dates.from_london(F.col("date"), F.col("time")).alias("start"), "location", only(described).alias("description"), only(people).alias("speakers"), only(is_free).alias("free"), "online", "price",
        F.array().cast("array<struct<source:string,url:string>>").alias("also_at"), F.col("failed.reason").alias("drop_reason"), F.col("failed.detail").alias("drop_detail"),
    )
    if include is not None:
        turned = F.col("drop_reason").isNull() & ~F.coalesce(include, F.lit(False))
        out = out.withColumns({"drop_reason": F.when(turned, "excluded").otherwise(F.col("drop_reason")), "drop_detail": F.when(turned, F.col("title")).otherwise(F.col("drop_detail"))})
    return out
