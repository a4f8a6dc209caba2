"""The publish gate: every violated rule as a row.

Records are judged one by one, among their likes (ids and pages that come twice) and by their order; the tables of a
run are reconciled with each other in one pass by source. Nothing here holds a table in one task: order is compared
inside stretches of positions, and across their borders by each stretch's last record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..functions import fixed as X

#: Positions in a stretch of the list, within which one task compares neighbours.
STRETCH = 1 << 20


def violations(rows: DataFrame, checks: dict[str, Column], entity: str) -> DataFrame:
    """(rule, entity): one pass over the rows, a row for each check that holds."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in checks.items())))
    return rows.select(F.explode(found).alias("rule"), F.col(entity).alias("entity"))


def later_of_equals(events: DataFrame, *key: str) -> DataFrame:
    """(position): records whose key an earlier one has. Only keys that come twice are joined back."""
    twice = events.groupBy(*key).agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*(F.col(k).alias(f"twice_{k}") for k in key), "first")
    same = [F.col(k).eqNullSafe(F.col(f"twice_{k}")) for k in key]
    return events.join(twice, same).filter("position > first").select("position")


def out_of_order(events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(position): records that start before the one in front of them. A record without a start is compared with
    neither neighbour."""
    of = events.select("position", "start", F.floor(F.col("position") / stretch).alias("stretch"))
    before = F.lag(F.struct("position", "start")).over(W.partitionBy("stretch").orderBy("position"))
    inside = of.withColumn("before", before)
    ends = of.groupBy("stretch").agg(F.max_by(F.struct("position", "start"), "position").alias("last"))
    # one row a stretch: the last record of the stretch before, whichever that is
    carried = ends.select("stretch", F.lag("last").over(W.orderBy("stretch")).alias("carried"))
    first = inside.filter("before IS NULL").join(carried, "stretch").select("position", "start", F.col("carried").alias("before"))
    return inside.filter("before IS NOT NULL").select("position", "start", "before").unionByName(first).filter(F.col("start") < F.col("before.start")).select("position")


def event_violations(events: DataFrame, sources: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(rule, entity) of published records: events(position, id, source, title, url, date, time, start, speakers,
    description) in the order of their unique positions, sources(id). The entity is the position."""
    known = sources.select(F.col("id").alias("source"), F.lit(True).alias("known")).distinct()
    none = F.lit("")
    checks = {
        "bad-id": ~F.coalesce("id", none).rlike(X.GATE_ID), "unknown-source": F.col("known").isNull(),
        "bad-title": (F.length(F.coalesce("title", none)) < X.GATE_TITLE_MIN) | F.coalesce("title", none).rlike(X.GATE_MARKUP), "bad-url": ~F.coalesce("url", none).rlike(X.GATE_URL),
        "bad-date": F.col("date").isNull(), "bad-time": F.col("time").isNotNull() & ~F.col("time").rlike(X.GATE_TIME),
        "start-disagrees": ~F.col("start").eqNullSafe(dates.from_london(F.col("date"), F.col("time"))),
        "no-speakers-list": F.col("speakers").isNull(), "long-description": F.length("description") > X.GATE_DESCRIPTION_MAX,
    }
    alone = violations(events.join(known, "source", "left"), checks, "position")
    keyed = events.select("position", F.coalesce("id", none).alias("id"), urls.normalize_url(F.col("url")).alias("link"), "date")
    among = {"duplicate-id": later_of_equals(keyed, "id"), "duplicate-page": later_of_equals(keyed, "link", "date"), "not-sorted": out_of_order(events, stretch)}
    for rule, rows in among.items():
        alone = alone.unionByName(rows.select(F.lit(rule).alias("rule"), F.col("position").alias("entity")))
    return alone


def reconciled(health: DataFrame, events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(rule, entity): disagreements by source between health(id, status, count, last_ok_at), the published events(source)
    and snapshots(path_id, id, scraped_at, events: whether it has a list). The three are one union, summed by source."""
    told = health.select(F.col("id").alias("source"), F.lit(0).alias("n"), F.struct("status", "count", "last_ok_at").alias("told"))
    shown = events.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", "n", F.lit(None).cast(told.schema["told"].dataType).alias("told"))
    kept = snapshots.select(F.col("path_id").alias("source"), F.struct("id", "scraped_at", F.col("events").alias("list")).alias("kept"))
    every = told.unionByName(shown).unionByName(kept, allowMissingColumns=True)
    one = every.groupBy("source").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.max("told").alias("told"), F.max("kept").alias("kept")).filter("told IS NOT NULL")
    bad = ~F.col("kept.id").eqNullSafe(F.col("source")) | ~F.coalesce("kept.list", F.lit(False)) | F.col("kept.scraped_at").isNull()
    checks = {
        "count-disagrees": ~F.col("told.count").eqNullSafe(F.col("n")),
        "snapshot-missing": F.col("kept").isNull() & (F.col("told.status") != "error"),
        "snapshot-malformed": F.col("kept").isNotNull() & bad,
        "snapshot-of-another-run": F.col("kept").isNotNull() & ~bad & ~F.col("kept.scraped_at").eqNullSafe(F.col("told.last_ok_at")),
    }
    return violations(one, checks, "source")


def run_violations(totals: DataFrame, health: DataFrame, events: DataFrame, generated_at: Column, least_events: int = X.MIN_EVENTS, least_share: float = X.MIN_OK_SHARE) -> DataFrame:
    """(rule, entity) of a run as a whole: its totals(sources, ok, events), one row, against its lists, and the day of
    its first record against the day before it was made."""
    listed = health.agg(F.count(F.lit(1)).alias("listed")).scalar()
    shown = events.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min_by("date", "position").alias("first"))).scalar()
    yesterday = F.date_sub(dates.london_date(generated_at), 1)
    run = totals.select(F.lit("run").alias("run"), "sources", "ok", "events", listed.alias("listed"), shown.alias("shown"), generated_at.alias("made"))
    checks = {
        "not-made": F.col("made").isNull(), "sources-disagree": F.col("sources") != F.col("listed"), "events-disagree": F.col("events") != F.col("shown.n"),
        "few-sources-ok": (F.col("sources") > 1) & (F.col("ok") / F.nullif(F.col("sources"), F.lit(0)) < least_share), "few-events": F.col("shown.n") < least_events,
        "starts-in-the-past": F.col("shown.first") < yesterday,
    }
    return violations(run, checks, "run")
