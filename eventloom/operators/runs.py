"""A run's health, its history, and what a failed source shows meanwhile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions import fixed as X
from ..functions.regex import java
from ..storage import written


def health(normalized: DataFrame, sources: DataFrame, errors: DataFrame) -> DataFrame:
    """A row for each source: status, scraped, kept, dropped by reason, and its first samples of drops.

    normalized has drop_reason and drop_detail; errors(source, error) names the sources that failed. Counts and samples
    are read from one copy of what they need, so that the rules run once.
    """
    normalized = written(normalized.select("source", "seq", "drop_reason", "drop_detail"), "health")
    by_reason = normalized.groupBy("source", "drop_reason").agg(F.count(F.lit(1)).alias("n"))
    dropped = F.map_from_entries(F.collect_list(F.when(F.col("drop_reason").isNotNull(), F.struct("drop_reason", "n"))))
    counts = by_reason.groupBy("source").agg(F.sum("n").alias("scraped"), F.coalesce(F.sum(F.when(F.col("drop_reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"), dropped.alias("dropped"))
    sampled = normalized.filter("drop_reason IS NOT NULL AND drop_reason NOT IN ('past', 'beyond-horizon')")
    nth = F.row_number().over(W.partitionBy("source").orderBy("seq"))
    sample = F.substring(F.concat_ws(": ", "drop_reason", "drop_detail"), 1, 140)
    samples = sampled.withColumn("nth", nth).filter(F.col("nth") <= X.SAMPLES_MAX).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", sample.alias("s")))), lambda x: x["s"]).alias("drop_samples"))
    out = sources.select(F.col("id").alias("source"), "name")
    for more in (counts, samples, errors):
        out = out.join(more, "source", "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("scraped", F.lit(0)) == 0, "empty").otherwise("ok")
    return out.withColumns({"status": status, "scraped": F.coalesce("scraped", F.lit(0)), "kept": F.coalesce("kept", F.lit(0))})


def totals(runs: DataFrame, by: str) -> DataFrame:
    """runs(by, source, n, status) to a row of totals for each run."""
    of = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("sources"), of("ok").alias("ok"), of("empty").alias("empty"), of("error").alias("failed"), F.sum("n").alias("events"))


def history_entry(runs: DataFrame, by: str) -> DataFrame:
    """A row for each run with a map of counts: -1 for a source that failed, 0 for an empty one."""
    n = F.when(F.col("status") == "error", -1).when(F.col("status") == "empty", 0).otherwise(F.col("n"))
    return runs.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("source", n.alias("n")))).alias("counts"))


def append_history(history: DataFrame, entry: DataFrame) -> DataFrame:
    """The newest runs of history and entry, as many as are kept."""
    return history.unionByName(entry).orderBy(F.desc("at")).limit(X.HISTORY_RUNS)


def sparkline(runs: DataFrame) -> DataFrame:
    """Bar heights in percent of a source's largest run: 8 at least, 100 for a failed run."""
    n = F.when(F.col("status") == "ok", F.col("n")).otherwise(0)
    most = F.greatest(F.lit(1), F.max(n).over(W.partitionBy("source")))
    height = F.when(F.col("status") == "error", 100).otherwise(F.greatest(F.lit(8), F.round(n / most * 100)).cast("int"))
    return runs.select("source", "date", height.alias("height"))


def last_good(failed: DataFrame, snapshots: DataFrame, days: int = X.CARRY_DAYS) -> DataFrame:
    """(source, at, scraped_at): for each run of failed(source, at), the newest of snapshots(source, scraped_at) not
    after it and at most `days` London days old; runs without one are left out.

    An as-of join by equality: a run looks at each day that counts, so it meets few snapshots however many its source
    has, and one source's runs spread over days."""
    today, day = dates.london_date(F.col("at")), dates.london_date(F.col("scraped_at"))
    looked = failed.select("source", "at", F.explode(F.sequence(F.date_sub(today, days), today)).alias("day")).distinct()
    there = snapshots.select("source", "scraped_at", day.alias("day")).distinct()
    return looked.join(there, ["source", "day"]).filter("scraped_at <= at").groupBy("source", "at").agg(F.max("scraped_at").alias("scraped_at"))


def carry_forward(now: DataFrame, failed: DataFrame, snapshots: DataFrame, listable: Column, days: int = X.CARRY_DAYS) -> DataFrame:
    """now(source, at, ...) of runs that worked, and in place of failed(source, at) what their last good
    snapshots(source, scraped_at, ...) still list; listable may use `at`. Where records were also seen is not known any
    more: their also_at is empty."""
    stand_in = snapshots.join(last_good(failed, snapshots, days), ["source", "scraped_at"]).filter(listable).drop("scraped_at")
    if "also_at" in stand_in.columns:
        stand_in = stand_in.withColumn("also_at", F.array().cast(stand_in.schema["also_at"].dataType))
    fresh = now.join(failed.select("source", "at"), ["source", "at"], "left_anti")
    return fresh.withColumn("carried", F.lit(False)).unionByName(stand_in.withColumn("carried", F.lit(True)))


def keep_snapshot(previous: DataFrame, current: DataFrame, status: DataFrame) -> DataFrame:
    """Snapshots(source, scraped_at, ...) after a run: a source that failed keeps its old one, any other the new."""
    failed = status.filter("status = 'error'").select("source")
    return current.join(failed, "source", "left_anti").unionByName(previous.join(failed, "source", "left_semi"))


def staleness_days(generated_at: Column, now: Column) -> Column:
    """Days since a build that is older than 36 hours, else null."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(generated_at)) / 3600
    return F.when(hours > 36, F.floor(hours / 24))


def duration_label(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("long")
    return F.when(s < 60, F.format_string("%d s", s)).otherwise(F.format_string("%d min %d s", F.floor(s / 60), s % 60))


def blocked(error: Column, warnings: Column) -> Column:
    """Whether a run met a wall: its error says so, or a warning that paging stopped does."""
    says = lambda c: c.rlike(java(X.BOT_WALL))
    return F.coalesce(says(error), F.lit(False)) | F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.rlike("(?i)stopped paginating") & says(w))


def better_run(first: DataFrame, again: DataFrame) -> DataFrame:
    """first(source, status, kept, ...), or the row of a second attempt that worked where the first didn't or kept
    fewer records."""
    a, b = (df.select("source", F.struct(*df.columns).alias(n)) for df, n in ((first, "a"), (again, "b")))
    better = F.coalesce((F.col("b.status") == "ok") & ((F.col("a.status") != "ok") | (F.col("b.kept") > F.col("a.kept"))), F.lit(False))
    return a.join(b, "source", "left").select(F.when(better, F.col("b")).otherwise(F.col("a")).alias("r")).select("r.*")


def listed_counts(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Records of each source after duplicates are merged; 0 for a source without any."""
    n = events.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sources.select(F.col("id").alias("source")).join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("count"))


def report(health: DataFrame, history: DataFrame, sources: DataFrame, recent: int = 30) -> DataFrame:
    """A row for each source of the page about the last run: health with labels, and bars of its counts in the most
    recent runs that knew it. history(at, counts); alphabetical by sort_key, which passes over a leading "The"."""
    runs_ = history.orderBy(F.desc("at")).limit(recent).select("at", F.explode("counts").alias("source", "n"))
    most = F.greatest(F.lit(1), F.max("n").over(W.partitionBy("source")))
    bar = F.struct(
        "at", F.when(F.col("n") < 0, 100).otherwise(F.greatest(F.lit(8), F.round(F.col("n") / most * 100)).cast("int")).alias("height"),
        F.when(F.col("n") < 0, "bad").when(F.col("n") == 0, "warn").otherwise("").alias("kind"),
        F.concat(F.date_format(dates.london_wall(F.col("at")), "d MMM"), F.lit(": "), F.when(F.col("n") < 0, "failed").otherwise(F.concat(F.col("n").cast("string"), F.lit(" events")))).alias("label"),
    )
    bars = runs_.select("source", bar.alias("bar")).groupBy("source").agg(F.array_sort(F.collect_list("bar")).alias("bars"))
    by_count = F.array_sort(F.transform(F.map_entries("dropped"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("reason"))))
    day = F.date_format(dates.london_wall(F.col("last_ok_at")), "EEE d MMM")
    out = sources.select(F.col("id").alias("source"), "name").join(health.drop("name"), "source", "left").join(bars, "source", "left")
    return out.select(
        "source", "name", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("scraped", F.lit(0)).alias("scraped"), text.short_error(F.col("error")).alias("error"),
        F.coalesce(F.array_join(F.transform(by_count, lambda x: F.concat_ws(" ", x["reason"], (-x["n"]).cast("string"))), ", "), F.lit("")).alias("dropped"), day.alias("last_ok"),
        F.when((F.col("status") == "error") & (F.col("carried") > 0), day).alias("carried_from"), F.coalesce("bars", F.array().cast(bars.schema["bars"].dataType)).alias("bars"),
        F.lower(F.regexp_replace("name", r"(?i)^the\s+", "")).alias("sort_key"),
    )


def read_back(snapshots: DataFrame) -> DataFrame:
    """Published snapshots(id, path_id, scraped_at, events) that can be trusted: the id is that of the path, the time
    is one, and records without title, link, date, start or speakers are passed over."""
    sound = F.filter("events", lambda e: e["title"].isNotNull() & e["url"].isNotNull() & F.coalesce(e["date"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.lit(False)) & e["start"].isNotNull() & e["speakers"].isNotNull())
    good = snapshots.filter((F.col("id") == F.col("path_id")) & F.try_to_timestamp("scraped_at").isNotNull() & F.col("events").isNotNull())
    return good.select("id", "scraped_at", sound.alias("events"))
