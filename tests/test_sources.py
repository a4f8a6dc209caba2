"""Connectors on invented pages of each format, sinks and the increment stream."""

import json

from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.sources import readers, sinks
from eventloom.streaming import increments


def test_nested_json_feed(spark):
    feed = {"venues": [
        {"name": "The Bell", "upcoming_events": [{"title": "One", "start_at": 1790877600, "event_url": "https://e.org/1", "status": "published"}, {"title": "Two", "start_at": 1790877600, "event_url": "https://e.org/2", "status": "draft"}]},
        {"name": "The Fox", "upcoming_events": [{"title": "Three", "start_at": 1790964000, "event_url": "https://e.org/3", "status": "published"}]},
    ]}
    df = spark.createDataFrame([("u", json.dumps(feed)), ("v", "{broken")], "url string, body string")
    got = readers.json_feed(df, "pubs", "$.venues[*].upcoming_events[*]", {"title": "$.title", "url": "$.event_url", "start_instant": "epoch:$.start_at"}, where="try_variant_get(v, '$.status', 'string') = 'published'").collect()
    assert sorted((r.title, r.url, r.source) for r in got) == [("One", "https://e.org/1", "pubs"), ("Three", "https://e.org/3", "pubs")]
    assert all(r.start_instant is not None for r in got)


def test_json_ld(spark):
    node = {"@graph": [{"@type": "EducationEvent", "name": "A Talk", "startDate": "2026-10-01T18:30:00+01:00", "location": {"name": "Hall", "address": {"streetAddress": "1 Road", "postalCode": "WC1E 7HU"}}, "offers": {"lowPrice": 0, "highPrice": 12}}, {"@type": "Organization", "name": "Us"}]}
    page = f'<script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">oops</script>'
    (r,) = readers.json_ld_events(spark.createDataFrame([("https://e.org/1", page)], "url string, body string"), "s").collect()
    assert (r.title, r.url, r.location, r.price_text) == ("A Talk", "https://e.org/1", "Hall, 1 Road, WC1E 7HU", "Free – £12.00")
    assert str(r.start_instant) == "2026-10-01 17:30:00"


def test_rss_and_labelled_pages(spark):
    rss = "<rss><item><title><![CDATA[A & B]]></title><link>https://e.org/1</link><pubDate>x</pubDate></item><item><title>C</title><link>https://e.org/2</link></item></rss>"
    got = readers.rss_items(spark.createDataFrame([("f", rss)], "url string, body string")).orderBy("nth").collect()
    assert [(r.title, r.link) for r in got] == [("A & B", "https://e.org/1"), ("C", "https://e.org/2")]
    page = "<h1>On Maps</h1><p>Date: Thursday 1 October 2026</p><p>Time: 7.30pm</p><p>Venue:</p><p>The Bell</p>"
    roundup = "<p>Date: 1 October 2026</p><p>2 October 2026</p><p>3 October 2026</p>"
    df = spark.createDataFrame([("a", page), ("b", roundup)], "url string, body string")
    (r,) = readers.labelled_pages(df, "s", {"date": "date", "time": "time", "venue": "venue"}, F.lit("2026-09-25").cast("date")).collect()
    assert (r.title, r.start_date, r.start_time, r.location) == ("On Maps", "2026-10-01", "19:30", "The Bell")


def test_enrich_walls_and_fallback(spark):
    listing = spark.createDataFrame([("a", None), ("b", "kept")], "url string, location string")
    details = spark.createDataFrame([("a", "Hall"), ("a", "Other"), ("b", "x")], "url string, location string")
    assert {(r.url, r.location) for r in readers.enrich(listing, details, ("location",)).collect()} == {("a", "Hall"), ("b", "kept")}
    one = spark.createDataFrame([("1", 200, "page"), ("2", 403, "no"), ("3", 200, "Just a moment...")], "k string, status int, body string")
    two = spark.createDataFrame([("2", "second"), ("4", "only")], "k string, body string")
    assert {(r.k, r.body) for r in readers.fallback(one, two, "k").collect()} == {("1", "page"), ("2", "second"), ("3", "Just a moment..."), ("4", "only")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "</script>", 2), ("b", "y", 1)], "source string, title string, start int")
    sources = spark.createDataFrame([("a", "A", "h")], "id string, name string, homepage string")
    r = sinks.published(rows, sources, F.lit("2026-10-01").cast("timestamp"), 45).select(F.col("events.title").alias("t"), sinks.page_payload(F.struct("events")).alias("p")).first()
    assert r.t == ["y", "</script>"] and "<" not in r.p


def test_runs_keep_what_failed_sources_had(spark, tmp_path):
    path = f"{tmp_path}/state"

    def store(day, events, health, **more):
        run = f"2026-10-{day:02}"
        sinks.write_run(path, run, F.lit(run).cast("timestamp"), spark.createDataFrame(events, "source string, title string"), spark.createDataFrame(health, "source string, status string"), **more)

    def state():
        return [(r.source, r.run[-2:], r.event.title if r.event else None) for r in sinks.read_snapshots(spark, path).collect()]

    store(1, [("a", "1"), ("01", "x"), ("b/c", "y")], [("a", "ok"), ("01", "ok"), ("b/c", "ok"), ("d", "error")])
    store(2, [("a", "2"), ("01", "half of it")], [("a", "ok"), ("01", "error"), ("b/c", "empty")])
    want = [("01", "01", None), ("01", "01", "x"), ("a", "02", None), ("a", "02", "2"), ("b/c", "02", None)]
    assert sorted(state(), key=str) == sorted(want, key=str)
    store(2, [("a", "2"), ("01", "half of it")], [("a", "ok"), ("01", "error"), ("b/c", "empty")])  # once more
    assert sorted(state(), key=str) == sorted(want, key=str)
    # a run that was broken off before its commit
    late = spark.createDataFrame([("a", "2026-10-03", "3")], "source string, run string, title string").select("source", "run", F.lit("2026-10-03").cast("timestamp").alias("scraped_at"), F.struct("title").alias("event"))
    sinks._replace(late, f"{path}/snapshots", "source", "run")
    assert sorted(state(), key=str) == sorted(want, key=str)
    for day in range(4, 7):
        store(day, [("a", str(day))], [("a", "ok"), ("01", "error")], kept_runs=3)
    assert sorted({r.run for r in sinks.read_runs(spark, path).collect()}) == ["2026-10-04", "2026-10-05", "2026-10-06"]
    assert ("a", "06", "6") in state() and {r.run for r in spark.read.parquet(f"{path}/snapshots").filter("source = 'a'").collect()} == {"2026-10-03", "2026-10-04", "2026-10-05", "2026-10-06"}


def test_health_as_lines(spark):
    got = {r.name: r.json for r in sinks.health_json(spark.createDataFrame([(2, 1)], "sources int, ok int"), spark.createDataFrame([("a", "ok", None)], "source string, status string, error string")).collect()}
    assert got == {"totals": '{"sources":2,"ok":1}', "a": '{"source":"a","status":"ok","error":null}'}


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = increments.publish_increments(increments.first_seen(stream, ["event_id"], "90 days"), f"{tmp_path}/cp", lambda df, i: seen.append(df.count()))
    q.awaitTermination(120)
    assert sum(seen) == events.count()
    assert increments.daily_counts(events).agg(F.sum("n")).first()[0] == events.count()
    assert spark.createDataFrame([], schemas.RAW_EVENT).columns[0] == "source"
