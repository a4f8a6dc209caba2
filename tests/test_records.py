"""Normalisation, linkage, runs, gate and the query API on golden rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import gate, linkage, normalize, runs
from eventloom.plans.query import QuerySpec, labels, page

def normalized(spark, rows, include=None):
    base = {"source": "test", "title": "A Talk About Maps", "url": "https://example.org/events/maps", "start_date": "2026-10-01", "start_time": "18:30"}
    names = [f.name for f in spark.createDataFrame([], schemas.RAW_EVENT).schema]
    data = [tuple((base | {"seq": i} | r).get(n) for n in names) for i, r in enumerate(rows)]
    raw = spark.createDataFrame(data, schemas.RAW_EVENT)
    sources = spark.createDataFrame([("test", "Test", "https://example.org", None, None, None), ("home", "Home", "https://example.org", True, None, "Test Hall, 1 Test Street, WC1E 7HU")], schemas.SOURCE)
    return normalize.normalize(raw, sources, F.lit("2026-09-25 09:00:00").cast("timestamp"), include=include).orderBy("seq").collect()


def test_a_complete_record(spark):
    e = normalized(spark, [{"description": "<p>Maps &amp; more</p>", "price_text": "Free", "location": "Room 1, Senate House, WC1E 7HU"}])[0]
    assert (e.drop_reason, e.title, str(e.date), e.time, e.start, e.description, e.free, e.online) == (None, "A Talk About Maps", "2026-10-01", "18:30", dt.datetime(2026, 10, 1, 17, 30), "Maps & more", True, False)
    assert len(e.id) == 12


def test_reasons(spark):
    d = dt.date
    cases = [
        ({"start_date": "2026-09-24"}, "past"), ({"start_date": "2026-11-09"}, "beyond-horizon"), ({"end_date": d(2026, 12, 1)}, "long-run"), ({"end_date": d(2026, 10, 7)}, None),
        ({"end_date": d(2026, 10, 8)}, "long-run"), ({"title": "Autumn Exhibition"}, "not-a-talk"), ({"title": "CANCELLED: A Talk About Maps"}, "cancelled"), ({"url": "/relative"}, "invalid"),
        ({"start_date": "2026-02-30"}, "invalid"), ({"start_date": "2026-09-25", "start_time": "09:00"}, None), ({"start_date": "2026-11-08"}, None), ({"title": None}, "invalid"),
        ({"location": "Assembly Rooms, Edinburgh"}, "outside-london"), ({"location": "Assembly Rooms, Edinburgh", "hints": ["Watch online via our livestream"]}, "outside-london"),
        ({"location": "Online"}, "online-only"), ({"title": "A Talk About Maps (Online)", "source": "home"}, "online-only"), ({"online": True, "location": "Senate House, WC1E 7HU"}, "online-only"),
        ({"description": "This is an online event, held on Zoom."}, "online-only"), ({"title": "Fellows' Evening"}, "members-only"), ({"title": "Members only: curator tour"}, "members-only"),
        ({"title": "Friends of RAS (only): Early galaxies"}, "members-only"), ({"title": "Autumn Lecture", "description": "This event is for members only."}, "members-only"),
        ({"title": "Autumn Lecture", "description": "Open to all; members get priority booking."}, None), ({"title": "The Science of Stress: A 4-week course"}, "not-a-talk"),
        ({"title": "Frida: The Making of an Icon: Exhibition Talk"}, None), ({"title": "A crash course in climate science"}, None), ({"title": "The Course of Empire"}, None),
    ]
    got = [r.drop_reason for r in normalized(spark, [c for c, _ in cases])]
    assert list(zip(cases, got, strict=True)) == [(c, c[1]) for c in cases]


def test_defaults_times_and_include(spark):
    got = normalized(spark, [{"source": "home"}, {"location": "Test Hall and online"}, {"location": "Test Hall", "description": "Join us in person or via the livestream."}, {"start_date": "2026-10-12", "start_time": "00:00"}, {"start_date": None, "start_time": None, "start_instant": dt.datetime(2026, 10, 26, 19)}])
    assert (got[0].free, got[0].online, got[0].location) == (True, False, "Test Hall, 1 Test Street, WC1E 7HU")
    assert [r.online for r in got[1:3]] == [False, False]
    assert got[3].time is None and got[4].time == "19:00"
    assert normalized(spark, [{}], include=~F.contains(F.lower("title"), F.lit("maps")))[0].drop_reason == "excluded"


def events(spark, rows):
    base = {"source": "a", "title": "The Secret Life of Sewers", "date": dt.date(2026, 10, 13), "time": "18:30", "location": "The British Academy, Carlton House Terrace", "speakers": [], "also_at": []}
    names = [f.name for f in spark.createDataFrame([], schemas.EVENT).schema]
    return spark.createDataFrame([tuple((base | {"seq": i, "id": str(i), "url": f"https://example.org/e/{i}"} | r).get(n) for n in names) for i, r in enumerate(rows)], schemas.EVENT)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([{"url": "https://example.org/talk?utm_medium=email"}, {"url": "https://www.example.org/talk/", "description": "A long description of the talk that is useful."}], 1),
        ([{"url": "https://example.org/series"}, {"url": "https://example.org/series", "date": dt.date(2026, 10, 20)}], 2),
        ([{"title": "The secret life of sewers", "speakers": ["Rosemary Ashton"]}, {"source": "b", "title": "The Secret Life of Sewers: a panel discussion", "time": "18:45"}], 1),
        ([{}, {"source": "b", "location": "Conway Hall, Red Lion Square"}], 2),
        ([{}, {"source": "b", "time": "10:00"}], 2),
        ([{}, {}], 1),
        ([{}, {"time": "18:45"}], 2),
    ],
)
def test_dedupe(spark, rows, want):
    got = linkage.dedupe(events(spark, rows)).collect()
    assert len(got) == want
    if want == 1 and "description" in rows[1]:
        assert got[0].description == rows[1]["description"]
    if want == 1 and rows[1].get("source") == "b":
        assert [x.source for x in got[0].also_at] == ["b"]


def test_richer_newcomer_keeps_the_place_and_earliest_time(spark):
    rows = [{"url": "https://e.org/x", "time": "20:00"}, {"url": "https://e.org/x", "time": "19:00", "source": "b"}, {"url": "https://e.org/x", "description": "d" * 400, "price": "£5", "time": None, "source": "c"}]
    (got,) = linkage.exact_duplicates(events(spark, rows)).collect()
    assert (got.seq, got.time, got.source, [x.source for x in got.also_at]) == (0, "19:00", "c", ["a"])
    assert got.start == dt.datetime(2026, 10, 13, 18, 0)


def test_health_and_gate(spark):
    rows = [{}, {"title": "CANCELLED: X talk"}, {"start_date": "2026-09-01"}, {"title": "Autumn Exhibition"}]
    sources = spark.createDataFrame([("test", "Test"), ("none", "None"), ("bad", "Bad")], "id string, name string")
    errors = spark.createDataFrame([("bad", "HTTP 500")], "source string, error string")
    raw = spark.createDataFrame([tuple(r) for r in normalized(spark, rows)], "id string, source string, seq long, title string, url string, date date, time string, start timestamp, location string, description string, speakers array<string>, free boolean, online boolean, price string, also_at array<struct<source:string,url:string>>, drop_reason string, drop_detail string")
    got = {r.source: r for r in runs.health(raw, sources, errors).collect()}
    assert (got["test"].status, got["test"].scraped, got["test"].kept) == ("ok", 4, 1)
    assert got["test"].dropped == {"cancelled": 1, "past": 1, "not-a-talk": 1}
    assert got["test"].drop_samples == ["cancelled: X talk", "not-a-talk: Autumn Exhibition"]
    assert got["none"].status == "empty" and got["bad"].status == "error"
    start = dt.datetime(2026, 10, 13, 17, 30)
    shown = events(spark, [{"id": "0123456789ab", "start": start}, {"id": "x", "url": "/y", "source": "zzz", "start": start}]).withColumnRenamed("seq", "position")
    bad = gate.event_violations(shown, sources.withColumn("id", F.when(F.col("id") == "test", "a").otherwise(F.col("id"))))
    assert {(r.rule, r.entity) for r in bad.collect()} == {("bad-id", 1), ("bad-url", 1), ("unknown-source", 1)}


def test_query_spec():
    spec = QuerySpec.from_query_string("?when=month&price=free&q=%C3%89lan+Vital&off=b,zz", ("a", "b"))
    assert spec == QuerySpec("month", "free", "Élan Vital", ("b",)) and spec.terms == ["elan", "vital"]
    assert QuerySpec.from_query_string("when=never&price=cheap") == QuerySpec()
    assert QuerySpec().to_query_string() == "" and QuerySpec.from_query_string(spec.to_query_string()) == spec
    assert QuerySpec.from_query_string("when=date&date=2026-10-05").date == "2026-10-05"


def test_stored_choices_count_only_without_a_query():
    stored = QuerySpec("month", "paid", "maps", ("a", "gone")).to_stored()
    assert QuerySpec.from_query_string("", ("a", "b"), stored) == QuerySpec("month", "paid", "", ("a",))
    assert QuerySpec.from_query_string("?q=bees", ("a", "b"), stored) == QuerySpec(q="bees")
    assert QuerySpec.from_query_string("?off=b", ("a", "b"), stored) == QuerySpec(off=("b",))
    assert QuerySpec.from_query_string("?utm=1", ("a", "b"), stored).price == "paid"
    assert QuerySpec(when="date", date="2026-10-05").to_stored("today") == QuerySpec("today").to_stored()
    for broken in ("{", "[]", "null", '{"when": 3, "off": 7}', '{"when": "never", "price": "cheap"}'):
        assert QuerySpec.from_query_string("", ("a",), broken) == QuerySpec()


def test_page_and_labels(spark):
    rows = [{"title": "b", "time": None}, {"title": "a", "time": None}, {"title": "z", "time": "09:00"}, {"title": "y", "time": "09:00", "date": dt.date(2026, 10, 12)}]
    got = labels(page(events(spark, rows)), F.lit("2026-10-12 10:00:00").cast("timestamp")).collect()
    assert [(r.title, r.relative, r.past) for r in got] == [("y", "Today", True), ("z", "Tomorrow", False), ("a", "Tomorrow", False), ("b", "Tomorrow", False)]
    assert got[0].day == "Monday 12 October"


def test_history_and_snapshots(spark):
    hist = spark.createDataFrame([(i,) for i in range(95)], "at int")
    assert runs.append_history(hist, spark.createDataFrame([(95,)], "at int")).count() == 90
    old, new = (spark.createDataFrame([(s, v) for s in "ab"], "source string, v int") for v in (1, 2))
    status = spark.createDataFrame([("a", "error"), ("b", "empty")], "source string, status string")
    assert {(r.source, r.v) for r in runs.keep_snapshot(old, new, status).collect()} == {("a", 1), ("b", 2)}
    shown = spark.range(1).select(runs.duration_label(F.lit(514000)).alias("d"), runs.staleness_days(F.lit("2026-10-01 00:00:00").cast("timestamp"), F.lit("2026-10-03 12:00:00").cast("timestamp")).alias("s")).first()
    assert tuple(shown) == ("8 min 34 s", 2)


def test_titles_descriptions_and_turns_are_whole(spark, tmp_path):
    from eventloom.plans import records

    line = "word " * 60 + "end"
    spark.createDataFrame([(2, f"{line}\n{'x' * 500}", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, line)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    e = records.documents_as_events(spark, str(tmp_path)).first()
    assert (e.title, len(e.description)) == (line, len(line) + 501)
    assert [r.word for r in records.explode_sessions(spark, str(tmp_path)).orderBy("nth").collect()] == line.split(" ")


def test_passes_move_no_descriptions(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4).select(
        F.col("id").cast("string").alias("id"), F.lit("a").alias("source"), F.col("id").alias("seq"), F.lit("Maps of the world").alias("title"), F.lit("https://e.org/x").alias("url"), F.lit("2026-10-01").cast("date").alias("date"), F.lit("18:30").alias("time"),
        F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("string").alias("location"), F.when(F.col("id") == 2, "told").alias("description"), F.array().cast("array<string>").alias("speakers"), F.lit(None).cast("boolean").alias("free"),
        F.lit(None).cast("boolean").alias("online"), F.lit(None).cast("string").alias("price"), F.array().cast("array<struct<source:string,url:string>>").alias("also_at"),
    )
    (got,) = linkage.dedupe(docs, descriptions=False).collect()
    assert "description" not in got.asDict() and (got.described, got.described_by) == (4, 2)
    assert linkage.dedupe(docs).first().description == "told"


def test_what_drops_early_is_read_no_further(spark):
    """rows that title, link or days drop cost no reading of their texts; their rule stays the first."""
    more = {"description": "<p>For members only</p>", "location": "Leeds", "price_text": "Free"}
    got = normalized(spark, [more | {"start_date": "2026-09-24"}, more | {"start_date": "2026-12-01"}, more | {"title": "On"}, {"start_date": "2026-12-01", "location": "Leeds"}, {"start_date": "2026-10-1"}, {"description": "x " * 300 + "for members only", "location": "Leeds"}])
    assert [r.drop_reason for r in got] == ["past", "members-only", "invalid", "beyond-horizon", "invalid", "outside-london"]
    assert [(r.description, r.location, r.free, r.speakers) for r in got[:5] if r.drop_reason != "members-only"] == [(None, None, None, None)] * 4
    assert got[4].drop_detail == 'bad date for "A Talk About Maps"'


def test_sources_are_broadcast_and_rules_run_once(spark):
    raw, sources = spark.createDataFrame([], schemas.RAW_EVENT), spark.createDataFrame([], schemas.SOURCE)
    e = normalize.normalize(raw, sources, F.lit("2026-09-25 09:00:00").cast("timestamp"))
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    health = runs.health(e, sources, spark.createDataFrame([], "source string, error string"))
    assert "ArrowEvalPython" not in health._jdf.queryExecution().executedPlan().toString()


def test_labelled_pages_are_parsed_once(spark):
    """the filters on lines and days don't repeat the parser."""
    from eventloom.sources import readers

    pages = spark.createDataFrame([("u", "<h1>Maps</h1><p>Date: 3 May 2026</p><p>Time: 6.30pm</p>"), ("r", "<p>3 May 2026</p><p>4 May 2026</p><p>5/5/2026</p>")], "url string, body string")
    got = readers.labelled_pages(pages, "s", {"date": "date", "time": "time"}, F.lit("2026-01-01").cast("date"))
    assert [(r.title, r.start_date, r.start_time) for r in got.collect()] == [("Maps", "2026-05-03", "18:30")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
