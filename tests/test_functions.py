"""Golden rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import classify, dates, text, urls
from eventloom.functions.html import html_lines, html_text


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def golden(spark, table, fn, kind="string"):
    got = column(spark, [a for a, _ in table], fn, kind)
    assert list(zip([a for a, _ in table], got, strict=True)) == table


def text_of(c):
    return F.when(c.isNotNull(), c.cast("string"))


def test_parse_date(spark):
    today = F.lit("2026-09-25").cast("date")
    golden(spark, [
        ("Monday 28th September 2026", "2026-09-28"), ("28/09/2026", "2026-09-28"), ("September 28, 2026", "2026-09-28"), ("Tue 6 Oct 2026, 6.30pm", "2026-10-06"),
        ("2026-10-01T18:00", "2026-10-01"), ("28–29 September 2026", "2026-09-28"), ("12-15 July 2027", "2027-07-12"), ("28 September–2 October 2026", "2026-09-28"),
        ("Sept 28", "2026-09-28"), ("1 Aug", "2026-08-01"), ("Date TBC", None), ("UK TOUR, Multiple Venues", None), ("", None), (None, None), ("31/02/2026", None),
    ], lambda c: text_of(dates.parse_date(c, today)))
    golden(spark, [("5 January", "2027-01-05")], lambda c: text_of(dates.parse_date(c, F.lit("2026-12-15").cast("date"))))


def test_infer_year(spark):
    assert column(spark, [3], lambda c: dates.infer_year(c, F.lit(1), F.lit("2026-09-25").cast("date")), "int") == [2027]


def test_parse_time(spark):
    golden(spark, [
        ("7pm", "19:00"), ("7.30pm–9pm", "19:30"), ("6.30-8pm", "18:30"), ("11-1pm", "11:00"), ("10.30am-12.30pm", "10:30"), ("19:30", "19:30"), ("07:30", "07:30"), ("7.30", "19:30"),
        ("12 noon", "12:00"), ("11am", "11:00"), ("Doors 6.30pm, talk 7pm", "19:00"), ("Tickets £7.50", None), ("Lasts 3.5 hours", None), ("2 hours", None), ("doors 6.30pm", "18:30"), ("midnight", "00:00"), (None, None),
    ], dates.parse_time)


def test_london_clock(spark):
    shown = lambda c: F.date_format(dates.from_london(F.split(c, " ")[0], F.get(F.split(c, " "), F.lit(1))), "yyyy-MM-dd HH:mm")
    golden(spark, [("2026-09-28 19:00", "2026-09-28 18:00"), ("2026-12-01 19:00", "2026-12-01 19:00"), ("2026-10-25 01:30", "2026-10-25 00:30"), ("2026-10-25 12:00", "2026-10-25 12:00"), ("2026-03-29 01:30", "2026-03-29 01:30"), ("2026-07-01", "2026-06-30 23:00")], shown)
    golden(spark, [("2026-09-28T19:00:00+01:00", "2026-09-28 18:00"), ("2026-09-28T19:00:00Z", "2026-09-28 19:00"), ("2026-09-28T19:00:00", None)], lambda c: F.date_format(dates.parse_instant(c), "yyyy-MM-dd HH:mm"))
    golden(spark, [("2026-11-10T19:00:00+00:00", "2026-11-10 19:00"), ("2026-09-28", "2026-09-28"), ("2026-02-30", None)], lambda c: F.when(dates.parse_wall_clock(c).isNotNull(), F.concat_ws(" ", dates.parse_wall_clock(c)["date"].cast("string"), dates.parse_wall_clock(c)["time"])))
    golden(spark, [("00:00", None), ("18:30", "18:30"), ("25:00", None), (None, None)], dates.none_if_midnight)


def test_free(spark):
    none = F.array().cast("array<string>")
    golden(spark, [("Free", True), ("£0.00", True), ("0.00 GBP", True), ("£15 / £9", False), ("Tickets from £12", False), ("Pay what you can", True), ("Free for members, £10 non-members", False), (None, None)], lambda c: classify.free(c, none))
    golden(spark, [("This event is free to attend, but booking is required.", True), ("Admission: free", True), ("A talk about free speech and free will.", None), ("Standard tickets £15, concessions available", False)], lambda c: classify.free(F.lit(None).cast("string"), F.array(c)))


def test_online(spark):
    golden(spark, [("Online", True), ("Zoom webinar", True), ("Online event", True), ("Conway Hall, 25 Red Lion Square", False), ("Royal Geographical Society and online", False), ("Victoria Hall / Online", False), (None, None)], classify.online_by_location)
    golden(spark, [("This is an online event held on Zoom.", True), ("A hybrid event: join us in person or online.", False), ("Join us in person at the Academy.", False), ("A lecture about the history of maps.", None)], lambda c: classify.online_by_prose(F.array(c)))


def test_places(spark):
    golden(spark, [
        ("Manchester Museum, Oxford Road", True), ("The Old Market, Brighton, BN3 1AS", True), ("Binks Hall, St John’s College Durham, Durham", True), ("Oxford Street", False), ("Leicester Square", False),
        ("Liverpool Street station", False), ("Duke of York Square", False), ("Burlington House, Piccadilly, London W1J 0BE", False), (None, False),
    ], classify.outside_london)
    golden(spark, [("The Royal Institution, 21 Albemarle Street, W1S 4BS", True), ("Imperial College London", True), ("Harwell Campus, Didcot, OX11 0QX", False), ("Maynooth University, County Kildare, Ireland", False), ("", False)], classify.in_london)


def test_text(spark):
    golden(spark, [("<p>Hello&nbsp;<b>world</b></p><p>Second</p>", "Hello world Second"), ("a  b", "a b"), (None, "")], html_text)
    golden(spark, [("<p>Date: Monday</p><p>Venue:</p><p>The Bell</p>", ["Date: Monday", "Venue:", "The Bell"])], html_lines)
    assert column(spark, [["Date: Monday", "Venue:", "The Bell"]], lambda c: text.labelled(c, "venue"), "array<string>") == ["The Bell"]
    golden(spark, [("one two three four five six", "one two three…"), ("short", "short")], lambda c: text.truncate(c, 15))
    golden(spark, [("THE BIG DEBATE: WHO OWNS THE SEA?", "The Big Debate: Who Owns The Sea?"), ("UCL Lunch Hour Lecture", "UCL Lunch Hour Lecture")], text.unshout)
    golden(spark, [("“A talk”", "A talk"), ('"A" and "B"', '"A" and "B"'), ("'x'", "x")], text.strip_wrapping_quotes)
    golden(spark, [("a​b  c\t\n", "ab c"), (None, "")], text.clean)
    golden(spark, [("£12.50 / £9", "from £12.50"), ("£9", "£9"), ("Free", None)], text.short_price)


def test_titles(spark):
    golden(spark, [("SOLD OUT: The Big Talk", "The Big Talk"), ("The Big Talk *Sold Out*", "The Big Talk"), ("The Cancelled Election of 1860", "The Cancelled Election of 1860")], lambda c: text.title_status(c)["title"])
    golden(spark, [("CANCELLED - The Big Talk", True), ("The Cancelled Election of 1860", False), ("SOLD OUT: The Big Talk", False)], lambda c: text.title_status(c)["cancelled"])
    golden(spark, [("In-Person Only: A Talk", "A Talk"), ("A Talk [online]", "A Talk"), ("Online Harms: A Talk", "Online Harms: A Talk")], lambda c: text.format_marker(c)[0])
    golden(spark, [("In-Person Only: A Talk", False), ("A Talk [online]", True), ("Online Harms: A Talk", None)], lambda c: text.format_marker(c)[1])


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [
        ("Unveiling Vermeer", "Unveiling Vermeer: The Man and his Masterpieces", 0, 0.7999),
        ("The Man and his Masterpieces of Vermeer", "Vermeer: The Man and his Masterpieces, with Andrew Graham-Dixon", 0.8, 1),
        ("A history of maps", "The chemistry of bread", 0, 0.1999),
        ("", "The chemistry of bread", 0, 0),
    ],
)
def test_similarity(spark, a, b, low, high):
    tokens = lambda c: text.title_tokens(text.fold(c))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(tokens(F.col("a")).alias("a"), tokens(F.col("b")).alias("b"))
    assert low <= row.select(text.similarity(F.col("a"), F.col("b"))).first()[0] <= high


def test_urls(spark):
    same = column(spark, ["https://www.Example.org/Events/Talk/?utm_source=x&id=2#top", "http://example.org/events/talk?id=2", " Not a URL ", "https://example.org", "https://e.org/a//b/?b=1&a=2"], urls.normalize_url)
    assert same[0] == same[1] == "https://example.org/events/talk?id=2"
    assert same[2:] == ["not a url", "https://example.org/", "https://e.org/a/b?a=2&b=1"]
    golden(spark, [("/relative", None), (" https://a.org/x ", "https://a.org/x"), ("ftp://a.org", None)], urls.absolute_url)
