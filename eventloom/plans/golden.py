"""Stated cases: each function, connector or rule on inputs whose results are stated in the SQL. They are tests, not queries.

The scalar functions meet the tables' texts in the other modules; what a table's invented texts never contain
(times behind "doors", statuses in titles, places, prices, names) is stated here, input by input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, names, text, urls
from ..functions import html as H
from .registry import state

#: name to (Spark columns of the input, cases); a case is an input and its result as text.
CASES: dict[str, list[tuple]] = {}


def literal(x) -> str:
    return "NULL::VARCHAR" if x is None else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """SELECT over the rows as SQL."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) and not isinstance(x, bool) else literal(x) for x in r) + ')' for r in rows)}) AS t({columns})"


def golden(name: str, cases: list[tuple], compute: Callable[[Column], Column], kind: str = "string") -> None:
    """States (nth, result): compute over each case's input, as text."""
    CASES[name] = cases

    def run(spark, sf_dir) -> DataFrame:
        rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], f"nth int, v {kind}")
        return rows.select("nth", compute(F.col("v")).cast("string").alias("result"))

    state(name, values([(i, b) for i, (_, b) in enumerate(cases)], "nth, result"))(run)


def _flag(c: Column) -> Column:
    return F.when(c, "true").when(~c, "false")


def _list(c: Column) -> Column:
    return F.array_join(c, "|")


_NOW = "2026-09-25"


def _today() -> Column:
    return F.lit(_NOW).cast("date")


golden("parse_date_cases", [
    ("Monday 28th September 2026", "2026-09-28"), ("28/09/2026", "2026-09-28"), ("September 28, 2026", "2026-09-28"), ("Tue 6 Oct 2026, 6.30pm", "2026-10-06"), ("2026-10-01T18:00", "2026-10-01"),
    ("28–29 September 2026", "2026-09-28"), ("12-15 July 2027", "2027-07-12"), ("28 September–2 October 2026", "2026-09-28"), ("Sept 28", "2026-09-28"), ("1 Aug", "2026-08-01"), ("Date TBC", None),
    ("UK TOUR, Multiple Venues", None), ("", None), (None, None), ("31/02/2026", None), ("31/02/2026 or 3 March 2026", "2026-03-03"), ("29 Feb", None), ("29 February 2028", "2028-02-29"), ("5.10.26", "2026-10-05"),
    ("2026-13-01", None), ("2nd of March", "2027-03-02"), ("1 Oct 2026", "2026-10-01"), ("Oct 12th, 2026 and 3 Nov 2026", "2026-11-03"),
], lambda c: dates.parse_date(c, _today()))

golden("parse_time_cases", [
    ("7pm", "19:00"), ("7.30pm–9pm", "19:30"), ("6.30-8pm", "18:30"), ("11-1pm", "11:00"), ("10.30am-12.30pm", "10:30"), ("19:30", "19:30"), ("07:30", "07:30"), ("7.30", "19:30"), ("12 noon", "12:00"), ("11am", "11:00"),
    ("Doors 6.30pm, talk 7pm", "19:00"), ("Tickets £7.50", None), ("Lasts 3.5 hours", None), ("2 hours", None), ("doors 6.30pm", "18:30"), ("midnight", "00:00"), (None, None), ("", None), ("Doors 6.30-7pm", "19:00"),
    ("11.30-noon", "11:30"), ("12am", "00:00"), ("12.15pm", "12:15"), ("9.30 to 11 a.m.", "09:30"), ("from 14:00:00 on", "14:00"), ("10.5%", None), ("18.45 and £12.50", "18:45"), ("7 p.m.", "19:00"), ("6 until 8pm", "18:00"),
    ("8.15 till 9pm", "20:15"), ("At 8.15, doors 7", "08:15"),
], dates.parse_time)

golden("parse_date_time_cases", [
    ("Tue 6 Oct 2026, 6.30pm", "2026-10-06 18:30"), ("28 Sep 2026 19:00 - 20:30", "2026-09-28 19:00"), ("Mon 28 Sep 2026 7:00 PM - 8:30 PM", "2026-09-28 19:00"), ("30/09/2026", "2026-09-30"),
    ("2026-10-01T18:00:00", "2026-10-01 18:00"), ("7pm", None), (None, None),
], lambda c: text.let(dates.parse_date_time(c, _today()), lambda x: F.when(x.isNotNull(), F.concat_ws(" ", x["date"].cast("string"), x["time"]))))

golden("infer_year_cases", [("3-1", "2027"), ("9-28", "2026"), ("8-1", "2026"), ("7-27", "2026"), ("7-26", "2027"), ("1-5", "2027")], lambda c: dates.infer_year(F.split(c, "-")[0].cast("int"), F.split(c, "-")[1].cast("int"), _today()))

golden("from_london_cases", [
    ("2026-09-28 19:00", "2026-09-28 18:00"), ("2026-12-01 19:00", "2026-12-01 19:00"), ("2026-10-25 01:30", "2026-10-25 00:30"), ("2026-10-25 12:00", "2026-10-25 12:00"), ("2026-03-29 01:30", "2026-03-29 01:30"), ("2026-07-01", "2026-06-30 23:00"),
], lambda c: F.date_format(dates.from_london(F.split(c, " ")[0], F.get(F.split(c, " "), F.lit(1))), "yyyy-MM-dd HH:mm"))

golden("parse_instant_cases", [("2026-09-28T19:00:00+01:00", "2026-09-28 18:00"), ("2026-09-28T19:00:00Z", "2026-09-28 19:00"), ("2026-09-28T19:00:00", None), ("soon", None)], lambda c: F.date_format(dates.parse_instant(c), "yyyy-MM-dd HH:mm"))

golden("parse_wall_clock_cases", [("2026-11-10T19:00:00+00:00", "2026-11-10 19:00"), ("2026-09-28", "2026-09-28"), ("2026-02-30", None)], lambda c: text.let(dates.parse_wall_clock(c), lambda x: F.when(x.isNotNull(), F.concat_ws(" ", x["date"].cast("string"), x["time"]))))

golden("none_if_midnight_cases", [("00:00", None), ("18:30", "18:30"), ("25:00", None), ("7:30", None), (None, None)], dates.none_if_midnight)

_NONE = "array<string>"
golden("classify_free_by_price", [
    ("Free", "true"), ("£0.00", "true"), ("0.00 GBP", "true"), ("£15 / £9", "false"), ("Tickets from £12", "false"), ("Pay what you can", "true"), ("Free for members, £10 non-members", "false"), ("See website", None), ("", None), (None, None),
    ("10 pounds", "false"), ("Suggested donation £5", "true"), ("Free, booking required", "true"), ("Concessions available", "false"),
], lambda c: _flag(classify.free(c, F.array().cast(_NONE))))

golden("classify_free_by_prose", [
    ("This event is free to attend, but booking is required.", "true"), ("Admission: free", "true"), ("A talk about free speech and free will.", None), ("Standard tickets £15, concessions available", "false"),
    ("All welcome, and entry is free", "true"), ("Free for members, £10 for non-members; free entry", "true"), ("", None),
], lambda c: _flag(classify.free(F.lit(None).cast("string"), F.array(c))))

golden("classify_online_by_location", [("Online", "true"), ("Zoom webinar", "true"), ("Online event", "true"), ("Conway Hall, 25 Red Lion Square", "false"), ("Royal Geographical Society and online", "false"), ("Victoria Hall / Online", "false"), (None, None)], lambda c: _flag(classify.online_by_location(c)))

golden("classify_online_by_prose", [("This is an online event held on Zoom.", "true"), ("A hybrid event: join us in person or online.", "false"), ("Join us in person at the Academy.", "false"), ("A lecture about the history of maps.", None), ("", None)], lambda c: _flag(classify.online_by_prose(F.array(c))))

golden("outside_london_cases", [
    ("Manchester Museum, Oxford Road", "true"), ("The Old Market, Brighton, BN3 1AS", "true"), ("Binks Hall, St John’s College Durham, Durham", "true"), ("Oxford Street", "false"), ("Leicester Square", "false"), ("Liverpool Street station", "false"),
    ("Duke of York Square", "false"), ("Burlington House, Piccadilly, London W1J 0BE", "false"), ("Hall, LS1 4AP", "true"), ("Hall, WC1E 6BT, near Bath", "false"), ("The Guildhall, Leeds", "true"), ("", "false"), (None, "false"),
], lambda c: _flag(classify.outside_london(c)))

golden("in_london_cases", [("The Royal Institution, 21 Albemarle Street, W1S 4BS", "true"), ("Imperial College London", "true"), ("Harwell Campus, Didcot, OX11 0QX", "false"), ("Maynooth University, County Kildare, Ireland", "false"), ("", "false")], lambda c: _flag(classify.in_london(c)))

golden("html_text_cases", [("<p>Hello&nbsp;<b>world</b></p><p>Second</p>", "Hello world Second"), ("a  b", "a b"), (None, ""), ("<p>A &amp; B<br>C</p><script>no()</script>", "A & B C"), ("5 &lt; 6", "5 < 6")], H.html_text)

golden("html_lines_cases", [("<p>Date: Monday</p><p>Venue:</p><p>The Bell</p>", "Date: Monday|Venue:|The Bell"), ("<ul><li>a<li> b </li></ul>x<br>y", "a|b|x|y"), ("", "")], lambda c: _list(H.html_lines(c)))

golden("labelled_cases", [("Date: Monday|Venue:|The Bell", "The Bell"), ("Venue： Room 1|x", "Room 1"), ("Somewhere", None)], lambda c: text.labelled(F.split(c, "\\|"), "venue"))

golden("truncate_cases", [("one two three four five six", "one two three…"), ("short", "short"), ("abcdefghijklmnopqrst", "abcdefghijklmn…"), ("one two, three four", "one two, three…")], lambda c: text.truncate(c, 15))

golden("unshout_cases", [("THE BIG DEBATE: WHO OWNS THE SEA?", "The Big Debate: Who Owns The Sea?"), ("UCL Lunch Hour Lecture", "UCL Lunch Hour Lecture"), ("BBC", "BBC"), ("ÉCOLE ‘DES ARTS’ (PARIS)", "École ‘Des Arts’ (Paris)")], text.unshout)

golden("strip_wrapping_quotes_cases", [("“A talk”", "A talk"), ('"A" and "B"', '"A" and "B"'), ("'x'", "x"), ("‘a’ b", "‘a’ b"), (' " a " ', "a")], text.strip_wrapping_quotes)

golden("clean_cases", [("a​b  c\t\n", "ab c"), (None, ""), (" x y ", "x y")], text.clean)

golden("fold_cases", [("Élan Vital", "elan vital"), ("ÅNGSTRÖM", "angstrom"), (None, None)], text.fold)

golden("short_price_cases", [("£12.50 / £9", "from £12.50"), ("£9", "£9"), ("Free", None), ("£ 5 and £ 5", "£5")], text.short_price)

golden("title_status_cases", [
    ("SOLD OUT: The Big Talk", "The Big Talk|false"), ("The Big Talk *Sold Out*", "The Big Talk|false"), ("The Cancelled Election of 1860", "The Cancelled Election of 1860|false"), ("CANCELLED - The Big Talk", "The Big Talk|true"), ("[Postponed] On Maps", "On Maps|true"),
], lambda c: text.let(text.title_status(c), lambda x: F.concat_ws("|", x["title"], _flag(x["cancelled"]))))

golden("format_marker_cases", [("In-Person Only: A Talk", "A Talk|false"), ("A Talk [online]", "A Talk|true"), ("Online Harms: A Talk", "Online Harms: A Talk"), ("Hybrid: On Maps", "On Maps|false")], lambda c: F.concat_ws("|", text.format_marker(c)[0], _flag(text.format_marker(c)[1])))

golden("title_tokens_cases", [("The Secret Life of Sewers", "secret|life|sewers"), ("Darwin's Finches: a talk", "darwin|finches"), ("", ""), ("Élan", "elan")], lambda c: _list(text.title_tokens(text.fold(c))))

golden("place_tokens_cases", [("The British Academy, 10 Carlton House Terrace", "british|academy|carlton|terrace"), ("Room 1, London", "")], lambda c: _list(text.place_tokens(c)))

golden("escape_html_cases", [('<a href="x">&</a>', "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"), ("plain", "plain")], text.escape_html)

golden("normalize_url_cases", [
    ("https://www.Example.org/Events/Talk/?utm_source=x&id=2#top", "https://example.org/events/talk?id=2"), ("http://example.org/events/talk?id=2", "https://example.org/events/talk?id=2"), (" Not a URL ", "not a url"),
    ("https://example.org", "https://example.org/"), ("https://e.org/a//b/?b=1&a=2", "https://e.org/a/b?a=2&b=1"), ("https://e.org/?fbclid=1&ref=2", "https://e.org/"), ("https://e.org/x?k=2&k=1", "https://e.org/x?k=2&k=1"),
], urls.normalize_url)

golden("absolute_url_cases", [("/relative", None), (" https://a.org/x ", "https://a.org/x"), ("ftp://a.org", None), ("https://a.org/a b", None), ("", None)], urls.absolute_url)

golden("resolve_url_cases", [("/x?a=1&amp;b=2", "https://e.org/x?a=1&b=2"), ("y", "https://e.org/d/y"), ("#top", None), ("mailto:a@b.c", None), ("tel:1", None), ("javascript:void(0)", None), ("", None), ("https://f.org/", "https://f.org/")], lambda c: urls.resolve_url(c, F.lit("https://e.org/d/")))

_GIVEN = ("jane", "william", "dorje", "naomi", "astra")
golden("speakers_from_title_cases", [
    ("Richard Dawkins in conversation with Alice Roberts", "Richard Dawkins|Alice Roberts"), ("Lubaina Himid in conversation", "Lubaina Himid"), ("An evening with Mary Beard", "Mary Beard"), ("Jane Doe: A Title", "Jane Doe"),
    ("Slow Looking: Title", ""), ("Digital Heists Uncovered: How Crime Went Online", ""), ("Walk: William Tyndale", ""), ("Inaugural Lecture: Professor Rajvinder Karda", "Professor Rajvinder Karda"), ("Finance Seminar – Dorje Brody", "Dorje Brody"), (None, ""),
    ("On Maps. Speakers: Ada Lovelace and Mary Somerville", "Ada Lovelace|Mary Somerville"), ("Bees, chaired by Dr Amina Patel", ""),
], lambda c: _list(names.speakers_from_title(c, F.lit(None).cast("string"), _GIVEN)))

golden("honorific_names_cases", [
    ("A lecture by Professor Jane Smith FRS on urban life.", "Professor Jane Smith"), ("Chaired by Dr Amina Patel, with Prof. Tom Jones OBE", "Dr Amina Patel|Prof. Tom Jones"), ("The doctor is in", ""), ("", ""),
], lambda c: _list(names.speakers_from_title(F.lit("The Future of Cities"), c, ())))
