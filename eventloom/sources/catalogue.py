"""The sources: what is fixed of each, and how its captured responses become raw events.

Sources of one format differ by data: paths, selectors, defaults and predicates. Captured responses are
(url, page, body); a source's detail pages, where its listing lacks fields, are looked up by readers.enrich.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, names, text, urls
from ..functions.regex import matches
from ..schemas import SOURCE
from . import readers
from .cards import field, html_cards

# Id, name, homepage, default price (free or not), default attendance (online or not), default location,
# format, pages read at most
SOURCES = (
    ("5x15", "5x15", "https://www.5x15.com/events", False, False, None, "cards", 1),
    ("barbican", "Barbican", "https://www.barbican.org.uk/whats-on/talks-events", False, False, "Barbican Centre, Silk Street, EC2Y 8DS", "cards", 15),
    ("birkbeck", "Birkbeck", "https://www.bbk.ac.uk/events", True, None, None, "cards", 25),
    ("charterhouse", "The Charterhouse", "https://thecharterhouse.org/visit-us/whats-on/", False, False, "The Charterhouse, Charterhouse Square, EC1M 6AN", "json", 20),
    ("conway-hall", "Conway Hall", "https://www.conwayhall.org.uk/whats-on/", None, None, "Conway Hall, 25 Red Lion Square, WC1R 4RL", "cards", 10),
    ("fortean", "London Fortean Society", "https://forteanlondon.blogspot.com", False, None, None, "labelled", 4),
    ("frontline-club", "Frontline Club", "https://www.frontlineclub.com/events/", None, None, "Frontline Club, 13 Norfolk Place, W2 1QJ", "ticketing", 15),
    ("geological-society", "Geological Society", "https://www.geolsoc.org.uk/events/", None, None, "Geological Society, Burlington House, Piccadilly", "cards", 20),
    ("gresham", "Gresham College", "https://www.gresham.ac.uk/whats-on", True, None, None, "json", 1),
    ("guardian-live", "Guardian Live", "https://www.theguardian.com/guardian-live-events", False, None, None, "labelled", 1),
    ("guildhall-library", "Guildhall Library", "https://www.cityoflondon.gov.uk/things-to-do/history-and-heritage/guildhall-library/guildhall-library-events-and-exhibitions/guildhall-library-events", None, None, "Guildhall Library, Aldermanbury, EC2V 7HH", "ticketing", 15),
    ("hlsi", "Highgate Literary & Scientific Institution", "https://hlsi.org.uk/events/", None, None, "Highgate Literary & Scientific Institution, 11 South Grove, N6 6BS", "json", 25),
    ("how-to-academy", "How To Academy", "https://howtoacademy.com/events-calendar/", False, None, None, "cards", 1),
    ("imperial", "Imperial College London", "https://www.imperial.ac.uk/whats-on/", True, None, "Imperial College London", "cards", 20),
    ("iop", "Institute of Physics", "https://www.iop.org/events", None, None, None, "cards", 15),
    ("intelligence-squared", "Intelligence Squared", "https://www.intelligencesquared.com/attend", False, False, None, "ticketing", 15),
    ("kcl", "King's College London", "https://www.kcl.ac.uk/events", True, None, "King's College London", "json", 20),
    ("linnean", "Linnean Society", "https://www.linnean.org/meetings-and-events/events", None, None, "Linnean Society, Burlington House, Piccadilly", "json", 20),
    ("lse", "LSE", "https://www.lse.ac.uk/events", True, None, None, "json", 20),
    ("pints-of-knowledge", "Pints of Knowledge", "https://www.pintsofknowledge.co.uk/london-tickets", False, False, None, "json", 5),
    ("ras", "Royal Astronomical Society", "https://ras.ac.uk/events-and-meetings", None, None, "Royal Astronomical Society, Burlington House, Piccadilly", "cards", 12),
    ("rgs", "Royal Geographical Society", "https://www.rgs.org/events/upcoming-events", None, None, "Royal Geographical Society, 1 Kensington Gore, SW7 2AR", "json", 30),
    ("royal-academy", "Royal Academy of Arts", "https://www.royalacademy.org.uk/exhibitions-and-events?what-filter=talks-lectures", None, None, "Royal Academy of Arts, Burlington House, Piccadilly, W1J 0BD", "cards", 10),
    ("royal-society", "Royal Society", "https://royalsociety.org/science-events-and-lectures/", True, None, "The Royal Society, 6–9 Carlton House Terrace, SW1Y 5AG", "cards", 10),
    ("rsa", "RSA", "https://www.thersa.org/events", None, None, "RSA House, 8 John Adam Street, WC2N 6EZ", "ticketing", 15),
    ("rsaa", "Royal Society for Asian Affairs", "https://rsaa.org.uk/rsaa-events/", True, None, None, "cards", 1),
    ("rsc", "Royal Society of Chemistry", "https://www.rsc.org/events/find-an-event/uk-and-ireland-events", None, None, None, "cards", 12),
    ("seed-talks", "Seed Talks", "https://www.seedtalks.co.uk/in/london", False, None, None, "cards", 1),
    ("society-of-antiquaries", "Society of Antiquaries", "https://www.sal.org.uk/events/", None, None, "Society of Antiquaries, Burlington House, Piccadilly", "cards", 10),
    ("southbank", "Southbank Centre", "https://www.southbankcentre.co.uk/whats-on/?artform-filter=talks-debates", False, None, "Southbank Centre, Belvedere Road, SE1 8XX", "cards", 12),
    ("tate", "Tate", "https://www.tate.org.uk/whats-on?event_type=talk", None, False, None, "cards", 10),
    ("ucl", "UCL", "https://www.ucl.ac.uk/events/", True, None, "UCL, Bloomsbury", "json", 20),
)

# Seconds that a source may take; sources with more
TIMEOUT, TIMEOUTS = 240, {"pints-of-knowledge": 480, "iop": 480, "rsc": 480}

# Titles and kinds that a source leaves out or is limited to
BIRKBECK_LEFT_OUT = r"^(?:get ready|virtual enrolment|enrolment|induction|welcome|uni connect|linking london|study skills|open (?:day|evening)|applicant|offer holder|graduation|freshers|library tour|ilc open session|academic english|presenting with confidence|orientation|post-arrival|campus tours?|disabled students|meet the)\b|\b(?:study skills|enrolment support|drop-in session|offer holders?|short course(?: booking)?|course booking|workshop series|cpd spotlight|careers? (?:fair|clinic|workshop)|employability|taster (?:course|session|day)|a career for you|fast stream|for (?:new|prospective|international|current) (?:students|undergraduates|postgraduates|applicants)|students[’']? allowance|information session|ilc workshop|(?:academic|digital|writing|study) skills|personal statement|referencing)\b"
CONWAY_LEFT_OUT = r"^sunday concerts?\b"
ACADEMY_LEFT_OUT = r"\bopen (?:day|evening)\b"
PHYSICS_LEFT_OUT = r"\b(?:membership|professional registration|chartered|careers?|mentoring|annual general meeting|agm|cpd)\b"
IMPERIAL_KINDS = r"^(?:lecture|seminar|symposium|debate|conference|festival|film screening|imperial lates|colloquium|talk|panel)"
UCL_LEFT_OUT = r"^(?:workshop|virtual open day|open day|open event|information session|short course|online learning|face-to-face learning|taster session|continuing professional development|networking|tour|training|summer school|induction)"
HIGHGATE_KINDS = r"lecture|talk|debate|opera circle|science|conversation|special event"
HIGHGATE_LEFT_OUT = r"course|workshop|class|fitness|pilates|tai chi|walk|concert|film|cinema|exhibition|fair|library|choir|yoga|drawing|painting"
CHEMISTS_LEFT_OUT = r"\b(?:short course|course|training|workshop|site visit|tour|competition|olympiad|exam|careers? fair|practical)\b"
GEOGRAPHERS_REGION = r"^london(?:\s+and\s+online)?$"
GEOGRAPHERS_LEFT_OUT = r"^(?:teachers|schools|professionals|postgraduates|undergraduates|early career|members only)$"


def sources(spark: SparkSession) -> DataFrame:
    """The catalogue as schemas.SOURCE."""
    return spark.createDataFrame([s[:6] for s in SOURCES], SOURCE)


def selected(only: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> list[str]:
    """Ids of the sources of a run; an unknown id is an error."""
    known = [s[0] for s in SOURCES]
    if unknown := sorted({*only, *skip} - set(known)):
        raise ValueError(f"no such source: {', '.join(unknown)}")
    return [s for s in known if (not only or s in only) and s not in skip]


def include(source: str) -> Column | None:
    """A source's predicate over its records, or None."""
    title = F.col("title")
    return {"birkbeck": lambda: ~matches(title, BIRKBECK_LEFT_OUT), "conway-hall": lambda: ~matches(title, CONWAY_LEFT_OUT), "royal-academy": lambda: ~matches(title, ACADEMY_LEFT_OUT), "iop": lambda: ~matches(title, PHYSICS_LEFT_OUT) & classify.in_london(F.col("location"))}.get(source, lambda: None)()


def later_than(cards: DataFrame, date: Column, beyond: Column) -> DataFrame:
    """(page, stop): whether every card of a page is past the horizon, so that paging may end there."""
    return cards.groupBy("page").agg(F.every(F.coalesce(date >= beyond, F.lit(False))).alias("stop"))


def last_page(pages: DataFrame, by: str, target: str) -> DataFrame:
    """(by, last_page, pages): the largest page number that paging links name, 0 where none does, and how many there are."""
    number = F.coalesce(F.col(target).try_cast("int"), F.lit(0))
    return pages.groupBy(by).agg(F.greatest(F.lit(0), F.max(number)).alias("last_page"), F.count(F.lit(1)).alias("pages"))


def listed_ranks(cards: DataFrame, by: str, rank: str, total: str) -> DataFrame:
    """(by, last, total, done): the largest rank among a listing's cards, the count that its last card names, and
    whether all have come."""
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    named = F.max_by(number(total), F.struct(number(rank), number(total)))
    return cards.groupBy(by).agg(F.greatest(F.lit(0), F.max(number(rank))).alias("last"), named.alias("total")).withColumn("done", F.col("last") >= F.col("total"))


# --- ticketing --------------------------------------------------------------------------------------------------


def _ticketing(source: str, keep: Callable[[], Column] | None = None) -> Callable[[DataFrame, Column], DataFrame]:
    def read(responses: DataFrame, today: Column) -> DataFrame:
        rows = readers.ticketing(responses, source)
        return rows.filter(keep()) if keep else rows

    return read


# --- JSON -------------------------------------------------------------------------------------------------------


def _items(responses: DataFrame, rows: str) -> DataFrame:
    listed = F.try_variant_get(text.lenient_json(F.col("body")), rows, "array<variant>")
    return responses.select("page", F.posexplode(listed).alias("nth", "v"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _seq() -> Column:
    return F.col("page").cast("long") * 1000 + F.col("nth")


def _wall(value: Column) -> dict[str, Column]:
    both = dates.parse_wall_clock(value)
    return {"start_date": both["date"].cast("string"), "start_time": both["time"]}


def _linnean(responses: DataFrame, today: Column) -> DataFrame:
    e = _items(responses, "$")
    prices = F.filter(F.transform(F.coalesce(_get("$.tickets", "array<variant>"), F.array().cast("array<variant>")), lambda t: F.coalesce(F.try_variant_get(t, "$.price", "double"), F.try_variant_get(t, "$.cost", "double"))), lambda p: p.isNotNull())
    shown = lambda p: F.when(p == 0, "Free").otherwise(F.concat(F.lit("£"), F.regexp_replace(F.format_string("%.2f", p / 100), r"\.00\z", "")))
    low, high = F.array_min(prices), F.array_max(prices)
    remote, hybrid = _get("$.remote", "boolean"), F.coalesce(_get("$.hybrid", "boolean"), F.lit(False))
    online = F.when(remote & ~hybrid, True).when(~remote, False)
    instant = dates.parse_instant(_get("$.start_date"))
    place = text.none_if_empty(text.clean(F.coalesce(_get("$.location.formatted_address"), _get("$.venue"))))
    return readers.raw_events(
        e.filter((_get("$.status") == "published") & instant.isNotNull()), source=F.lit("linnean"), seq=_seq(), title=_get("$.title"), url=F.concat(F.lit("https://members.linnean.org/events/"), _get("$.id"), F.lit("/description")),
        start_instant=instant, end_date=dates.london_date(dates.parse_instant(_get("$.end_date"))), location=F.when(online, "Online").otherwise(place), online=online, description=_get("$.description"),
        price_text=F.when(low == high, shown(low)).when(low < high, F.concat(shown(low), F.lit(" – "), shown(high))),
    )


def _ucl(responses: DataFrame, today: Column) -> DataFrame:
    e = _items(responses, "$.response.resultPacket.results")
    first = lambda name: text.none_if_empty(_get(f"$.listMetadata.{name}[0]"))
    kind, cost, start = F.coalesce(first("UclEventType"), F.lit("")), first("UclEventCost"), first("UclEventStartDate")
    instant = dates.parse_instant(start)
    wall = _wall(start)
    sign = F.when(F.coalesce(first("UclEventCurrency"), F.lit("GBP")) == "GBP", "£").otherwise(F.concat(first("UclEventCurrency"), F.lit(" ")))
    place = F.concat_ws(", ", *(first(f"UclEventLocation{x}") for x in ("Room", "Building", "Street", "City", "Postcode")))
    e = e.filter((instant.isNotNull() | wall["start_date"].isNotNull()) & ~matches(kind, UCL_LEFT_OUT))
    return readers.raw_events(
        e, source=F.lit("ucl"), seq=_seq(), title=F.coalesce(first("FeedTitle"), F.split(_get("$.title"), r" \| ")[0]), url=_get("$.liveUrl"), start_instant=instant, start_date=F.when(instant.isNull(), wall["start_date"]),
        start_time=F.when(instant.isNull(), wall["start_time"]), end_date=dates.parse_wall_clock(first("UclEventEndDate"))["date"], location=text.none_if_empty(place), description=first("c"),
        price_text=F.when(cost.try_cast("double") == 0, "Free").when(cost.isNotNull(), F.concat(sign, cost)), online=F.when(matches(kind, r"^(?:virtual event|webinar)$"), True), hints=F.array(kind),
    )


def _hlsi(responses: DataFrame, today: Column) -> DataFrame:
    e = _items(responses, "$.events")
    kinds = F.transform(F.coalesce(_get("$.categories", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$.name", "string"))
    room, wall, home = text.clean(_get("$.venue.venue")), _wall(_get("$.start_date")), next(s[5] for s in SOURCES if s[0] == "hlsi")
    online = matches(room, "^online$")
    talk = F.exists(kinds, lambda k: matches(k, HIGHGATE_KINDS)) & ~F.exists(kinds, lambda k: matches(k, HIGHGATE_LEFT_OUT))
    return readers.raw_events(
        e.filter(talk & wall["start_date"].isNotNull()), source=F.lit("hlsi"), seq=_seq(), title=_get("$.title"), url=_get("$.url"), start_date=wall["start_date"], start_time=F.when(~F.coalesce(_get("$.all_day", "boolean"), F.lit(False)), wall["start_time"]),
        end_date=dates.parse_wall_clock(_get("$.end_date"))["date"], location=F.when(online, "Online").when((room != "") & ~matches(room, "^hlsi$"), F.concat(room, F.lit(", " + home))).otherwise(home), online=F.when(online, True),
        description=_get("$.description"), price_text=text.none_if_empty(text.clean(_get("$.cost"))), hints=F.array(F.array_join(kinds, ", ")),
    )


def _charterhouse(responses: DataFrame, today: Column) -> DataFrame:
    """Times are wall clocks written as seconds since 1970."""
    e = _items(responses, "$.results")
    wall = lambda p: F.timestamp_seconds(_get(p, "bigint"))
    return readers.raw_events(
        e.filter(_get("$.startDate", "bigint").isNotNull()), source=F.lit("charterhouse"), seq=_seq(), title=_get("$.title"), url=_get("$.url"), start_date=F.date_format(wall("$.startDate"), "yyyy-MM-dd"), start_time=F.date_format(wall("$.startDate"), "HH:mm"),
        end_date=F.to_date(wall("$.endDate")), description=_get("$.body"), hints=F.array(F.coalesce(_get("$.eventDatesDisplay"), F.lit(""))),
    )


def _rgs(responses: DataFrame, today: Column) -> DataFrame:
    e = _items(responses, "$.items").withColumn("base", F.lit("https://www.rgs.org")).withColumn("day", dates.parse_date(_get("$.date"), today))
    region, access = text.clean(_get("$.location")), text.clean(_get("$.memberAccessType"))
    e = e.withColumn("link", urls.resolve_url(_get("$.cta.url"), F.col("base"))).filter(F.col("day").isNotNull() & F.col("link").isNotNull() & matches(region, GEOGRAPHERS_REGION) & ~matches(access, GEOGRAPHERS_LEFT_OUT))
    return readers.raw_events(
        e, source=F.lit("rgs"), seq=_seq(), title=_get("$.title"), url=F.col("link"), start_date=F.col("day").cast("string"), location=F.when(~matches(region, "^london$"), "Royal Geographical Society, Kensington Gore (and online)"), online=F.lit(False),
        description=_get("$.content"), price_text=_get("$.price"), hints=F.array(F.coalesce(_get("$.categoryTag"), F.lit("")), access),
    )


def _pints(responses: DataFrame, today: Column) -> DataFrame:
    venues = _items(responses, "$.venues").select("page", "nth", F.col("v").alias("venue"), F.posexplode(_get("$.upcoming_events", "array<variant>")).alias("n", "v")).filter(_get("$.status") == "published")
    place = lambda p: F.try_variant_get("venue", p, "string")
    return readers.first_wins(readers.raw_events(
        venues, source=F.lit("pints-of-knowledge"), seq=_seq() * 1000 + F.col("n"), title=_get("$.title"), url=F.coalesce(_get("$.event_url"), _get("$.checkout_url")), start_instant=F.timestamp_seconds(_get("$.start_at", "bigint")),
        location=F.concat_ws(", ", place("$.name"), place("$.address")),
    ), "url")


# --- cards ------------------------------------------------------------------------------------------------------

#: A source's card and its fields.
CARDS = {
    "barbican": ("article.listing--event", {"url": "a.search-listing__link@href", "title": ".listing-title", "times": "time[datetime]@datetime", "blurb": ".search-listing__intro p", "tags": ".tags .tag__plain"}),
    "birkbeck": ("a.card", {"url": "@href", "title": ".card__title", "times": ".card__body time[datetime]@datetime", "body": ".card__body", "day": ".card-divider", "lines": ".card__body p"}),
    "imperial": ('a[href^="/events/"]', {"url": "@href", "title": ".title", "times": "time[datetime]@datetime", "blurb": "@title", "venue": ".venue", "tags": ".tags li span"}),
    "ras": (".view-dates-for-the-dairy .event-iten", {"url": ".views-field-title a@href", "title": ".views-field-title a", "day": ".views-field-field-date-1", "month": ".views-field-field-date-2", "time": ".views-field-field-date", "kind": ".views-field-field-event-type"}),
    "society-of-antiquaries": (".sugar-calendar-event-list-block__listview__event", {"url": ".sugar-calendar-event-list-block__event__title a@href", "title": ".sugar-calendar-event-list-block__event__title a", "times": ".sugar-calendar-event-list-block__event__datetime time[datetime]@datetime", "blurb": ".sugar-calendar-event-list-block__event__desc"}),
    "conway-hall": ("conwayhall-event", {"url": 'a[href*="/whats-on/event/"]@href', "title": ".event-title", "series": ".event-title span", "times": "time[datetime]@datetime", "format": ".uk-modal-body p.uk-text-small", "lines": ".uk-modal-body p"}),
    "geological-society": ("a.card__event", {"url": "@href", "title": ".card-title", "badge": ".card__event--badge", "lines": ".card__event--body p"}),
    "iop": (".iop-media-block--event", {"url": "a.iop-media-block__cta@href", "title": ".iop-media-block__heading", "days": ".iop-media-block__date p", "kind": ".iop-media-block__event-type"}),
    "royal-academy": (".event-card", {"url": "a.event-card__link@href", "title": "a.event-card__link", "label": ".event-card__label", "day": ".event-card__date", "subtitle": ".event-card__subtitle"}),
    "royal-society": ("a.card__link", {"url": "@href", "title": ".card__title", "days": "time", "meta": ".card__meta-item", "blurb": ".card__desc"}),
    "rsaa": ("article", {"url": ".entry-title a@href", "title": ".entry-title a", "excerpt": ".entry-content"}),
    "rsc": (".card.card--link", {"url": ".card__title a@href", "title": ".card__title a", "place": ".card__location", "company": ".card__company", "day": ".card__date"}),
    "southbank": (".c-event-card", {"url": ".c-event-card__cover-link@href", "title": ".c-event-card__title", "days": ".c-event-card__daterange", "venue": ".c-event-card__location", "price": ".c-event-card__price-label", "blurb": ".c-event-card__listing-details", "kind": ".c-event-card__primary-artform"}),
}


def _cards(source: str, responses: DataFrame) -> DataFrame:
    home = next(s[2] for s in SOURCES if s[0] == source)
    rows = html_cards(responses, *CARDS[source]).withColumn("link", urls.resolve_url(field("url"), F.lit(home)))
    return rows.filter(F.col("link").isNotNull() & (F.coalesce(field("title"), F.lit("")) != ""))


def _barbican(responses: DataFrame, today: Column) -> DataFrame:
    """A row for each performance."""
    e = _cards("barbican", responses).select("*", F.posexplode(F.col("fields")["times"]).alias("n", "time"))
    e = e.withColumn("instant", dates.parse_instant(F.col("time"))).filter("instant IS NOT NULL")
    return readers.raw_events(e, source=F.lit("barbican"), seq=_seq() * 100 + F.col("n"), title=field("title"), url=F.col("link"), start_instant=F.col("instant"), description=text.none_if_empty(F.array_join(F.col("fields")["blurb"], " ")), hints=F.col("fields")["tags"])


def _birkbeck(responses: DataFrame, today: Column) -> DataFrame:
    e, stamps = _cards("birkbeck", responses), F.col("fields")["times"]
    wall = dates.parse_wall_clock(field("times"))
    day = F.coalesce(wall["date"], dates.parse_date(field("day"), today))
    time = F.when((F.size(stamps) > 1) & wall["time"].isNotNull(), wall["time"]).otherwise(dates.parse_time(F.regexp_replace(field("body"), r"\b\d{1,2}\s+\w+\s+\d{4}\b", " ")))
    venue = F.trim(F.regexp_replace(F.get(F.filter(F.col("fields")["lines"], lambda p: ~p.rlike(r"\d{4}")), F.lit(0)), r"(?i)(?:book your place|no booking required|booking required|registration required).*\z", ""))
    e = e.withColumns({"day": day, "time": time, "place": text.none_if_empty(venue)}).filter("day IS NOT NULL")
    end = F.when(F.size(stamps) > 1, dates.parse_wall_clock(F.element_at(stamps, -1))["date"])
    return readers.raw_events(
        e, source=F.lit("birkbeck"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("day").cast("string"), start_time=F.col("time"), end_date=end,
        location=F.when(~matches(F.col("place"), "^external$"), F.col("place")), online=F.when(matches(F.col("place"), "^online$"), True).when(matches(F.col("place"), "^hybrid$"), False), hints=F.array(field("body")),
    )


def _imperial(responses: DataFrame, today: Column) -> DataFrame:
    e = _cards("imperial", responses).withColumn("instant", dates.parse_instant(field("times"))).filter(F.col("instant").isNotNull() & F.exists(F.col("fields")["tags"], lambda t: matches(t, IMPERIAL_KINDS)))
    venue = field("venue")
    return readers.first_wins(readers.raw_events(
        e, source=F.lit("imperial"), seq=_seq(), title=field("title"), url=F.col("link"), start_instant=F.col("instant"), location=F.when(matches(venue, "^online only$"), "Online").otherwise(text.none_if_empty(venue)),
        description=F.when(field("blurb") != field("title"), field("blurb")), hints=F.filter(F.col("fields")["tags"], lambda t: t != "Event"),
    ), "url")


def _ras(responses: DataFrame, today: Column) -> DataFrame:
    e = _cards("ras", responses).withColumn("day", dates.parse_date(F.concat_ws(" ", field("day"), field("month")), today)).filter("day IS NOT NULL")
    return readers.raw_events(e, source=F.lit("ras"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("day").cast("string"), start_time=dates.parse_time(field("time")), hints=F.col("fields")["kind"])


def _antiquaries(responses: DataFrame, today: Column) -> DataFrame:
    """A page may be listed on several days: each is a row, once."""
    e, stamps = _cards("society-of-antiquaries", responses), F.col("fields")["times"]
    wall = _wall(field("times"))
    rows = readers.raw_events(
        e.filter(wall["start_date"].isNotNull()), source=F.lit("society-of-antiquaries"), seq=_seq(), title=field("title"), url=F.col("link"), end_date=F.when(F.size(stamps) > 1, dates.parse_wall_clock(F.element_at(stamps, -1))["date"]),
        description=field("blurb"), speakers=names.speakers_from_title(F.lit(None).cast("string"), field("blurb")), **wall,
    )
    return readers.first_wins(rows, "url", "start_date")


def _conway(responses: DataFrame, today: Column) -> DataFrame:
    e, wall, home = _cards("conway-hall", responses), _wall(field("times")), next(s[5] for s in SOURCES if s[0] == "conway-hall")
    series = F.regexp_replace(F.coalesce(field("series"), F.lit("")), r":\z", "")
    bare = text.clean(F.when(field("series").isNotNull(), F.replace(field("title"), field("series"), F.lit(""))).otherwise(field("title")))
    bare = F.when(bare == "", text.clean(field("title"))).otherwise(bare)
    form = F.coalesce(F.element_at(F.when(F.size(F.col("fields")["format"]) > 0, F.col("fields")["format"]), -1), F.lit(""))
    room, mode = text.clean(F.split(form, "\\|")[0]), text.clean(F.get(F.split(form, "\\|"), F.lit(1)))
    rows = readers.raw_events(
        e.filter(wall["start_date"].isNotNull()), source=F.lit("conway-hall"), seq=_seq(), title=F.when((series != "") & ~F.contains(F.lower(bare), F.lower(series)), F.concat(series, F.lit(": "), bare)).otherwise(bare), url=F.col("link"),
        location=F.when(matches(room, "online|virtual"), "Online").when((room != "") & ~matches(room, r"^in[\s-]?person$"), F.concat(room, F.lit(", " + home))).otherwise(home),
        online=F.when(matches(room, "^(?:online|virtual)"), True).when((room != "") & matches(mode, "virtual|online"), False),
        description=text.none_if_empty(F.array_join(F.array_except(F.col("fields")["lines"], F.col("fields")["format"]), " ")), hints=F.array(form), **wall,
    )
    return readers.first_wins(rows, "url", "start_date")


def _geologists(responses: DataFrame, today: Column) -> DataFrame:
    badge = F.regexp_replace(field("badge"), r"^(\w+)\s+(\d+)\s+(\d{4}).*", "$2 $1 $3")
    e = _cards("geological-society", responses).withColumn("day", dates.parse_date(badge, today)).filter("day IS NOT NULL")
    lines = F.col("fields")["lines"]
    return readers.raw_events(e, source=F.lit("geological-society"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("day").cast("string"), location=text.none_if_empty(field("lines")), hints=F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))


def _iop(responses: DataFrame, today: Column) -> DataFrame:
    e = _cards("iop", responses).withColumn("start", dates.parse_date_time(field("days"), today)).filter("start IS NOT NULL")
    return readers.first_wins(readers.raw_events(
        e, source=F.lit("iop"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("start.date").cast("string"), start_time=F.col("start.time"), end_date=dates.parse_date(field("days", 1), today),
        online=F.when(matches(field("kind"), "^online$"), True),
    ), "url")


def _academy(responses: DataFrame, today: Column) -> DataFrame:
    label = F.coalesce(field("label"), F.lit(""))
    e = _cards("royal-academy", responses).withColumn("day", dates.parse_date(field("day"), today))
    e = e.filter(F.col("day").isNotNull() & F.contains("link", F.lit("/event/")) & ((label == "") | matches(label, "talk|lecture|discussion|conversation|debate|symposium|reading|free")))
    return readers.first_wins(readers.raw_events(e, source=F.lit("royal-academy"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("day").cast("string"), free=F.when(matches(label, r"\bfree\b"), True), hints=F.array(F.coalesce(field("subtitle"), F.lit("")))), "url")


def _royal_society(responses: DataFrame, today: Column) -> DataFrame:
    """Several listings; a range of days lends its year to the first."""
    sides = F.split(field("days"), r"\s+-\s+")
    year, meta = F.regexp_extract(field("days"), r"\b\d{4}\b", 0), F.col("fields")["meta"]
    first = F.when(sides[0].rlike(r"\d{4}"), sides[0]).otherwise(F.concat_ws(" ", sides[0], year))
    e = _cards("royal-society", responses).withColumn("day", dates.parse_date(first, today)).filter("day IS NOT NULL")
    return readers.first_wins(readers.raw_events(
        e, source=F.lit("royal-society"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("day").cast("string"), end_date=F.when(F.size(sides) > 1, F.coalesce(dates.parse_date(sides[1], today), F.col("day"))),
        location=F.get(F.filter(meta, lambda m: ~matches(m, "^(?:free|watch online|£)")), F.lit(0)), price_text=F.get(F.filter(meta, lambda m: matches(m, "^(?:free|£)")), F.lit(0)), description=text.none_if_empty(field("blurb")), hints=meta,
    ), "url")


def _rsaa(responses: DataFrame, today: Column) -> DataFrame:
    lead = F.split(field("excerpt"), r"\b\d{1,2}\s+[A-Z][a-z]+\s+\d{4}")[0]
    e = _cards("rsaa", responses).withColumn("start", dates.parse_date_time(field("excerpt"), today)).filter(F.col("start").isNotNull() & F.contains("link", F.lit("/upcoming-events/")))
    hybrid = matches(lead, r"\bin[\s-]person\b|\bhybrid\b|\band online\b|\bonline and\b")
    return readers.raw_events(e, source=F.lit("rsaa"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("start.date").cast("string"), start_time=F.col("start.time"), online=F.when(matches(lead, r"\bonline\b") & ~hybrid, True), hints=F.array(lead))


def _chemists(responses: DataFrame, today: Column) -> DataFrame:
    e = _cards("rsc", responses).withColumn("day", dates.parse_date(field("day"), today))
    e = e.filter(F.col("day").isNotNull() & matches(field("place"), "london") & ~matches(F.concat_ws(" ", field("title"), field("company")), CHEMISTS_LEFT_OUT))
    return readers.first_wins(readers.raw_events(e, source=F.lit("rsc"), seq=_seq(), title=field("title"), url=F.col("link"), start_date=F.col("day").cast("string"), location=field("place"), description=text.none_if_empty(field("company"))), "url")


def _southbank(responses: DataFrame, today: Column) -> DataFrame:
    """A row for each day of a list such as "1 & 2 Oct 2026, 7pm"; a day without a year takes that of the next."""
    whole = text.clean(field("days"))
    year = F.regexp_extract(whole, r"\b(\d{4})\b", 1)
    parts = F.transform(F.split(F.split(whole, ",")[0], r"\s*&\s*"), lambda p: F.when(p.rlike(r"\d{4}"), p).otherwise(F.concat_ws(" ", p, year)))
    e = _cards("southbank", responses).withColumn("time", dates.parse_time(F.regexp_replace(whole, "^[^,]*,?", ""))).select("*", F.posexplode(parts).alias("n", "part"))
    e = e.withColumn("day", dates.parse_date(F.col("part"), today)).filter("day IS NOT NULL")
    venue = F.coalesce(field("venue"), F.lit(""))
    online = matches(venue, "^online") | matches(field("title"), r"live\s*stream")
    return readers.raw_events(
        e, source=F.lit("southbank"), seq=_seq() * 100 + F.col("n"), title=field("title"), url=F.col("link"), start_date=F.col("day").cast("string"), start_time=F.col("time"), online=F.when(online, True).when(venue != "", False),
        location=F.when(online, "Online").when(venue != "", F.concat(venue, F.lit(", Southbank Centre"))), price_text=text.none_if_empty(F.regexp_replace(F.coalesce(field("price"), F.lit("")), r"(?i)^tickets\s*", "")),
        description=text.none_if_empty(field("blurb")), hints=F.array(F.coalesce(field("kind"), F.lit(""))),
    )


#: Captured responses (url, page, body) and today's date to raw events, by source.
CONNECTORS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "frontline-club": _ticketing("frontline-club"), "guildhall-library": _ticketing("guildhall-library"), "rsa": _ticketing("rsa"),
    "intelligence-squared": _ticketing("intelligence-squared", lambda: F.col("location").isNull() | matches(F.col("location"), "london")),
    "linnean": _linnean, "ucl": _ucl, "hlsi": _hlsi, "charterhouse": _charterhouse, "rgs": _rgs, "pints-of-knowledge": _pints,
    "barbican": _barbican, "birkbeck": _birkbeck, "imperial": _imperial, "ras": _ras, "society-of-antiquaries": _antiquaries,
    "conway-hall": _conway, "geological-society": _geologists, "iop": _iop, "royal-academy": _academy, "royal-society": _royal_society, "rsaa": _rsaa, "rsc": _chemists, "southbank": _southbank,
}
