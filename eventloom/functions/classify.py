"""Free or paid, online or in person, in London or not; null where a text doesn't say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .regex import java, matches, part, swap
from .text import clean, let


def _prose(texts: Column) -> Column:
    return F.array_join(F.filter(F.transform(texts, clean), lambda t: t != ""), " \n ")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p)
    return out


def _has(lower: Column, *words: str) -> Column:
    """Whether a text, in lower case, has one of the words that a pattern can't match without: most texts have none,
    and are spared the pattern."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(lower, F.lit(w))
    return out


def _free_by_prose(prose: Column, lower: Column) -> Column:
    donation = lambda: _has(lower, "donation", "pay what", "pwyc") & matches(prose, X.DONATION)
    says = F.struct((_has(lower, "free") & _any(prose, X.FREE_PROSE)).alias("free"), (_has(lower, "£", "ticket", "concession") & matches(prose, X.PAID_PROSE)).alias("paid"))
    return let(says, lambda s: (
        F.when(prose == "", F.lit(None).cast("boolean"))
        .when(~s["paid"] & (s["free"] | donation()), True)
        .when(s["paid"] & ~s["free"], False)
        .when(s["paid"] & matches(prose, X.MEMBERS_ONLY_FREE), False)
    ))


def free(price: Column, texts: Column) -> Column:
    """True if attending costs nothing (or what one likes), false if it is paid; a price field counts before prose."""
    p = clean(price)
    paid = matches(p, X.PAID_PRICE)
    by_price = (
        F.when(p == "", F.lit(None).cast("boolean"))
        .when(matches(p, X.DONATION), True)
        .when(matches(p, X.MEMBERS_ONLY_FREE) & paid, False)
        .when(matches(p, X.FREE_PRICE), True)
        .when(matches(p, r"\bfree\b") & ~paid, True)
        .when(paid, False)
    )
    return F.coalesce(by_price, let(_prose(texts), lambda prose: let(F.lower(prose), lambda lower: _free_by_prose(prose, lower))))


def online_by_location(location: Column) -> Column:
    """Online only if nothing but filler is left of a location that mentions it; hybrid counts as in person."""
    loc = clean(location)
    rest = F.regexp_replace(swap(swap(loc, X.ONLINE_WORDS, " "), X.FILLER_WORDS, " "), r"[^\p{L}]+", "")
    return (
        F.when(loc == "", F.lit(None).cast("boolean"))
        .when(~matches(loc, X.ONLINE_WORDS), False)
        .when(matches(loc, X.HYBRID_LOCATION), False)
        .otherwise(F.length(rest) < 4)
    )


def online_by_prose(texts: Column) -> Column:

    def said(prose: Column, lower: Column) -> Column:
        person = _has(lower, "person")
        return (
            F.when(prose == "", F.lit(None).cast("boolean"))
            .when((_has(lower, "hybrid") | person) & matches(prose, X.HYBRID_PROSE), False)
            .when(person & matches(prose, r"\bin[\s-]person\b") & ~matches(prose, r"\bno\s+in[\s-]person\b"), False)
            .when(_has(lower, "online", "virtual", "webinar", "zoom", "microsoft", "crowdcast") & _any(prose, X.ONLINE_PROSE), True)
        )

    return let(_prose(texts), lambda prose: let(F.lower(prose), lambda lower: said(prose, lower)))


_PLACES = "|".join(p.replace(" ", r"\s+") for p in X.NON_LONDON_PLACES)
_ELSEWHERE = rf"(?<!\b(?:of|duke|prince|princess)\s{{0,9}})\b(?:{_PLACES})\b(?!\s*{X.STREETISH_AFTER})"


def outside_london(location: Column) -> Column:
    """A postcode decides; else a London name; else a place elsewhere that isn't part of a street's name."""
    loc = clean(location)
    area = part(loc, X.POSTCODE, 1, ignore_case=False)
    return F.when(loc == "", False).when(area != "", ~area.isin(*X.LONDON_POSTCODE_AREAS)).when(matches(loc, X.LONDON), False).otherwise(loc.rlike(java(_ELSEWHERE)))


def in_london(location: Column) -> Column:
    loc = clean(location)
    area = part(loc, X.POSTCODE, 1, ignore_case=False)
    return F.when(loc == "", False).when(area != "", area.isin(*X.LONDON_POSTCODE_AREAS)).otherwise(matches(loc, X.LONDON))
