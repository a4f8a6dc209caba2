"""The interactive query: date window, price, search terms and sources switched off, with facet counts."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import PAGE_ROWS

#: First day and first day no more of each window, counted from today.
WINDOWS = {"today": (0, 1), "tomorrow": (1, 2), "week": (0, 7), "month": (0, 30)}
PRICES = ("any", "free", "paid")


def in_window(date: Column, when: str, today: Column, picked: Column | None = None) -> Column:
    if when == "date":
        return date == picked
    a, b = WINDOWS[when]
    return (date >= F.date_add(today, a)) & (date < F.date_add(today, b))


def price_matches(free: Column, price: str) -> Column:
    """Unknown prices match neither free nor paid."""
    return F.lit(True) if price == "any" else F.coalesce(free == F.lit(price == "free"), F.lit(False))


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)


def _stored(text: str | None) -> dict[str, str]:
    """Stored choices as if they came from a query string; nothing where they can't be read."""
    try:
        got = json.loads(text or "{}") or {}
        off = got.get("off") or []
        return {k: got[k] for k in ("when", "price") if isinstance(got.get(k), str) and got[k] != "date"} | {"off": ",".join(off)}
    except (ValueError, AttributeError, TypeError):
        return {}


@dataclass(frozen=True)
class QuerySpec:
    when: str = "week"
    price: str = "any"
    q: str = ""
    off: tuple[str, ...] = ()
    date: str | None = None

    @classmethod
    def from_query_string(cls, query: str, sources: tuple[str, ...] | None = None, stored: str | None = None) -> QuerySpec:
        """Invalid values give way to defaults; unknown sources are dropped. stored is what to_stored gave last time: it
        counts only where the query string says nothing of window, price, terms and sources."""
        got = {k: v[0] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
        if not got.keys() & {"when", "price", "q", "off"}:
            got = _stored(stored) | got
        off = tuple(s for s in got.get("off", "").split(",") if s and (sources is None or s in sources))
        date = got.get("date") if got.get("when") == "date" else None
        when = got.get("when") if got.get("when") in WINDOWS or date else "week"
        return cls(when or "week", got["price"] if got.get("price") in PRICES else "any", got.get("q", "").strip(), off, date)

    def to_query_string(self) -> str:
        """Defaults are left out."""
        parts = {"when": self.when if self.when != "week" else "", "price": self.price if self.price != "any" else "", "q": self.q, "off": ",".join(self.off), "date": self.date or ""}
        return urlencode({k: v for k, v in parts.items() if v})

    def to_stored(self, last_window: str = "week") -> str:
        """What a visitor's next visit begins with: window (the last one while a single day is picked), price, sources."""
        return json.dumps({"when": last_window if self.when == "date" else self.when, "price": self.price, "off": list(self.off)})

    @property
    def terms(self) -> list[str]:
        return _fold(self.q).split()

    def matches(self, hay: Column) -> Column:
        """Every folded term is somewhere in the folded haystack."""
        out = F.lit(True)
        for term in self.terms:
            out = out & F.contains(hay, F.lit(term))
        return out

    def before_toggle(self, events: DataFrame, today: Column, hay: str | None = None) -> DataFrame:
        picked = F.lit(self.date).cast("date") if self.date else None
        out = events.filter(in_window(F.col("date"), self.when, today, picked) & price_matches(F.col("free"), self.price))
        return out.filter(self.matches(F.col(hay))) if hay and self.terms else out

    def rows(self, events: DataFrame, today: Column, hay: str | None = None) -> DataFrame:
        out = self.before_toggle(events, today, hay)
        return out.filter(~F.col("source").isin(*self.off)) if self.off else out


def facet_counts(events: DataFrame, spec: QuerySpec, today: Column, hay: str | None = None) -> DataFrame:
    """Matches per source, whatever is switched off; sources without a match count 0."""
    found = spec.before_toggle(events, today, hay).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return events.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def page(events: DataFrame, more: int = 0) -> DataFrame:
    """The rows shown after `more` requests for more, by day and time; times unknown come last, titles break ties."""
    return events.orderBy("date", F.col("time").asc_nulls_last(), F.expr("title COLLATE UNICODE")).limit(PAGE_ROWS * (more + 1))


def labels(events: DataFrame, now: Column) -> DataFrame:
    """Day heading, relative day and whether the start is past."""
    today = F.to_date(now)
    relative = F.when(F.col("date") == today, "Today").when(F.col("date") == F.date_add(today, 1), "Tomorrow").otherwise("")
    past = (F.col("date") == today) & F.coalesce(F.col("time") < F.date_format(now, "HH:mm"), F.lit(False))
    return events.withColumns({"day": F.date_format("date", "EEEE d MMMM"), "relative": relative, "past": past})


def price_tag(free: Column, price: Column) -> Column:
    from ..functions.text import short_price

    return F.when(free, "Free").when(free == F.lit(False), F.coalesce(short_price(price), F.lit("Paid")))


#: What the header says of each window.
WINDOW_WORDS = {"today": "today", "tomorrow": "tomorrow", "week": "in the next 7 days", "month": "in the next 30 days"}


def header(spec: QuerySpec, rows: DataFrame, sources: int) -> DataFrame:
    """One row: the line above the result, such as "12 events in the next 7 days · 3 of 5 sources"."""
    n = F.count(F.lit(1))
    when = F.concat(F.lit("on "), F.date_format(F.lit(spec.date).cast("date"), "EEEE d MMMM")) if spec.when == "date" else F.lit(WINDOW_WORDS[spec.when])
    off = F.lit(f" · {sources - len(spec.off)} of {sources} sources" if spec.off else "")
    return rows.agg(F.concat(F.format_number(n, 0), F.when(n == 1, " event ").otherwise(" events "), when, off).alias("header"))


def facet_lock(events: DataFrame, spec: QuerySpec, today: Column, hay: str | None = None) -> DataFrame:
    """(source, n, total, last_date, locked, hint): matches of each source, what it has without filters, and whether
    it can be switched; a source without matches can't."""
    totals = events.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.max("date").alias("last_date"))
    found = totals.join(facet_counts(events, spec, today, hay), "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hint = F.when(F.col("n") > 0, F.lit(None).cast("string")).when(F.col("total") > 0, "No events match the current filters").otherwise("No upcoming events")
    return found.select("source", "n", "total", "last_date", (F.col("n") == 0).alias("locked"), hint.alias("hint"))
