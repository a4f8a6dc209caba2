"""Text functions over columns."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as X
from .regex import java, matches, part, swap


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns set that are computed once for each row: neither what names them nor a filter on them is merged with
    how they came about."""
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def clean(text: Column) -> Column:
    """No zero-width characters, one space for each run of white space, trimmed; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.trim(swap(bare, r"\s+", " "))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def truncate(text: Column, most: int) -> Column:
    """At most `most` characters, cut at a space in the last two fifths if there is one, and an ellipsis."""
    cut = F.substring(text, 1, most - 1)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    at_word = F.when((F.instr(cut, " ") > 0) & (space > most * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(at_word, r"[\s,;:.–—-]+\z", ""), F.lit("…")))


def strip_wrapping_quotes(text: Column) -> Column:
    t = F.trim(text)
    out = t
    for a, b in reversed([('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’")]):
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        out = F.when((F.length(t) > 2) & t.startswith(a) & t.endswith(b) & ~F.contains(inner, F.lit(b)), F.trim(inner)).otherwise(out)
    return out


def unshout(text: Column) -> Column:
    """Title case for texts of six letters or more that are all capitals."""
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    marked = F.regexp_replace(F.lower(text), r"(^|[\s(“\"'‘-])(\p{L})", "$1\u0001$2")
    words = F.split(marked, "\u0001")
    cased = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), "")
    return F.when((F.length(letters) < 6) | letters.rlike("[a-z]"), text).otherwise(cased)


@cache
def _unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)


_HANGUL, _HANGUL_LAST = 0xAC00, 0xD7A3


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters with one character in place of them, those characters (none at the end for marks that go), and
    characters with several, as unicodedata has them; Hangul syllables follow a rule of their own."""
    one, gone, several = {}, [], {}
    for point in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        c = chr(point)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if bare == c or _HANGUL <= point <= _HANGUL_LAST:
            continue
        if len(bare) == 1:
            one[c] = bare
        elif bare:
            several[c] = bare
        else:
            gone.append(c)
    return "".join([*one, *gone]), "".join(one.values()), several


def _syllable(c: Column) -> Column:
    """A Hangul syllable's two or three letters, by arithmetic."""
    s = F.ascii(c) - _HANGUL
    hexed = lambda n: F.lpad(F.hex(n), 4, "0")
    letters = F.concat(hexed(F.lit(0x1100) + F.floor(s / 588)), hexed(F.lit(0x1161) + F.floor(s % 588 / 28)), F.when(s % 28 > 0, hexed(F.lit(0x11A7) + s % 28)).otherwise(""))
    return F.decode(F.unhex(letters), "UTF-16BE")


def fold(text: Column) -> Column:
    """Lower case, decomposed for compatibility, without combining accents (U+0300 to U+036F).

    One pass replaces the characters that become one other or none. Of what is not ASCII then, the characters that
    become several are replaced one distinct character after the other. Marks beyond U+036F keep the order they stand in."""
    those, by, several = _decompositions()
    known = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    letters = lambda c: F.when(c.between(chr(_HANGUL), chr(_HANGUL_LAST)), _syllable(c)).otherwise(F.element_at(known, c))

    def spelt(bare: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
        return F.aggregate(found, bare, lambda out, c: let(letters(c), lambda by: F.when(by.isNull(), out).otherwise(F.replace(out, c, by))))

    # lower case of ASCII alone is all there is to do
    return let(F.lower(text), lambda low: F.when(F.octet_length(low) == F.length(low), low).otherwise(let(F.translate(low, those, by), spelt)))


def title_tokens(folded: Column) -> Column:
    """The set of telling words of a title that `fold` was applied to."""
    bare = F.regexp_replace(swap(folded, r"['’]s\b", ""), "[^a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: (F.length(w) > 1) & ~w.isin(X.STOPWORDS)))


def place_tokens(location: Column) -> Column:
    bare = F.regexp_replace(F.lower(location), "[^a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: (F.length(w) > 2) & ~w.isin(X.GENERIC_PLACE) & ~w.rlike("^[0-9]")))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; for sets of three or more, nine tenths of the containment if that is more."""
    shared, small = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    jaccard = shared / F.size(F.array_union(a, b))
    return F.when(small == 0, F.lit(0.0)).when(small >= 3, F.greatest(jaccard, shared / small * 0.9)).otherwise(jaccard)


#: Every status word has one of these: most titles have none, and are spared the patterns.
_STATUS_HINT = "(?i)sold|booked|cancel|postponed|waiting|few|new|rescheduled|date|now"


def title_status(title: Column) -> Column:
    """struct(title, cancelled): the title without status markers, and whether one of them says cancelled."""

    def without(pattern: str):
        return lambda x: F.struct(F.trim(swap(x["t"], pattern, " ")).alias("t"), (x["cancelled"] | matches(part(x["t"], pattern, 0), X.CANCELLED)).alias("cancelled"))

    def unmarked(t: Column) -> Column:
        out = F.struct(t.alias("t"), F.lit(False).alias("cancelled"))
        read = out
        for pattern in X.STATUS_MARKERS:
            read = let(read, without(pattern))
        return F.when(t.rlike(_STATUS_HINT), read).otherwise(out)

    out = let(clean(title), unmarked)
    out = let(out, lambda x: F.struct(unshout(x["t"]).alias("t"), x["cancelled"].alias("cancelled")))
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+([:,.!?])", "$1"), r"[\s|–—-]+\z", ""))
    return let(out, lambda x: F.struct(bare(strip_wrapping_quotes(x["t"])).alias("title"), x["cancelled"].alias("cancelled")))


def format_marker(title: Column) -> tuple[Column, Column]:
    """(title without a format prefix or suffix, online: true, false, or null without a marker)."""
    first = none_if_empty(part(title, X.FORMAT_PREFIX, 1))
    bare = swap(title, X.FORMAT_PREFIX, "")
    last = F.coalesce(none_if_empty(part(bare, X.FORMAT_SUFFIX, 1)), none_if_empty(part(bare, X.FORMAT_SUFFIX, 2)))
    bare = F.trim(swap(bare, X.FORMAT_SUFFIX, ""))
    marker = F.coalesce(first, last)
    found = marker.isNotNull() & (F.length(bare) >= 3)
    return F.when(found, bare).otherwise(title), F.when(found, marker.rlike(java("^(?:online|virtual|live)")))


def labelled(lines: Column, label: str) -> Column:
    """The value of the first line "label: value", or the next line where the value is empty."""
    hit = lambda x: x.rlike(java(rf"^(?:{label})\s*[:：]"))
    values = F.transform(lines, lambda x, i: F.when(hit(x), F.coalesce(none_if_empty(part(x, rf"^(?:{label})\s*[:：]\s*(.*)$", 1)), F.get(lines, i + 1))))
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def short_price(price: Column) -> Column:
    """The first pound amount of a price, `from ` before it if there are several."""
    found = F.regexp_extract_all(F.coalesce(price, F.lit("")), F.lit(r"£\s*[0-9]+(?:\.[0-9]{2})?"), F.lit(0))
    first = F.regexp_replace(F.get(found, F.lit(0)), r"\s", "")
    return F.when(F.size(F.array_distinct(found)) > 1, F.concat(F.lit("from "), first)).otherwise(first)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def error_text(message: Column) -> Column:
    """The first line of an error, 300 characters at most."""
    return F.substring(F.split(message, "\n")[0], 1, 300)


def short_error(message: Column) -> Column:
    """An error with hosts in place of URLs, without what was tried."""
    hosts = F.regexp_replace(message, r"https?://([^/\s)]+)[^\s)]*", "$1")
    return none_if_empty(F.trim(F.regexp_replace(hosts, r"\s*\((?:challenge did not clear[^)]*|in-page fetch[^)]*)\)", "")))


def lenient_json(raw: Column) -> Column:
    """A variant; where JSON is broken by line breaks or tabs inside strings, these are escaped first."""
    stretches = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\[\s\S])*+"?|[^"]++'), F.lit(0))
    inside = lambda x: F.replace(F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    mended = F.array_join(F.transform(stretches, lambda x: F.when(x.startswith('"'), inside(x)).otherwise(x)), "")
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(mended))


def _marked(text: str, terms: list[str]) -> str:
    folded = [text.lower()] if text.isascii() else [*map(_unaccented, text)]
    whole, spans = "".join(folded), []
    if any(len(t) > 1 and t in whole for t in terms):
        # which character of the text each of the folded ones is from
        at = range(len(text)) if text.isascii() else [i for i, f in enumerate(folded) for _ in f]
        spans = sorted((at[m.start()], at[m.end() - 1] + 1) for t in terms if len(t) > 1 for m in re.finditer(re.escape(t), whole))
    out, done = [], 0
    for a, b in spans:
        if b > done:
            a = max(a, done)
            out += [html.escape(text[done:a], quote=False), "<mark>", html.escape(text[a:b], quote=False), "</mark>"]
            done = b
    return "".join([*out, html.escape(text[done:], quote=False)]).replace('"', "&quot;")


def highlight(text: Column, terms: list[str]) -> Column:
    """Escaped text with <mark> around what matches a folded term of two characters or more; accents don't matter."""

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array((_marked(x.as_py() or "", terms) for x in column), pa.string())

    return run(text)
