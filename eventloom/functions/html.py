"""HTML into text, lines, nodes and embedded JSON: small parsers inside Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROP = frozenset("script style noscript iframe svg img figure button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div li h1 h2 h3 h4 h5 h6 tr blockquote section".split())
_LINE = _BLOCK | {"dt", "dd"}


class _Reader(HTMLParser):
    """Text with a mark at the end of each block (for lines, at its start too)."""

    def __init__(self, lines: bool):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.lines, self.mark = [], 0, lines, "\n" if lines else " "

    def handle_starttag(self, tag, attrs):
        if tag in _DROP:
            self.skip += tag not in VOID
        elif tag == "br" or self.lines and tag in _LINE:
            self.out.append(self.mark)

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.skip = max(0, self.skip - 1)
        elif tag in (_LINE if self.lines else _BLOCK):
            self.out.append(self.mark)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data) if self.lines else data)


def _tidy(text: str) -> str:
    return " ".join((text if text.isascii() else re.sub("[​-‍﻿]", "", text)).split())


def text_of(html: str | None) -> str:
    if not html or not re.search("[<&]", html):
        return _tidy(html or "")
    reader = _Reader(False)
    reader.feed(html)
    reader.close()
    return _tidy("".join(reader.out))


def lines_of(html: str | None) -> list[str]:
    reader = _Reader(True)
    reader.feed(html or "")
    reader.close()
    return [t for line in "".join(reader.out).split("\n") if (t := _tidy(line))]


def each(column: pa.Array, fn, kind: pa.DataType) -> pa.Array:
    """fn of every value of a batch, called once for each distinct one."""
    coded = column.dictionary_encode()
    made = pa.array([*map(fn, coded.dictionary.to_pylist()), fn(None)], kind)
    return made.take(coded.indices.fill_null(len(coded.dictionary)))


def _reading(references: tuple[str, ...] | None):
    """What makes all ampersands of a page text, but for those of the named references, each with its semicolon."""
    if references is None:
        return lambda html: html or ""
    other = re.compile(f"&(?!(?:{'|'.join(references)});)")
    return lambda html: other.sub("&amp;", html or "")


def html_text(html: Column | str, references: tuple[str, ...] | None = None) -> Column:
    """A page's text. references: the named character references that are read; all that HTML knows if there are none."""
    read = _reading(references)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return each(column, lambda page: text_of(read(page)), pa.string())

    return run(html)


def html_lines(html: Column | str, references: tuple[str, ...] | None = None) -> Column:
    read = _reading(references)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(column: pa.Array) -> pa.Array:
        return each(column, lambda page: lines_of(read(page)), pa.list_(pa.string()))

    return run(html)


class _Nodes(HTMLParser):
    """Rows of node, parent, depth, tag, attributes and own texts, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # the open elements, and where each tag stands among them
        self.rows, self.open, self.where = [], [], {}

    def handle_starttag(self, tag, attrs):
        row = (len(self.rows), self.open[-1][0] if self.open else None, len(self.open), tag, {k: v or "" for k, v in attrs}, [])
        self.rows.append(row)
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.open))
            self.open.append(row)

    def handle_endtag(self, tag):
        if self.where.get(tag):
            at = self.where[tag][-1]
            for row in self.open[at:]:
                self.where[row[3]].pop()
            del self.open[at:]

    def handle_data(self, data):
        if self.open:
            self.open[-1][5].append(data)

    def last(self) -> list[int]:
        """The last node inside of each, itself if there is none."""
        out = [row[0] for row in self.rows]
        for row in reversed(self.rows):
            if row[1] is not None:
                out[row[1]] = max(out[row[1]], out[row[0]])
        return out


_INT, _TEXT = ("int", pa.int32()), ("string", pa.string())
NODE = {"node_id": _INT, "parent_id": _INT, "depth": _INT, "tag": _TEXT, "attrs": ("map<string,string>", pa.map_(pa.string(), pa.string())), "own_text": _TEXT, "last_id": _INT}
#: Nodes in a batch, one page's more at most: pages are read one by one, so that memory doesn't grow with a part's pages.
NODES = 8192


def html_nodes(pages: DataFrame, key: str, html: str = "html", fields: tuple[str, ...] = tuple(NODE), references: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each element of each page, with those fields that are asked for: selectors become filters and joins on
    it. A node's subtree is the interval of ids from its own to last_id. references: see html_text."""
    read = _reading(references)
    make = {"node_id": lambda r, _: r[0], "parent_id": lambda r, _: r[1], "depth": lambda r, _: r[2], "tag": lambda r, _: r[3], "attrs": lambda r, _: list(r[4].items()), "own_text": lambda r, _: _tidy("".join(r[5])), "last_id": lambda r, last: last[r[0]]}

    def run(batches):
        for batch in batches:
            keys, at, columns = batch.column(0), [], {f: [] for f in fields}
            for i, page in enumerate(batch.column(1)):
                reader = _Nodes()
                reader.feed(read(page.as_py()))
                reader.close()
                last = reader.last() if "last_id" in columns else ()
                at.extend([i] * len(reader.rows))
                for f, values in columns.items():
                    values.extend(make[f](r, last) for r in reader.rows)
                if len(at) >= NODES or i + 1 == len(keys):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(columns[f], NODE[f][1]) for f in fields)], names=[key, *fields])
                    at, columns = [], {f: [] for f in fields}

    schema = ", ".join([f"{key} {pages.schema[key].dataType.simpleString()}", *(f"{f} {NODE[f][0]}" for f in fields)])
    return pages.select(key, html).mapInArrow(run, schema)


def json_ld(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, node): the JSON-LD nodes of a page as variants, arrays and @graph flattened; broken scripts are left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    parsed = pages.select(key, F.explode(found).alias("raw")).select(key, F.try_parse_json("raw").alias("v")).filter("v IS NOT NULL")
    whole = F.expr("CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN try_variant_get(v, '$', 'array<variant>') ELSE array(v) END")
    tops = parsed.select(key, F.explode(whole).alias("v"))
    graph = F.expr("coalesce(try_variant_get(v, '$.@graph', 'array<variant>'), array(v))")
    return tops.select(key, F.explode(graph).alias("node"))


def app_state(html):
    """The JSON of a page's embedded application state, as a variant."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, r"(?is)<script[^>]*id=[\"']?__NEXT_DATA__[^>]*>(.*?)</script>", 1), F.lit("")))
