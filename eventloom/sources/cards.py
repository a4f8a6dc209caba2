"""Listings on HTML pages: each card that a selector names becomes a row of field texts.

Selectors are those of style sheets as far as listings need them: a tag, .class, [attr], [attr^=x], [attr*=x], and
descent by spaces. A field is a selector, with @attr for an attribute in place of the text; "" is the card itself.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import VOID

_STEP = re.compile(r"(?P<tag>[a-z][a-z0-9-]*)?(?P<classes>(?:\.[\w-]+)*)(?P<attrs>(?:\[[^\]]+\])*)$")


class _Node:
    __slots__ = ("attrs", "classes", "inside", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.inside = tag, attrs, parent, []
        self.classes = attrs.get("class", "").split()

    def text(self) -> str:
        return " ".join("".join(x if isinstance(x, str) else f" {x.text()} " for x in self.inside).split())

    def nodes(self):
        for x in self.inside:
            if not isinstance(x, str):
                yield x
                yield from x.nodes()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up.parent is not None and up.tag != tag:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def _steps(selector: str) -> list:
    out = []
    for part in selector.split():
        m = _STEP.match(part)
        if not m:
            raise ValueError(f"no such selector: {selector}")
        attrs = [re.fullmatch(r"([\w-]+)(?:([\^*]?)=[\"']?([^\"']*)[\"']?)?", a).groups() for a in re.findall(r"\[([^\]]+)\]", m["attrs"])]
        out.append((m["tag"], m["classes"].split(".")[1:], attrs))
    return out


def _fits(node: _Node, step) -> bool:
    tag, classes, attrs = step
    value = {"": lambda a, b: a == b, "^": str.startswith, "*": str.__contains__}
    return (not tag or node.tag == tag) and all(c in node.classes for c in classes) and all(a in node.attrs and (b is None or value[op or ""](node.attrs[a], b)) for a, op, b in attrs)


def _find(top: _Node, steps: list) -> list[_Node]:
    if not steps:
        return [top]
    found = []
    for node in top.nodes():
        if not _fits(node, steps[-1]):
            continue
        up, left = node.parent, len(steps) - 2
        while left >= 0 and up is not None and up is not top:
            left -= _fits(up, steps[left])
            up = up.parent
        if left < 0:
            found.append(node)
    return found


def _read(html: str | None, card: list, fields: dict[str, tuple[list, str]]) -> list[dict[str, list[str]]]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return [{name: [t for n in _find(c, steps) if (t := n.attrs.get(attr, "").strip() if attr else n.text())] for name, (steps, attr) in fields.items()} for c in _find(tree.root, card)]


def html_cards(pages: DataFrame, card: str, fields: dict[str, str]) -> DataFrame:
    """pages(url, body, ...) to a row for each card: what pages has, but the body, then nth and fields, a map of each
    field's texts in page order."""
    steps, own = _steps(card), {name: (_steps(s.partition("@")[0]), s.partition("@")[2]) for name, s in fields.items()}

    @F.pandas_udf("array<map<string,array<string>>>")
    def read(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: _read(b, steps, own))

    rest = [c for c in pages.columns if c != "body"]
    return pages.select(*rest, F.posexplode(read("body")).alias("nth", "fields"))


def field(name: str, nth: int = 0) -> Column:
    """A field's text, null where the card has none."""
    return F.get(F.col("fields")[name], F.lit(nth))
