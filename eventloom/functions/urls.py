"""URL functions over columns."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed as X
from .regex import java


def absolute_url(url: Column) -> Column:
    """The trimmed URL if it is an absolute http(s) one, else null."""
    u = F.trim(url)
    return F.when(u.rlike(r"(?i)^https?://[^/\s?#]+") & ~u.rlike(r"\s"), u)


def normalize_url(raw: Column) -> Column:
    """https, no www., no fragment, no tracking parameters, sorted parameters, single slashes, no slash at the end,
    lower case. What isn't an absolute URL is trimmed and lower-cased."""
    u = F.trim(raw)
    bare = F.regexp_replace(u, "#.*", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"(?i)^https?://([^/?]+)", 1)), r"^www\.", "")
    host = F.regexp_replace(host, r":(?:80|443)\z", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?i)^https?://[^/?]+([^?]*)", 1), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+\z", "")).otherwise(path)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)", 1), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(java(X.TRACKING_PARAM)))
    pairs = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    # equal names keep their order
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(keyed, lambda s: s["p"]), "&")
    whole = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(absolute_url(u).isNotNull(), F.lower(whole)).otherwise(F.lower(u))


@F.pandas_udf(T.StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """A link of a page as an absolute URL; null for fragments, mail, telephone and script links."""

    def one(h, b):
        h = (h or "").strip().replace("&amp;", "&")
        if not h or h.startswith("#") or h.lower().startswith(("mailto:", "tel:", "javascript:")):
            return None
        try:
            return urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)])


def event_id(source: Column, url: Column, date: Column, time: Column) -> Column:
    key = F.concat_ws("|", source, url, date.cast("string"), F.coalesce(time, F.lit("")))
    return F.substring(F.sha1(key.cast("binary")), 1, 12)
