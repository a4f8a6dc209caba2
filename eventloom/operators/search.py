"""Substring search by an index of trigrams.

The index has rows of a trigram of folded texts and the ids of some texts that have it, sorted by trigram in each part,
so that a search reads the stretches of its own trigrams only. A text that has all trigrams of all terms is a candidate;
the text itself decides. Terms of fewer than three characters have no trigram: they are looked for in the candidates, or
in every text if no term has one.

Tasks list the trigrams of about `CHARS` characters of text at once: what is shuffled and sorted is a row for each
trigram of such a stretch with all ids there, not one for each trigram of each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: Parts that a very common trigram's texts are dealt over; characters whose trigrams are listed at once.
SPREAD, CHARS = 64, 1 << 20


def _listed(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct trigrams of texts, where each one's stretch begins and ends in the third, and positions of the texts
    that have it, stretch by stretch."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters, rank = np.flatnonzero(seen), np.zeros(0x110000, np.int64)
    rank[letters] = np.arange(n := len(letters))
    p, inside = rank[points], of[:-2] == of[2:]
    codes, of, known = ((p[:-2] * n + p[1:-1]) * n + p[2:])[inside], of[:-2][inside], None
    if n**3 * len(texts) >= 1 << 63:
        known, codes = np.unique(codes, return_inverse=True)
    both = np.sort(codes * len(texts) + of)
    codes, of = np.divmod(both[np.diff(both, prepend=-1) > 0], len(texts))
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    codes = codes[starts] if known is None else known[codes[starts]]
    spelt = letters[np.stack([codes // n // n, codes // n % n, codes % n], axis=1)].astype(np.uint32).tobytes().decode("utf-32-le") if len(codes) else ""
    return [spelt[i : i + 3] for i in range(0, len(spelt), 3)], np.append(starts, len(of)), of


def index(texts: DataFrame, key: str, text: str, chars: int = CHARS) -> DataFrame:
    """(gram, keys), each part sorted by gram, so that a search skips what it doesn't ask for; the rows of one gram are
    dealt over `SPREAD` parts at most. A gram's keys differ within a row; a text of more than `chars` characters may be in
    several of its rows."""

    def run(batches):
        for batch in batches:
            at, some, size = [], [], 0
            for i, whole in enumerate(batch.column(1)):
                whole = whole.as_py() or ""
                for k in range(0, len(whole) - 2, chars):
                    at.append(i)
                    some.append(whole[k : k + chars + 2])
                    size += len(some[-1])
                    if size >= chars:
                        yield rows(batch.column(0), at, some)
                        at, some, size = [], [], 0
            if some:
                yield rows(batch.column(0), at, some)

    def rows(keys, at, some):
        grams, offsets, of = _listed(some)
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), keys.take(pa.array(np.array(at)[of])))], names=["gram", "keys"])

    made = texts.select(key, fold(F.col(text)).alias("text")).mapInArrow(run, f"gram string, keys array<{texts.schema[key].dataType.simpleString()}>")
    return made.repartition("gram", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(SPREAD))).sortWithinPartitions("gram")


def search(texts: DataFrame, postings: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Rows of texts that contain every term; terms are folded like the texts."""
    wanted = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
    found = texts
    if wanted:
        asked = postings.filter(F.col("gram").isin(*wanted)).select("gram", F.explode("keys").alias(key))
        many = asked.groupBy(key).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select(key)
        found = texts.join(many, key, "left_semi")
    hay = fold(F.col(text))
    for t in terms:
        found = found.filter(F.contains(hay, F.lit(t)))
    return found
