"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a
target stops at twice its source's size and the excess is shared again by weight (water filling, solved in
closed form over the sources sorted by size per weight). Schedule: golden-ratio points mapped through the
cumulative targets give each slot a source; a source's slots are ranked, and rank r takes its block r (the
second pass over the blocks follows the first). Blocks are equal cuts of the source's documents in a hashed
order, and their own order is hashed too. A source that the points gave too few slots gets the rest at the end.

The number of slots is a parameter, so the schedule is as large for any input; only documents and the pieces
of them that lie in blocks grow. Prefix sums within a source run over hashed buckets first and inside each
bucket next, so no task sorts a whole source.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own;
repeated rows count each; an empty table, or one without words, gives no slots and `taken` 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, words, written

WEIGHTS, SHARE, CAP, SLOTS = (3, 1, 2), 1.5, 2.0, 1 << 16
#: 1 / golden ratio.
STEP = 0.6180339887498949
#: Buckets by the first hex digits of the document's hash.
HEX = 3
#: Fractions of a document are counted in whole units of 1 / UNIT.
UNIT = 1 << 30


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words, written once: the texts are read a single time."""
    return written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "mix-sizes")


def source_targets(sizes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A row for each source: place, weight, source_size, target, and its equal blocks (block_words, blocks, quota)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*map(F.lit, WEIGHTS))
    by_name, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    per = per.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.get(weights, (F.col("place") - 1) % len(WEIGHTS)))
    per = per.withColumn("full", F.lit(CAP) * F.col("source_size")).withColumn("wanted", F.lit(SHARE) * F.sum("source_size").over(everything))
    order = W.orderBy(F.col("full") / F.col("weight"), "place")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", (F.col("wanted") - before) / rest).withColumn("nth", F.row_number().over(order))
    level = F.min_by("level", F.when(F.col("level") <= F.col("full") / F.col("weight"), F.col("nth"))).over(everything)
    target = F.least(F.coalesce(level, F.lit(float("inf"))) * F.col("weight"), F.col("full"))
    about = F.greatest(F.lit(1.0), F.ceil(F.col("wanted") / F.lit(slots)))
    per = per.withColumn("target", target).withColumn("block_words", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(1.0), F.round(F.col("source_size") / about)))).cast("long"))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    per = per.withColumn("quota", F.least(F.ceil(F.round("target") / F.col("block_words")).cast("long"), 2 * F.col("blocks")))
    return per.select("source", "place", "weight", "source_size", "target", "block_words", "blocks", "quota")


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The mix: slot (its order), place of the source, rank among the source's slots, block and words taken of it."""
    spark = targets.sparkSession
    upto = F.sum("target").over(W.orderBy("place"))
    ranges = targets.filter("quota > 0").withColumn("hi", upto).withColumn("all", F.sum("target").over(W.partitionBy()))
    ranges = ranges.select("place", "block_words", "blocks", "quota", "target", ((F.col("hi") - F.col("target")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    # the sources' ranges are one array, a scalar of the plan; a point finds its own by a filter over it
    one = ranges.agg(F.sort_array(F.collect_list(F.struct("lo", "place", "quota", "block_words", "blocks", "target"))).alias("r"))
    points = spark.range(slots).withColumn("x", F.expr(f"({STEP} * (id + 1)) - floor({STEP} * (id + 1))"))
    own = F.element_at(F.filter("r", lambda s: s["lo"] <= F.col("x")), -1)
    of = points.withColumn("r", one.scalar()).filter("size(r) > 0").select("id", own.alias("s")).filter("s IS NOT NULL").select("id", "s.*")
    ranked = of.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy("id")) - 1).filter("rank < quota")
    ranked = ranked.select("id", "place", F.col("rank").cast("long").alias("rank"), "quota", "block_words", "blocks", "target")
    got = ranked.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    late = ranges.join(got, "place", "left").select("place", "quota", "block_words", "blocks", "target", F.coalesce("n", F.lit(0)).alias("n")).filter("n < quota")
    late = late.select(F.lit(slots).cast("long").alias("id"), "place", F.explode(F.expr("sequence(n, quota - 1)")).alias("rank"), "quota", "block_words", "blocks", "target")
    every = ranked.unionByName(late)
    words_of = F.least(F.col("block_words"), F.round("target").cast("long") - F.col("rank") * F.col("block_words"))
    every = every.select(F.col("id").alias("slot"), "place", "rank", F.pmod("rank", "blocks").alias("nth"), words_of.alias("words"), "block_words")
    # the source's blocks in hashed order
    blocks = targets.filter("quota > 0").select("place", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    blocks = blocks.withColumn("nth", (F.row_number().over(W.partitionBy("place").orderBy(F.md5(F.concat_ws("|", F.col("place").cast("string"), F.col("block").cast("string")).cast("binary")), "block")) - 1).cast("long"))
    return every.join(blocks, ["place", "nth"]).select("slot", "place", "rank", "block", "block_words", "words")


def placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their interval [start, start + size) in the stream of their source, in hashed order."""
    t = targets.select(F.col("source").alias("s_"), "place", "source_size", "target", "block_words")
    docs = sizes.join(t, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    docs = docs.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    docs = docs.withColumn("bucket", F.substring("h", 1, HEX))
    sums = docs.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("place", "bucket", (F.sum("n").over(W.partitionBy("place").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = W.partitionBy("place", "bucket").orderBy("h", "doc_id", "size")
    own = docs.withColumn("nth", F.row_number().over(inside)).withColumn("before", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return own.join(base, ["place", "bucket"]).withColumn("start", F.col("base") + F.col("before")).drop("base", "before", "h")


def _mixed(docs: DataFrame, slots: int) -> DataFrame:
    """What mix() gives, with each row's place, bucket and rank in the bucket."""
    sizes = sized(docs)
    targets = written(source_targets(sizes, slots), "mix-targets")
    taken = schedule(targets, slots).select("place", "block", "words")
    own = placed(sizes, targets).filter("size >= 0")
    parts = own.withColumn("block", F.explode_outer(F.expr("CASE WHEN size > 0 THEN sequence(start div block_words, (start + size - 1) div block_words) END")))
    hit = parts.join(taken, ["place", "block"], "left")
    first = F.col("block") * F.col("block_words")
    words_ = F.coalesce("words", F.lit(0))  # a block that no slot takes; least() would pass over a null
    overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), first + words_) - F.greatest("start", first))
    return hit.groupBy("place", "bucket", "nth", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(overlap), F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, source, text)."""
    return _mixed(docs, slots).select("doc_id", "size", "source_size", "target", "taken")


def whole_copies(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """mix() of the rows with words, with copies: how often the whole document is taken. The fractions left over add up
    along the source's hashed order, and a document gets one copy more where their sum passes a half, so each source
    keeps its share however long its documents are."""
    rows = written(_mixed(docs, slots).filter("size > 0").withColumn("part", F.expr(f"((taken % size) * {UNIT}) div size")), "mix-taken")
    sums = rows.groupBy("place", "bucket").agg(F.sum("part").alias("n"))
    base = sums.select("place", "bucket", (F.sum("n").over(W.partitionBy("place").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = W.partitionBy("place", "bucket").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    upto = rows.withColumn("upto", F.sum("part").over(inside)).join(base, ["place", "bucket"]).withColumn("upto", F.col("upto") + F.col("base") + UNIT // 2)
    copies = F.expr(f"taken div size + upto div {UNIT} - (upto - part) div {UNIT}").cast("int")
    return upto.select("doc_id", "size", "source_size", "target", "taken", copies.alias("copies"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLE = f"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
q AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM p),
r AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[((place - 1) % {len(WEIGHTS)} + 1)::INT] AS weight, {CAP}::DOUBLE * source_size AS "full", {SHARE}::DOUBLE * (SELECT sum(source_size)::BIGINT FROM p) AS wanted FROM q),
s AS (SELECT *, (wanted - coalesce(sum("full") OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev, row_number() OVER o AS nth FROM r WINDOW o AS (ORDER BY "full" / weight, place)),
t AS (SELECT *, least((SELECT min_by(lev, nth) FROM s WHERE lev <= "full" / weight) * weight, "full") AS target, greatest(1, ceil(wanted / {SLOTS})) AS about FROM s),
u AS (SELECT *, greatest(1, ceil(source_size / greatest(1, round(source_size / about))))::BIGINT AS bw FROM t),
v AS (SELECT *, ceil(source_size / bw)::BIGINT AS blocks, least(ceil(round(target) / bw)::BIGINT, 2 * ceil(source_size / bw)::BIGINT) AS quota FROM u),
b AS (SELECT place, block, row_number() OVER (PARTITION BY place ORDER BY md5(place || '|' || block), block) - 1 AS nth FROM (SELECT place, unnest(range(0, blocks)) AS block FROM v WHERE quota > 0)),
k AS (SELECT place, bw, rank % blocks AS nth, least(bw, round(target)::BIGINT - rank * bw) AS words FROM (SELECT *, unnest(range(0, quota)) AS rank FROM v WHERE quota > 0)),
x AS (SELECT b.place, b.block, k.words FROM k JOIN b ON k.place = b.place AND k.nth = b.nth),
e AS (SELECT d.doc_id, d.size, v.place, v.source_size, v.target, v.bw, sum(d.size) OVER (PARTITION BY v.place ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS st FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
y AS (SELECT *, unnest(CASE WHEN size > 0 THEN range((st // bw)::BIGINT, ((st + size - 1) // bw)::BIGINT + 1) ELSE [-1] END) AS block FROM e)
SELECT y.doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  coalesce(sum(greatest(0, least(st + size, y.block * bw + coalesce(words, 0)) - greatest(st, y.block * bw))), 0)::BIGINT AS taken
FROM y LEFT JOIN x ON y.place = x.place AND y.block = x.block GROUP BY y.doc_id"""
