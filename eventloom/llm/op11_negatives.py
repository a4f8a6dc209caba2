"""Hard negatives by dual-tree search for the largest inner products.

Candidates and anchors hang in two trees. The upper levels are shared: median splits along main directions, fitted on
a bounded sample (at most `SAMPLE` rows or `SAMPLE_NUMBERS` numbers, whichever is less) and used for every row. Cells
of the candidate tree are cut into blocks of bounded size (a cell with very many rows, copies of one vector for
example, has many blocks), cells of the anchor tree into groups. Inside a block or group, splits go on down to
leaves of a few rows. Each node is a ball, so the inner products between two nodes lie in an interval:
c1.c2 +- (|c1| r2 + |c2| r1 + r1 r2).

A group of anchors walks the candidate tree from the root. Where the interval of a node and the group misses all
score windows of the group's anchors, the node goes for all of them at once. What is left are pairs of a group and a
block; each is a row that meets both, and inside it intervals of leaf pairs prune again before scores are computed
exactly, in integers. Windows are narrowed first by a look at the block that lies nearest to the group: five scores
found there bound what the rest must reach. Bounds only skip work; the result is exact.

Positives are such a search among rows of the same label, without limits; negatives one among rows of other labels
with a window [80 %, 100 %] of the score of each positive.

Defined cases: rows with a null label, a null vector, a null, non-finite or huge (2^20 or more) component, or without
a vec_id, which no result could name, take no part; vectors of unequal length count as filled up with zeros, an empty
one scores 0; "other" rows have another vec_id; equal rows count each, as an anchor once; ties go to the smaller
vec_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, mapped, table, written
from .tokens import mix

EVERY, POSITIVES, NEGATIVES = 100, 5, 5
SAMPLE, SAMPLE_NUMBERS, DEEPEST = 16_384, 1 << 22, 12
#: Numbers in a block and rows in it at most (about: rows are dealt out at random), rows in a leaf; the same for anchors.
BLOCK_NUMBERS, BLOCK, LEAF, GROUP, GROUP_LEAF = 1 << 18, 4096, 64, 256, 16
_FAR = 1 << 62
_PACK = "id long, d int, ids binary, labels binary, vectors binary, leaves binary"


def prepared(rows: DataFrame) -> DataFrame:
    """rows(vec_id, embedding, label) to vec_id, label and the components floor(256 x), of rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 20))))
    rows = rows.select("vec_id", "embedding", "label").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int")).alias("vector"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of numbers as rows of d numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths(), np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), d), np.int32)
    out[np.arange(d) < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Tree:
    """The upper levels: median splits of a sample. Nodes are numbered as in a heap, from 1; cells are the last level."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, d = depth, sample.shape[1]
        self.direction, self.cut = np.zeros((1 << depth, d)), np.zeros(1 << depth)
        self.center = np.zeros((2 << depth, d))
        draw = np.random.default_rng(11)
        todo = [(1, sample.astype(np.float64))]
        while todo:
            node, own = todo.pop()
            if len(own):
                self.center[node] = own.mean(0)
            if node >> depth:
                continue
            away, main = own - self.center[node], draw.standard_normal(d)
            for _ in range(6):  # towards the direction in which the rows differ most
                main = away.T @ (away @ main) if len(own) else main
                main /= np.linalg.norm(main) or 1.0
            along = own @ main
            self.direction[node], self.cut[node] = main, np.median(along) if len(own) else 0.0
            right = along > self.cut[node]
            todo += [(2 * node, own[~right]), (2 * node + 1, own[right])]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", rows, self.direction[node]) > self.cut[node])
        return node - (1 << self.depth)

    def reach(self, rows: np.ndarray, cell: int) -> list[float]:
        """How far the rows of a cell lie from the centre of each node above it, root first."""
        node = cell + (1 << self.depth)
        return [float(np.sqrt(((rows - self.center[node >> up]) ** 2).sum(1).max())) for up in range(self.depth, -1, -1)]


def fitted(rows: DataFrame) -> tuple[Tree, int]:
    """The tree of the rows, and the rows' dimension."""
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    d = max(d or 0, 1)
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // d))
    some = rows.select("vector").sample(min(1.0, 1.2 * most / max(n, 1)), seed=11).limit(most).toArrow()
    block = max(LEAF, min(BLOCK, BLOCK_NUMBERS // d))
    depth = max(0, min(DEEPEST, int(np.ceil(np.log2(max(n, 1) / block))), int(np.log2(max(len(some), 1)))))
    return Tree(_matrix(some.column("vector"), d), depth), d


def dealt(rows: DataFrame, tree: Tree, d: int) -> DataFrame:
    """Rows with their cell, and an even number to cut large cells by: the same on each run, not alike for copies."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            own = _matrix(batch.column("vector"), d)
            seed = np.uint64(zlib.crc32(own.tobytes() + batch.column("vec_id").cast(pa.int64()).to_numpy().tobytes()))
            spread = (mix((np.arange(len(own), dtype=np.uint64) << np.uint64(32)) + seed) >> np.uint64(2)).astype(np.int64)
            vectors = pa.array([v.tobytes() for v in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), vectors, pa.array(shared.value.cells(own)), pa.array(spread)], names=["vec_id", "label", "vector", "cell", "spread"])

    return mapped(rows, run, "vec_id long, label long, vector binary, cell long, spread long")


def _leaves(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which each leaf is a stretch, and where the leaves begin (and the last ends)."""
    order, first, todo = [], [0], [np.arange(len(rows))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            order.append(own)
            first.append(first[-1] + len(own))
            continue
        widest = rows[own].var(0).argmax()
        own = own[np.argsort(rows[own, widest], kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(order), np.array(first, np.int32)


class Pack:
    """The rows of a block or group in memory, leaf by leaf, with the leaves' balls."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        self.first = np.frombuffer(row["leaves"], np.int32)
        self.rows = np.frombuffer(row["vectors"], np.int32).reshape(len(self.ids), row["d"])
        self.large = int(np.abs(self.rows).max(initial=0))
        self.wide = self.rows.astype(np.float64)
        sizes = np.diff(self.first)
        self.center = np.add.reduceat(self.wide, self.first[:-1], axis=0) / sizes[:, None]
        self.length = np.linalg.norm(self.center, axis=1)
        away = np.linalg.norm(self.wide - np.repeat(self.center, sizes, axis=0), axis=1)
        self.radius = np.maximum.reduceat(away, self.first[:-1])


def _packed(pdf: pa.Table, d: int, leaf: int) -> tuple[np.ndarray, np.ndarray, list]:
    rows = np.frombuffer(b"".join(pdf.column("vector").to_pylist()), np.int32).reshape(pdf.num_rows, d)
    order, first = _leaves(rows, leaf)
    number = lambda name: pdf.column(name).to_numpy()[order].astype(np.int64).tobytes()
    return rows, order, [pa.array([x]) for x in (d, number("vec_id"), number("label"), rows[order].tobytes(), first.tobytes())]


def blocks_of(rows: DataFrame, tree: Tree, d: int) -> tuple[DataFrame, dict[int, int]]:
    """The candidates in blocks, and the number of blocks of each cell."""
    size = max(LEAF, min(BLOCK, BLOCK_NUMBERS // d))
    many = {r.cell: -(-r.n // size) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 ** DEEPEST at most
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(own: pa.Table) -> pa.Table:
        key = own.column("id")[0].as_py()
        vectors, _, packed = _packed(own, d, LEAF)
        columns = [pa.array([key], pa.int64()), *packed, pa.array([shared.value.reach(vectors, key >> 24)])]
        return pa.Table.from_arrays(columns, names=["id", "d", "ids", "labels", "vectors", "leaves", "reach"]).cast(_arrow(f"{_PACK}, reach array<double>"))

    cut = F.element_at(F.create_map(*(F.lit(x) for pair in many.items() for x in pair)), F.col("cell")) if many else F.lit(1)
    keyed = rows.withColumn("id", F.shiftleft("cell", 24) + F.pmod("spread", cut.cast("long")))
    return written(keyed.groupBy("id").applyInArrow(run, f"{_PACK}, reach array<double>"), "negatives-blocks"), many


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(","))])


def groups_of(anchors: DataFrame, d: int) -> DataFrame:
    """anchors(gid, akey, vec_id, label, vector, low, high) as one row a group; low and high are the anchors' windows."""
    schema = f"{_PACK}, akeys binary, low binary, high binary"

    def run(own: pa.Table) -> pa.Table:
        _, order, packed = _packed(own, d, GROUP_LEAF)
        akeys = own.column("akey").to_numpy()[order].astype(np.int64).tobytes()
        low, high = (np.array(own.column(k).to_pylist(), np.int64)[order].tobytes() for k in ("low", "high"))
        columns = [own.column("gid").slice(0, 1).combine_chunks(), *packed, *(pa.array([x]) for x in (akeys, low, high))]
        return pa.Table.from_arrays(columns, names=_arrow(schema).names).cast(_arrow(schema))

    return anchors.groupBy("gid").applyInArrow(run, schema)


def _windows(row: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[k], np.int64).reshape(n, -1) for k in ("low", "high"))


def met(groups: DataFrame, tree: Tree, radius: np.ndarray, many: dict[int, int], nearest: bool) -> DataFrame:
    """(gid, bid): the blocks that a group has to look at, or only one of the cell that lies nearest to it.
    radius: of each node of the candidate tree, below 0 where it has no rows."""
    shared = groups.sparkSession.sparkContext.broadcast((tree, radius, many))

    def run(batches):
        tree, radius, many = shared.value
        length = np.linalg.norm(tree.center, axis=1)
        for batch in batches:
            gids, bids = [], []
            for row in batch.to_pylist():
                own = Pack(row)
                low, high = _windows(row, len(own.ids))
                open_ = low <= high
                if not open_.any():
                    continue
                low, high = low[open_].min(), high[open_].max()
                center = own.wide.mean(0)
                away = np.linalg.norm(own.wide - center, axis=1).max()
                nodes = np.array([1])
                while True:
                    nodes = nodes[radius[nodes] >= 0]
                    inner = tree.center[nodes] @ center
                    slack = length[nodes] * away + radius[nodes] * (np.linalg.norm(center) + away) + 1 + 1e-9 * np.abs(inner)
                    nodes = nodes[(inner + slack >= low) & (inner - slack <= high)]
                    if not len(nodes) or nodes[0] >> tree.depth:
                        break
                    nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
                cells = nodes - (1 << tree.depth)
                if nearest and len(cells):
                    cells = cells[[(tree.center[nodes] @ center).argmax()]]
                found = [(c << 24) + s for c in cells.tolist() for s in range(1 if nearest else many[c])]
                gids += [row["id"]] * len(found)
                bids += found
            yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(bids, pa.int64())], names=["gid", "bid"])

    return mapped(groups, run, "gid long, bid long")


def _score(group: Pack, akeys: np.ndarray, low: np.ndarray, high: np.ndarray, block: Pack, same: bool, most: int) -> list[tuple[int, int, int, int]]:
    """(akey, window, vec_id, score): the first `most` rows of the block in each window of each anchor."""
    out = []
    inner = group.center @ block.center.T
    slack = group.length[:, None] * block.radius + group.radius[:, None] * (block.length + block.radius) + 1 + 1e-9 * np.abs(inner)
    exact = float(group.large) * block.large * group.rows.shape[1] < 2**53
    open_ = low <= high
    least = np.where(open_, low, _FAR).min(1)
    top = np.where(open_, high, -_FAR).max(1)
    for i in range(len(group.first) - 1):
        a, b = group.first[i], group.first[i + 1]
        leaves = np.flatnonzero((inner[i] + slack[i] >= least[a:b].min()) & (inner[i] - slack[i] <= top[a:b].max()))
        if not len(leaves):
            continue
        at = np.concatenate([np.arange(block.first[x], block.first[x + 1]) for x in leaves])
        scores = np.rint(group.wide[a:b] @ block.wide[at].T).astype(np.int64) if exact else group.rows[a:b].astype(np.int64) @ block.rows[at].astype(np.int64).T
        ids, labels = block.ids[at], block.labels[at]
        for k in range(a, b):
            own = scores[k - a]
            fit = (labels == group.labels[k]) & (ids != group.ids[k]) if same else labels != group.labels[k]
            fit = np.flatnonzero(fit & (own >= least[k]) & (own <= top[k]))
            fit = fit[np.lexsort((ids[fit], -own[fit]))]
            own, found = own[fit], ids[fit]
            for w in np.flatnonzero(open_[k]):
                begin = np.searchsorted(-own, -high[k, w], "left")
                end = min(begin + most, np.searchsorted(-own, -low[k, w], "right"))
                out += [(int(akeys[k]), int(w), int(x), int(s)) for x, s in zip(found[begin:end], own[begin:end], strict=True)]
    return out


def scored(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, same: bool, most: int) -> DataFrame:
    """(akey, w, id, score): the best rows of each pair of a group and a block."""
    left = groups.select(*(F.col(c).alias(f"g_{c}") for c in groups.columns))
    both = pairs.join(left, F.col("gid") == F.col("g_id")).join(blocks.drop("reach"), F.col("bid") == F.col("id")).drop("gid", "bid")

    def run(batches):
        last = (None, None)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if last[0] != row["id"]:
                    last = row["id"], Pack(row)
                group = {k[2:]: v for k, v in row.items() if k.startswith("g_")}
                own = Pack(group)
                out += _score(own, np.frombuffer(group["akeys"], np.int64), *_windows(group, len(own.ids)), last[1], same, most)
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["akey", "w", "id", "score"])

    found = mapped(both, run, "akey long, w long, id long, score long")
    first = F.row_number().over(W.partitionBy("akey", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", first).filter(F.col("rank") <= most)


class Search:
    """Both trees over a table's rows, ready to search."""

    def __init__(self, rows: DataFrame, every: int = EVERY):
        self.rows = written(prepared(rows), "negatives-rows")
        self.tree, self.d = fitted(self.rows)
        own = written(dealt(self.rows, self.tree, self.d), "negatives-cells")
        self.blocks, self.many = blocks_of(own, self.tree, self.d)
        depth = self.tree.depth
        nodes = self.blocks.select(F.shiftright("id", 24).alias("cell"), F.posexplode("reach").alias("level", "reach"))
        nodes = nodes.select(F.expr(f"shiftright(cell + {1 << depth}, {depth} - level)").alias("node"), "reach").groupBy("node").agg(F.max("reach").alias("reach"))
        self.radius = np.full(2 << depth, -1.0)
        for r in nodes.collect():  # the tree's nodes, 2 ** (DEEPEST + 1) at most
            self.radius[r.node] = r.reach
        anchors = own.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "label", "vector"])
        anchors = written(anchors.withColumn("akey", F.monotonically_increasing_id()), "negatives-anchors")
        up = min(depth, max(0, depth - int(np.ceil(np.log2(max(anchors.count(), 1) / GROUP)))))
        sizes = anchors.groupBy(F.shiftright("cell", up).alias("over")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("cut"))
        anchors = anchors.withColumn("over", F.shiftright("cell", up)).join(F.broadcast(sizes), "over")  # one row a node of the tree
        self.anchors = anchors.select((F.shiftleft("over", 24) + F.pmod("spread", "cut")).alias("gid"), "akey", "vec_id", "label", "vector")
        self.used = [self.rows, own, self.blocks]

    def best(self, windows: DataFrame, same: bool, most: int) -> DataFrame:
        """windows(akey, low, high: arrays of one length) to akey, w (place of the window), id, score and rank."""
        groups = written(groups_of(self.anchors.join(windows, "akey"), self.d), "negatives-groups")
        seen = scored(met(groups, self.tree, self.radius, self.many, True), groups, self.blocks, same, most)
        # where a window has enough rows already, others must be as good
        bound = seen.filter(F.col("rank") == most).groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").cast("int"), "score"))).alias("bound"))
        narrow = F.transform("low", lambda x, w: F.coalesce(F.element_at("bound", w), x))
        closer = windows.join(bound, "akey", "left").select("akey", F.when(F.col("bound").isNull(), F.col("low")).otherwise(narrow).alias("low"), "high")
        closer = written(groups_of(self.anchors.join(closer, "akey"), self.d), "negatives-groups")
        found = written(scored(met(closer, self.tree, self.radius, self.many, False), closer, self.blocks, same, most), "negatives-found")
        forget(groups, closer)
        return found

    def forget(self) -> None:
        forget(*self.used)


def hard_negatives(rows: DataFrame, every: int = EVERY) -> DataFrame:
    """rows(vec_id, embedding, label) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    search = Search(rows, every)
    anchors = search.anchors.select("akey", F.col("vec_id").alias("anchor_id"))
    everything = anchors.select("akey", F.array(F.lit(-_FAR)).alias("low"), F.array(F.lit(_FAR)).alias("high"))
    positives = search.best(everything, True, POSITIVES)
    # ceil(80 s / 100) and s
    least = F.ceil(F.col("score").cast("decimal(20,0)") * 80 / 100).cast("long")
    by_rank = F.array_sort(F.collect_list(F.struct("rank", least.alias("low"), F.col("score").alias("high"))))  # POSITIVES at most
    windows = positives.groupBy("akey").agg(by_rank.alias("x"))
    at = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda i: F.coalesce(F.get("x", i)[name], F.lit(none)))
    windows = windows.select("akey", at("low", _FAR).alias("low"), at("high", -_FAR).alias("high"))
    negatives = search.best(windows, False, NEGATIVES)
    own = positives.select("akey", (F.col("rank") - 1).cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("akey", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(own, ["akey", "w"]).join(anchors, "akey")
    search.forget()
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE label = own AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
