"""Hard negatives against all pairs, with ties, copies, odd rows and trees of several levels."""

import math
import random

import numpy as np
import pytest

from eventloom.llm import op11_negatives as op11

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell int"


def brute(rows, every=op11.EVERY):
    own = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for a in sorted({x for x in own if x[0] % every == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in own)
        positives = [(i, -s) for s, i, label in scores if label == a[1] and i != a[0]][:5]
        for p, ps in positives:
            fit = [(i, -s) for s, i, label in scores if label != a[1] and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a[0], p, r, n, ps, ns) for r, (n, ns) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(n, d, seed, copies=0):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = draw.choice(middle)
        v = [0.3 * x + draw.gauss(0, 0.15) for x in c] if i >= copies else [0.25] * d
        rows.append((i, v, draw.randint(0, 9 if i >= copies else 1), "clash", 1))
    return rows


ODD = [(None, [0.1] * 4, 1, None, None), (5000, None, 1, None, None), (5001, [0.5, None, 0.1, 0.2], 1, None, None), (5002, [float("nan")] * 4, 2, None, None), (5003, [float("inf"), 0.0, 0.0, 0.0], 2, None, None),
       (5004, [0.5] * 4, None, None, None), (5100, [], 3, None, None), (5200, [0.5, 0.5], 4, None, None), (5300, [0.4] * 4, 4, None, None), (5300, [0.4] * 4, 4, None, None), (5301, [0.4] * 4, 4, None, None), (-5400, [0.3] * 4, 1, None, None)]


@pytest.mark.parametrize(("n", "d", "copies"), [(900, 8, 0), (700, 3, 300), (400, 4, 0)])
def test_equals_all_pairs(spark, n, d, copies, monkeypatch):
    for name, value in (("BLOCK", 64), ("LEAF", 8), ("GROUP", 4), ("GROUP_LEAF", 2)):
        monkeypatch.setattr(op11, name, value)
    rows = rows_of(n, d, n, copies) + (ODD if d == 4 else [])
    got = sorted(tuple(r) for r in op11.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), 20).collect())
    assert got == brute(rows, 20)
    assert len(got) > 100


def test_intervals_hold_and_prune():
    draw = np.random.default_rng(2)
    rows = np.concatenate([draw.normal(c, 5, (200, 6)) for c in (-300, 0, 300)]).astype(np.int32)
    tree = op11.Tree(rows[::3], 3)
    cells = tree.cells(rows)
    for c in set(cells.tolist()):
        own = rows[cells == c]
        for up, far in zip(range(3, -1, -1), tree.reach(own, c), strict=True):
            assert np.linalg.norm(own - tree.center[(c + 8) >> up], axis=1).max() <= far + 1e-9
    assert len(set(cells.tolist())) == 8


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0], 1, None, None)], [(0, None, None, None, None)]])
def test_tables_without_a_result(spark, rows):
    assert op11.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_scores_beyond_doubles_stay_exact(spark):
    big = 2.0**18
    rows = [(i, [big + i / 8, big - i / 4, 1.0 + i], i % 2, None, None) for i in range(0, 60, 3)]
    got = sorted(tuple(r) for r in op11.hard_negatives(spark.createDataFrame(rows, SCHEMA), 6).collect())
    assert got == brute(rows, 6) != []
