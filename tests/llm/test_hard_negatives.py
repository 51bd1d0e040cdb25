"""Hard negatives against all pairs, and the tree's way of ruling leaves out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglattice.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<long>, rank string, anchor string"


def by_hand(rows, positives=5, negatives=5):
    rows = [(v, l, q) for v, l, q, *_ in rows if None not in (v, l, q) and None not in q]
    rows = [(n, v, l, q) for n, (v, l, q) in enumerate(rows)]
    out = []
    for n, a, label, q in rows:
        if a % 100:
            continue
        found = sorted(((-sum(x * y for x, y in zip(q, r)), v, m, l) for m, v, l, r in rows if m != n))
        for s, p, *_ in [f for f in found if f[3] == label][:positives]:
            fits = [f for f in found if f[3] != label and -80 * s <= -100 * f[0] <= -100 * s][:negatives]
            out += [(a, p, i, v, -s, -t) for i, (t, v, *_) in enumerate(fits, start=1)]
    return sorted(out, key=repr)


def clustered(n, size=12, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (6, size))
    rows = []
    for i in range(n):
        vector = np.floor(centres[rng.integers(0, 6)] + rng.normal(0, 4, size)).astype(int).tolist()
        rows.append((i * 10 if i % 3 else i, int(rng.integers(0, labels)), vector, "x", "y"))
    return rows


def odd_rows():
    rows = clustered(400)
    same = rows[100][2]
    rows += [(5000 + i, i % 3, same, "x", "y") for i in range(200)]  # a hot vector, all ties
    rows += [(200, 1, same, "x", "y"), (200, 1, same, "x", "y"), (300, None, same, "x", "y"), (None, 2, same, "x", "y")]
    rows += [(400, 1, None, "x", "y"), (500, 1, [1, None], "x", "y"), (600, 1, [], "x", "y"), (700, 2, [3, -4], "x", "y"), (800, 3, [0] * 12, "x", "y")]
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 20, "fan_out": 3}, {"leaf": 1, "fan_out": 2, "sample": 50}])
def test_negatives_of_odd_vectors(spark, rows, options, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 90)
    monkeypatch.setattr(hn, "ANCHORS", 7)
    frame = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    got = hn.mine_negatives(frame, F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows(got) == by_hand(odd_rows())
    assert len(by_hand(odd_rows())) > 100


def test_huge_components_stay_exact(spark, rows):
    big = [(i * 50, i % 2, [10**9 + i, -(10**9) + 7 * i, 3], "", "") for i in range(20)]
    frame = spark.createDataFrame(big, SCHEMA)
    assert rows(hn.mine_negatives(frame, F.col("vec_id") % 100 == 0, leaf=4, fan_out=2)) == by_hand(big)


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame(clustered(50), SCHEMA)
    assert hn.mine_negatives(some, F.lit(False)).count() == 0
    alone = spark.createDataFrame([(0, 1, [5, 5], "", "")], SCHEMA)
    assert hn.mine_negatives(alone, F.lit(True)).count() == 0


def test_the_tree_rules_leaves_out():
    """On clustered rows most leaves are never looked at, and no leaf with a row in the window is missed."""
    points = np.array([r[2] for r in clustered(2000)], dtype=float)
    longest = (points**2).sum(axis=1).max()
    tree = hn.Tree(points[:500], longest, 4, fan_out=4, leaf=100)
    leaves = tree.leaves_of(tree.lifted(points), learn=True)
    assert tree.n_leaves > 10
    anchors = points[::40]
    scores = anchors @ points.T
    low, high = np.sort(scores, axis=1)[:, -20, None].astype(np.int64), scores.max(axis=1)[:, None].astype(np.int64)
    least, most = hn._annuli(low, high, (anchors**2).sum(axis=1), longest)
    lifted = np.concatenate([anchors, np.zeros((len(anchors), 1))], axis=1)
    met = {(r, leaf) for leaf, on in tree.met_by(lifted, least, most) for r in on.tolist()}
    for r in range(len(anchors)):
        for leaf in set(leaves[(scores[r] >= low[r]) & (scores[r] <= high[r])].tolist()):
            assert (r, leaf) in met
    assert len(met) < 0.6 * len(anchors) * tree.n_leaves


def test_shorter_lists_end_in_zeros():
    assert hn._matrix(pa.array([[1, 2], [], [3]]), 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
