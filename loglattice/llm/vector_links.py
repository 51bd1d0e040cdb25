"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors of a label are normalised and projected on many fixed random directions. Two vectors collide in a
projection if one lies in the other's window, the stretch of `reach` on both sides of its value. Pairs
that collide often enough are verified by their cosine in double precision.

For two unit vectors at distance t, a projection's difference is normal with deviation t / sqrt(d), near
enough, so collisions are binomial; the window and the least count follow from the wanted recall at
the threshold's distance (`calibrate`), whatever the data.

A label's vectors are dealt to blocks of bounded size by hash, and each pair of blocks is one task's
work: the right side is sorted by each projection, a window is two places in that order, and counts are
kept for the pairs of the two blocks only. Links are given as counts and star edges, never as one row per
pair. The work grows with the square of a label's vectors: one projection's window holds a fair part of
them at this threshold, so no projection alone can rule out blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import components, written

PROJECTIONS = 48
BLOCK = 512


def calibrate(threshold: float, projections: int, recall: float, spread: float = 1.0) -> tuple[float, int]:
    """(reach, least): at the distance of cosine `threshold`, a pair collides at least `least` times with `recall`.

    `reach` is in units of 1 / sqrt(dimensions), `spread` deviations wide; pairs closer than the threshold collide more often.
    """
    distance = math.sqrt(max(2 - 2 * threshold, 1e-12))
    reach = spread * distance
    p = math.erf(spread / math.sqrt(2))
    tail, least = 0.0, 0
    for k in range(projections + 1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail > 1 - recall:
            least = k
            break
    return reach, least


def directions(dimensions: int, projections: int, seed: int) -> np.ndarray:
    """Random unit directions; in groups of `dimensions` they are orthogonal, which evens out the counts."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-projections // dimensions))]
    return np.concatenate(parts, axis=1)[:, :projections]


def _collisions(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """How many projections put a's value into b's window, for all pairs (row of b, row of a)."""
    counts = np.zeros((len(b), len(a)), dtype=np.uint16)
    columns = np.arange(len(a))
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        values = b[order, k]
        # Each window as a step up and a step down along the sorted side, summed up to the window itself.
        steps = np.zeros((len(b) + 1, len(a)), dtype=np.int8)
        steps[np.searchsorted(values, a[:, k] - reach, "left"), columns] += 1
        steps[np.searchsorted(values, a[:, k] + reach, "right"), columns] -= 1
        counts[order] += np.cumsum(steps[:-1], axis=0, dtype=np.int8).view(np.uint8)
    return counts


def _verified(threshold: float, reach: float, least: int, axes: np.ndarray):
    def links(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = keys[1], keys[2]
        unit = np.array(rows["v"].to_list(), dtype=np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)  # first, so that no norm overflows or vanishes
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        ids, block = rows["vec_id"].to_numpy(), rows["block"].to_numpy()
        i, j = np.flatnonzero(block == left), np.flatnonzero(block == right)
        seen = np.asarray(unit @ axes)
        often = _collisions(seen[j], seen[i], reach) >= least
        if left == right:
            often &= np.arange(len(i))[:, None] < np.arange(len(j))[None, :]
        x, y = np.nonzero(often)
        cosine = np.empty(len(x))
        for k in range(0, len(x), 1 << 16):
            some = slice(k, k + (1 << 16))
            cosine[some] = np.einsum("ij,ij->i", unit[i[x[some]]], unit[j[y[some]]])
        near = cosine >= threshold
        x, y = i[x[near]], j[y[near]]
        n = np.bincount(np.concatenate([x, y]), minlength=len(ids))
        # Star edges: every linked vector to the smallest id it reaches within this pair of blocks.
        root = ids.copy()
        while len(x):
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            if (root == before).all():
                break
        on = np.flatnonzero(n)
        return pd.DataFrame({"vec_id": ids[on], "n": n[on], "root": root[on]})

    return links


def linked_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    projections: int = PROJECTIONS,
    recall: float = 0.9999,
    spread: float = 1.0,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label).

    Links join vectors of equal labels and equal lengths whose cosine is at least `threshold`. A vector that is NULL,
    zero, or holds a NULL or a non-finite component has no links, nor has one whose label or vec_id is NULL; without a
    vec_id, component_id and kept are NULL too. Rows that share a vec_id are one vector each, and their links add up
    under that id. Other columns are not used. No rows give no rows.
    """
    reach, least = calibrate(threshold, projections, recall, spread)
    usable = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    clean = written(
        vectors.select(
            F.monotonically_increasing_id().alias("uid"),
            "vec_id",
            F.col("embedding").alias("v"),
            F.size("embedding").alias("size"),
            F.concat_ws(":", F.size("embedding").cast("string"), F.col("label").cast("string")).alias("group"),
            usable.alias("usable"),
        ).where("usable"),
        "usable-vectors",
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    counts = clean.groupBy("group").agg(F.count(F.lit(1)).alias("n")).select("group", blocks.alias("blocks"))
    dealt = clean.join(counts, "group").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", "size", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "vec_id", "block", "v"
    )
    sizes = [r["size"] for r in clean.select("size").distinct().collect()]
    pairs = None
    for size in sizes:
        scaled = reach / math.sqrt(size)
        work = _verified(threshold, scaled, least, directions(size, projections, seed))
        some = dealt.where(F.col("size") == size)
        found = some.groupBy("group", "left", "right").applyInPandas(work, "vec_id long, n long, root long")
        pairs = found if pairs is None else pairs.union(found)
    rows = vectors.select("vec_id")
    if pairs is None:
        zero = F.lit(0).cast("long")
        return rows.select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pairs = written(pairs, "vector-links")
    counts = pairs.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    groups = components(pairs.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vector-links")
    component = F.coalesce("component", "vec_id")
    return (
        rows.join(counts, "vec_id", "left")
        .join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            (F.col("vec_id") == component).alias("kept"),
        )
    )
