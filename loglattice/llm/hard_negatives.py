"""Hard negatives by a multiway hyperplane tree over all vectors (a geometric near-neighbour access tree).

A score is an integer inner product. With one more component, sqrt(m - |x|^2) for m the largest squared length,
all rows have equal length; an anchor's is 0 there, and its squared distance to a row is |a|^2 + m - 2 * score. So a window of
scores is an annulus around the anchor.

Inner nodes of the tree hold split points; a row goes to the nearest one, and for every pair of a split point and a
sibling subtree the node keeps the least and greatest distance of that subtree's rows to the point. An annulus rules a
subtree out as soon as one of its ranges, with the anchor's distance to the split point, cannot meet it.
Split points come from a bounded sample; ranges are taken over all rows; leaves are searched exactly.

Anchors search their own leaf first. The scores found there narrow their windows, which then rule out other leaves. Leaves
are dealt to blocks of bounded size, and so are the anchors; a task compares one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.llm.common import written

SAMPLE = 4096
FAN_OUT = 8
#: Rows of a leaf that is not split further, and of a block; anchors of a block.
LEAF = 2048
BLOCK = 2048
ANCHORS = 1024
#: No bound on a score.
FAR = 1 << 62


def _matrix(column: pa.ChunkedArray | pa.Array, size: int, kind=np.float64) -> np.ndarray:
    """Lists of whole numbers as rows of `size`; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == size).all():
        return flat.reshape(len(sizes), size)
    out = np.zeros((len(sizes), size), dtype=kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Tree:
    """Split points by node, and how near and far every subtree is from its siblings' split points."""

    def __init__(self, points: np.ndarray, longest: float, scale: float, fan_out: int = FAN_OUT, leaf: int = LEAF):
        """From sampled rows, each of which stands for `scale` rows."""
        self.longest, self.splits, self.children, self.n_leaves = longest, [], [], 0
        self._grow(self.lifted(points), scale, fan_out, leaf)
        shape = [(len(s), len(s)) for s in self.splits]
        self.near, self.far = [np.full(s, np.inf) for s in shape], [np.full(s, -np.inf) for s in shape]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the component that makes their lengths equal."""
        rest = np.sqrt(np.maximum(self.longest - np.einsum("ij,ij->i", rows, rows), 0))
        return np.concatenate([rows, rest[:, None]], axis=1)

    def _grow(self, points: np.ndarray, scale: float, fan_out: int, leaf: int) -> int:
        """The node's number; leaves have negative ones, -1 - leaf."""
        some = np.unique(points, axis=0) if len(points) * scale > leaf else points[:0]
        if len(some) < 2 * fan_out:
            self.n_leaves += 1
            return -self.n_leaves
        # Each next split point is the row farthest from those there are.
        chosen = [int(np.argmax(((some - some.mean(axis=0)) ** 2).sum(axis=1)))]
        apart = ((some - some[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < fan_out:
            chosen.append(int(np.argmax(apart)))
            apart = np.minimum(apart, ((some - some[chosen[-1]]) ** 2).sum(axis=1))
        node = len(self.splits)
        self.splits.append(some[chosen])
        self.children.append([])
        nearest = self.distances(node, points).argmin(axis=1)
        self.children[node] = [self._grow(points[nearest == j], scale, fan_out, leaf) for j in range(fan_out)]
        return node

    def distances(self, node: int, rows: np.ndarray) -> np.ndarray:
        splits = self.splits[node]
        square = (rows**2).sum(axis=1)[:, None] + (splits**2).sum(axis=1)[None] - 2 * rows @ splits.T
        return np.sqrt(np.maximum(square, 0))

    def leaves_of(self, rows: np.ndarray, learn: bool = False) -> np.ndarray:
        """The leaf of every lifted row; with `learn`, ranges are widened to hold these rows."""
        found = np.zeros(len(rows), dtype=np.int64)
        waiting = [(0 if self.splits else -1, np.arange(len(rows)))]
        while waiting:
            node, on = waiting.pop()
            if node < 0 or not len(on):
                found[on] = -1 - node
                continue
            apart = self.distances(node, rows[on])
            nearest = apart.argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                here = nearest == j
                if learn and here.any():
                    self.near[node][:, j] = np.minimum(self.near[node][:, j], apart[here].min(axis=0))
                    self.far[node][:, j] = np.maximum(self.far[node][:, j], apart[here].max(axis=0))
                waiting.append((child, on[here]))
        return found

    def met_by(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows one of whose annuli may meet it): row r has the annuli least[r, w] to most[r, w] around it."""
        # Distances of whole numbers, from squares that are exact but for their last digits.
        slack = 4e-6 * np.sqrt(self.longest + 1)
        waiting = [(0 if self.splits else -1, np.arange(len(rows)))]
        while waiting:
            node, on = waiting.pop()
            if not len(on):
                continue
            if node < 0:
                yield -1 - node, on
                continue
            apart = self.distances(node, rows[on])
            for j, child in enumerate(self.children[node]):
                near, far = self.near[node][:, j], self.far[node][:, j]
                between = np.maximum(np.maximum(apart - far, near - apart), 0).max(axis=1)
                beyond = (apart + far).min(axis=1)
                meets = (between[:, None] <= most[on] + slack) & (beyond[:, None] >= least[on] - slack) & (least[on] <= most[on])
                waiting.append((child, on[meets.any(axis=1)]))


def _annuli(lows: np.ndarray, highs: np.ndarray, square: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Windows of scores as distances; an empty window has a least above its most."""
    around = square[:, None] + longest
    least, most = (np.sqrt(np.maximum(around - 2 * s.astype(np.float64), 0)) for s in (highs, lows))
    return np.where(lows <= highs, least, np.inf), np.where(lows <= highs, most, -np.inf)


def _best(left: pa.Table, right: pa.Table, size: int, exact, k: int, same: bool) -> pa.Table:
    """The k best rows of a block for every anchor and window."""
    out = {"anchor": [], "w": [], "uid": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        right = right.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        uid, vec_id, label = (right.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        rows = _matrix(right.column("vector"), size, exact)
        anchors = _matrix(left.column("vector"), size, exact)
        own, labels = left.column("uid").to_numpy(), left.column("label").to_numpy()
        lows, highs = left.column("lows").to_pylist(), left.column("highs").to_pylist()
        for begin in range(0, len(left), 256):
            scores = anchors[begin : begin + 256] @ rows.T
            if exact is np.float64:
                scores = np.rint(scores).astype(np.int64)
            for r, found in enumerate(scores, start=begin):
                fits = (label == labels[r]) == same
                fits &= uid != own[r]
                for w, (low, high) in enumerate(zip(lows[r], highs[r])):
                    on = np.flatnonzero(fits & (found >= low) & (found <= high))
                    if len(on) > k:
                        kth = np.partition(found[on], len(on) - k)[len(on) - k]
                        above, level = on[found[on] > kth], on[found[on] == kth]
                        on = np.concatenate([above, level[: k - len(above)]])
                    out["anchor"] += [own[r]] * len(on)
                    out["w"] += [w] * len(on)
                    out["uid"] += uid[on].tolist()
                    out["vec_id"] += vec_id[on].tolist()
                    out["score"] += found[on].tolist()
    types = {"anchor": pa.int64(), "w": pa.int32(), "uid": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
    return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})


FOUND = "anchor long, w int, uid long, vec_id long, score long"


class Index:
    """Rows dealt to the leaves of a tree, as a written table, and the search among them."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fan_out: int = FAN_OUT, leaf: int = LEAF):
        """`rows`: (uid, vec_id, label, vector, anchor), all of them usable."""
        spark = rows.sparkSession
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        most = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
        about = rows.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size"), F.max(square).alias("longest"), F.max(most).alias("most")
        ).first()
        self.n, self.size = about["n"], about["size"] or 0
        self.exact = np.float64 if self.size * (about["most"] or 0) ** 2 < 1 << 53 else object
        picked = rows.orderBy(F.xxhash64("vec_id"), "uid").limit(sample).select("vector").toArrow()
        size, longest = self.size, about["longest"] or 0.0
        tree = Tree(_matrix(picked.column("vector"), size), longest, self.n / max(len(picked), 1), fan_out, leaf)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaves = tree.leaves_of(tree.lifted(_matrix(batch.column("vector"), size)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], names=[*batch.schema.names, "leaf"])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tree.leaves_of(tree.lifted(_matrix(batch.column("vector"), size)), learn=True)
            for node, (near, far) in enumerate(zip(tree.near, tree.far)):
                i, j = np.nonzero(near <= far)
                columns = [np.full(len(i), node), i, j, near[i, j], far[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "i", "j", "near", "far"])

        kind = "uid long, vec_id long, label long, vector array<long>, anchor boolean, leaf long"
        self.rows = written(rows.select("uid", "vec_id", "label", "vector", "anchor").mapInArrow(dealt, kind), "tree-leaves")
        kept = self.rows.mapInArrow(ranges, "node long, i long, j long, near double, far double")
        # As many rows as the tree has pairs of siblings, whatever the number of vectors.
        for r in kept.groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():
            tree.near[r["node"]][r["i"], r["j"]], tree.far[r["node"]][r["i"], r["j"]] = r["near"], r["far"]
        self.tree = tree

        held = {r["leaf"]: r for r in self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).collect()}
        sizes, before = [], 0
        for k in sorted(held):
            after = before + held[k]["anchors"]
            sizes.append((k, -(-held[k]["n"] // BLOCK), before // ANCHORS, after // ANCHORS - before // ANCHORS + 1))
            before = after
        self.sizes = spark.createDataFrame(sizes, "leaf long, blocks int, first int, groups int")
        in_block = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block")
        # A row per leaf: no more than the sample has rows.
        self.blocks = self.rows.join(F.broadcast(self.sizes), "leaf").select("uid", "vec_id", "label", "vector", "leaf", in_block)

    def anchors(self) -> DataFrame:
        """(uid, vec_id, label, vector, leaf, part): `part` is the anchor's block; neighbouring leaves share blocks."""
        part = (F.col("first") + F.pmod(F.xxhash64("uid"), F.col("groups"))).cast("int").alias("part")
        return self.rows.where("anchor").join(F.broadcast(self.sizes), "leaf").select("uid", "vec_id", "label", "vector", "leaf", part)

    def _compared(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """`routed`: anchors with `leaf`, where they look."""
        size, exact = self.size, self.exact
        routed = routed.join(F.broadcast(self.sizes.select("leaf", "blocks")), "leaf")
        routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        routed = written(routed, "routes")
        keys = ["leaf", "block", "part"]
        meets = routed.select(*[F.col(c).alias(c) for c in keys]).distinct()
        rows = self.blocks.join(meets, ["leaf", "block"]).select("uid", "vec_id", "label", "vector", *[F.col(c).alias(c) for c in keys])

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            return _best(left, right, size, exact, k, same)

        found = routed.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(best, FOUND)
        return written(found, "found")

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, w, uid, vec_id, score, rank) of the k best rows by score, then vec_id, of every anchor and window.

        `anchors` has `lows` and `highs`, arrays of whole scores, besides its own columns. Only rows of the same
        label count, or only those of others; an anchor never finds itself.
        """
        best = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "vec_id", "uid")
        own = self._compared(anchors, k, same)
        kth = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("anchor", "w", "score")
        kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        # A window with k rows is narrowed to what may still come before its last.
        raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("kth", w), low)))
        narrowed = anchors.join(kth.withColumnRenamed("anchor", "uid"), "uid", "left").withColumn("lows", raised).drop("kth")
        elsewhere = self._compared(self._routed(narrowed), k, same)
        found = own.union(elsewhere).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return written(found, "nearest")

    def _routed(self, anchors: DataFrame) -> DataFrame:
        """A row per anchor and other leaf that its windows do not rule out."""
        tree, size = self.tree, self.size

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column("vector"), size)
                square = np.einsum("ij,ij->i", rows, rows)
                rows = np.concatenate([rows, np.zeros((len(rows), 1))], axis=1)
                lows, highs = (batch.column(c).to_pylist() for c in ("lows", "highs"))
                n = max(map(len, lows), default=0)
                low, high = np.full((len(rows), n), FAR), np.full((len(rows), n), -FAR)
                for r, (a, b) in enumerate(zip(lows, highs)):
                    low[r, : len(a)], high[r, : len(b)] = a, b
                least, most = _annuli(low, high, square, tree.longest)
                met = [[] for _ in range(len(rows))]
                for leaf, on in tree.met_by(rows, least, most):
                    for r in on.tolist():
                        met[r].append(leaf)
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met, pa.list_(pa.int64()))], names=[*names, "met"])

        columns = ["uid", "label", "vector", "leaf", "part", "lows", "highs"]
        kind = "uid long, label long, vector array<long>, leaf long, part int, lows array<long>, highs array<long>, met array<long>"
        met = anchors.select(columns).mapInArrow(route, kind)
        met = met.withColumn("other", F.explode("met")).where("other <> leaf")
        return met.select("uid", "label", "vector", F.col("other").alias("leaf"), "part", "lows", "highs")


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    **index,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, vector, label).

    `vector` is an array of whole numbers, `label` a whole number; `is_anchor` picks the anchors. An anchor's positives are the
    `positives` best other rows of its label; for each of them, its negatives are the `negatives` best rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score. Better is a higher inner product, then a
    smaller vec_id. All, if there are fewer. A positive score below zero has no negatives where low <= high.

    Rows without vec_id, label or vector, or with a NULL component, take no part. A shorter vector counts as ending
    in zeros. Rows that share a vec_id are rows of their own: each is found, and each anchor row has its own results. Inner products must fit
    into a long. Other columns are not used. No rows, or no anchors, give no rows. `index`: sample, fan_out and leaf of `Index`.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<long>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    tree = Index(written(rows, "vectors"), **index)
    anchors = written(tree.anchors(), "anchors")
    one = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("lows", -FAR), ("highs", FAR))]
    found = tree.search(anchors.select("uid", "label", "vector", "leaf", "part", *one), positives, same=True)

    # Whole-number bounds of the window: the least score at or above its low end, the greatest at or below its high end.
    def bound(score: Column, percent: int, up: bool) -> Column:
        whole = score.cast("decimal(25,0)") * percent
        return ((F.ceil(whole / 100) if up else F.floor(whole / 100))).cast("long")

    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("found"))
    windows = windows.select(
        F.col("anchor").alias("uid"),
        F.transform("found", lambda x: bound(x["score"], low, True)).alias("lows"),
        F.transform("found", lambda x: bound(x["score"], high, False)).alias("highs"),
    )
    windows = anchors.join(windows, "uid").select("uid", "label", "vector", "leaf", "part", "lows", "highs")
    mined = tree.search(written(windows, "windows"), negatives, same=False)
    chosen = found.select("anchor", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        mined.select("anchor", "w", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(chosen, ["anchor", "w"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
