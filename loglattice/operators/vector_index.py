"""Search over vectors dealt to learned cells: exact with bounds, and approximate over short codes.

A model is fitted on a bounded sample of the unit vectors: cell centres by k-means, and for the codes a small k-means per
slice of the dimensions. Every vector then has a cell, its distance to the cell's centre, and a code of a byte per slice.

Exact search: of all vectors of a cell, those nearest and farthest from its centre bound, by the triangle
inequality, how near a query can come to any of them. A query looks into its nearest cells first; the k-th
distance found there rules out every cell whose bound lies beyond it.

Approximate search: a query looks into as many of its nearest cells as the sample needed for the wanted recall,
compares codes there, and measures the best of them exactly. Cells are put together to blocks of bounded size or cut into
several, so a cell with a third of the vectors is many blocks, and a query is sent to a block once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prefix import stored
from ..functions.vectors import block_candidates, unit_rows
from .retrieval import BLOCK_BYTES, BLOCK_ROWS, _named, _ranked

SAMPLE = 8192
CELLS = 256
SLICES = 16
#: Rounding of distances that are compared with bounds.
SLACK = 1e-6


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and the distance to it."""
    square = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T
    at = square.argmin(axis=1)
    return at, np.sqrt(np.maximum(square[np.arange(len(rows)), at], 0))


def k_means(rows: np.ndarray, n: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Up to n centres; a centre nothing is nearest to stays where it was."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]]
    for _ in range(rounds):
        at, _ = _nearest(rows, centres)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Model:
    """Cell centres (cells × dimensions) and, per slice of the dimensions, the rows its codes stand for."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    @staticmethod
    def fit(rows: np.ndarray, cells: int, slices: int, k: int, recall: float, seed: int = 5) -> Model:
        """From sampled unit rows. `probes` is how many cells the sample needed to find `recall` of its k nearest."""
        if not len(rows):
            return Model(rows, [np.zeros((1, rows.shape[1]))], 1)
        n = max(1, min(cells, int(np.sqrt(len(rows)))))
        centres = k_means(rows, n, seed)
        at, _ = _nearest(rows, centres)
        parts = np.array_split(np.arange(rows.shape[1]), min(slices, rows.shape[1]))
        books = [k_means(rows[:, p], min(256, len(rows)), seed + 1) for p in parts]
        # How deep in a query's order of cells its true neighbours lie, over a part of the sample.
        asked = rows[np.random.default_rng(seed).permutation(len(rows))[:256]]
        order = np.argsort(1 - asked @ centres.T, axis=1)
        place = np.argsort(order, axis=1)
        near = np.argsort(-(asked @ rows.T), axis=1)[:, 1 : k + 1]
        depth = np.sort(np.take_along_axis(place, at[near], axis=1).ravel()) if near.size else np.zeros(1)
        return Model(centres, books, int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        ends = np.cumsum([b.shape[1] for b in self.books])[:-1]
        return np.stack([_nearest(p, b)[0] for p, b in zip(np.split(rows, ends, axis=1), self.books)], axis=1).astype(np.uint8)

    def decoded(self, codes) -> np.ndarray:
        """The rows that codes stand for."""
        table = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, len(self.books))
        return np.concatenate([b[table[:, i]] for i, b in enumerate(self.books)], axis=1)


@dataclass(frozen=True)
class VectorIndex:
    """`rows`: (id, key, cell, radius, code, vector), a written table; `cells`: (key, cell, n, near, far) of those in use."""

    rows: DataFrame
    cells: DataFrame
    model: Model
    match: str | None
    vector_id: str


def build_index(
    vectors: DataFrame,
    match: str | None = None,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    recall: float = 0.97,
    sample: int = SAMPLE,
    cells: int = CELLS,
    slices: int = SLICES,
) -> VectorIndex:
    """Index all vectors but NULL ones and those without a `match` value. Each is stored once.

    The model sees `sample` vectors at most; `cells` and `slices` bound its size, `k` and `recall` say how deep the
    approximate search has to look. Zero vectors have a cell of their own, -1.
    """
    key = F.col(match) if match else F.lit("")
    given = vectors.select(
        F.col(vector_id).alias("id"), key.cast("string").alias("key"), F.col(vector).cast("array<double>").alias("vector")
    ).where("vector IS NOT NULL AND key IS NOT NULL")
    drawn = given.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()["vector"]
    units = unit_rows(drawn) if len(drawn) else np.zeros((0, 1))
    model = Model.fit(units[np.abs(units).sum(axis=1) > 0], cells, slices, k, recall)
    kind = T.StructType([*given.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType()), T.StructField("code", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows(batch.column(2).to_pylist())
            zero = ~rows.any(axis=1)
            # Without any centre all that were sampled are zero vectors; others there may be share cell 0.
            centres = model.centres if len(model.centres) else np.zeros((1, rows.shape[1]))
            at, radius = _nearest(rows, centres)
            at, radius, codes = np.where(zero, -1, at), np.where(zero, 0, radius), model.codes(rows)
            new = [pa.array(at, pa.int32()), pa.array(radius), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=kind.fieldNames())

    rows = stored(given.mapInArrow(place, kind), "vector-index")
    used = rows.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"))
    return VectorIndex(rows, stored(used, "vector-cells"), model, match, vector_id)


def _asked(index: VectorIndex, queries: DataFrame, query_id: str, vector: str) -> DataFrame:
    """Queries with their distance to every centre."""
    key = F.col(index.match).cast("string") if index.match else F.lit("")
    given = queries.select(F.col(query_id).alias("query"), key.alias("group"), F.col(vector).cast("array<double>").alias("vector"))
    given = given.where("vector IS NOT NULL AND group IS NOT NULL")
    learned = index.model.centres
    kind = T.StructType([*given.schema.fields, T.StructField("apart", T.ArrayType(T.DoubleType())), T.StructField("zero", T.BooleanType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit_rows(batch.column(2).to_pylist())
            centres = learned if len(learned) else np.zeros((1, rows.shape[1]))
            square = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T
            apart = np.sqrt(np.maximum(square, 0)).tolist()
            new = [pa.array(apart, pa.list_(pa.float64())), pa.array(~rows.any(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=kind.fieldNames())

    return stored(given.mapInArrow(measure, kind), "asked")


def _routes(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """A row per query and cell of its group: how far its centre is, the least distance of its vectors, its place."""
    apart = F.coalesce(F.get("apart", F.col("cell")), F.lit(2.0))
    met = asked.select("query", "group", "apart", "zero").join(index.cells.withColumnRenamed("key", "group"), "group")
    met = met.withColumn("centre", apart).drop("apart")
    least = F.greatest(F.lit(0.0), F.col("centre") - F.col("far"), F.col("near") - F.col("centre"))
    # Nothing is known of zero vectors: all other vectors are at distance 1 from them.
    met = met.withColumn("least", F.when((F.col("cell") < 0) | F.col("zero"), 0.0).otherwise(least))
    order = Window.partitionBy("query", "group").orderBy("centre", "cell")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumns({"place": F.row_number().over(order), "before": F.coalesce(before, F.lit(0))})


def _block_rows(index: VectorIndex, rows: Column) -> Column:
    """Rows of a block where there are `rows` in all: an eighth of them, but not less than `BLOCK_ROWS` and not
    more than `BLOCK_BYTES` hold in double precision."""
    size = sum(b.shape[1] for b in index.model.books)
    return F.greatest(F.lit(BLOCK_ROWS), F.least(F.ceil(rows / 8), F.lit(BLOCK_BYTES // (8 * max(1, size)))))


def _looked(
    index: VectorIndex, asked: DataFrame, routes: DataFrame, k: int, coded: bool, per_cell: int | None = None
) -> DataFrame:
    """The k best of each query in every block of the cells in `routes`, by codes or by the vectors themselves.

    Small cells share a block, a large one is several, and so are the queries of a block: a query goes once
    to a block, with the list of its cells there, and is multiplied with the vectors of those cells only. `per_cell`
    bounds what one cell gives a query, k by default.
    """
    per_cell = per_cell or k
    order = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    # A query or vector goes once to each block of the other side: blocks are as few as bytes and cores allow.
    rows = _block_rows(index, F.lit(index.cells.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()))
    placed = index.cells.withColumn("rows", rows).select(
        F.col("key").alias("group"), "cell", F.floor(before / F.col("rows")).alias("shard"),
        F.ceil(F.col("n") / F.col("rows")).cast("int").alias("parts"),
    )
    at = ["group", "shard"]
    wanted = routes.select("query", "group", "cell").join(placed, ["group", "cell"]).groupBy("query", *at).agg(
        F.collect_list("cell").alias("cells"), F.max("parts").alias("parts")
    )
    asking = F.count(F.lit(1))
    sets = wanted.groupBy(*at).agg(F.ceil(asking / _block_rows(index, asking)).cast("int").alias("sets"))
    keys = [*at, "part", "set"]
    q = wanted.join(sets, at).join(asked.select("query", "group", "vector"), ["query", "group"]).select(
        "query", "vector", "cells", *at, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("query"), F.col("sets")).cast("int").alias("set"),
    )
    v = index.rows.withColumnRenamed("key", "group").join(placed, ["group", "cell"]).join(
        sets.select(*[F.col(c).alias(c) for c in (*at, "sets")]), at
    ).select(
        "id", "cell", F.col("code" if coded else "vector").alias("vector"), *[F.col(c).alias(c) for c in at],
        F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("set"),
    )
    rows_of = index.model.decoded if coded else unit_rows

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        blocks = {}
        for cell, block in right.groupby("cell"):
            block = block.sort_values("id", kind="stable")
            blocks[cell] = block[["id", "vector"]], rows_of(block["vector"])
        kept = []
        for low in range(0, len(left), BLOCK_ROWS):  # what all cells give is held for so many queries at a time
            part = left.iloc[low : low + BLOCK_ROWS]
            units, at_cell = unit_rows(part["vector"]), np.repeat(np.arange(len(part)), part["cells"].map(len))
            cells, found = np.concatenate(part["cells"].to_list()), []
            for cell, (block, vectors) in blocks.items():
                asking = at_cell[cells == cell]
                if len(asking):
                    ids = part["query"].to_numpy()[asking]
                    found.append(block_candidates(ids, units[asking], block, per_cell, lambda _: vectors))
            if found:
                best = pd.concat(found).sort_values(["query", "distance", "id"])
                kept.append(best[best.groupby("query").cumcount() < k])
        return pd.concat(kept).assign(key=left["group"].iloc[0]) if kept else pd.DataFrame()

    schema = T.StructType([
        T.StructField("query", asked.schema["query"].dataType), T.StructField("key", T.StringType()),
        T.StructField("id", index.rows.schema["id"].dataType), T.StructField("distance", T.DoubleType()),
    ])
    return stored(q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(search, schema), "looked")


def exact_routes(index: VectorIndex, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first cells, what was found there, other cells that the bounds do not rule out) for every query."""
    routes = stored(_routes(index, asked), "routes")
    first = routes.where(F.col("before") < k)
    found = _looked(index, asked, first, k, coded=False)
    kth = _ranked(found, ["query", "key"], k).where(F.col("rank") == k)
    kth = kth.select("query", F.col("key").alias("group"), F.sqrt(2 * F.greatest("distance", F.lit(0.0))).alias("reach"))
    rest = routes.where(F.col("before") >= k).join(kth, ["query", "group"], "left")
    return first, found, rest.where(F.col("reach").isNull() | (F.col("least") <= F.col("reach") + SLACK))


def indexed_top_k(
    index: VectorIndex, queries: DataFrame, k: int = 3, query_id: str = "query_id", vector: str = "embedding"
) -> DataFrame:
    """The k vectors nearest to each query, exactly those of `cosine_top_k`, over the cells the bounds leave."""
    asked = _asked(index, queries, query_id, vector)
    _, found, rest = exact_routes(index, asked, k)
    found = found.union(_looked(index, asked, rest, k, coded=False))
    return _named(_ranked(found, ["query", "key"], k), index.match, query_id, index.vector_id)


def probed_top_k(
    index: VectorIndex,
    queries: DataFrame,
    k: int = 3,
    query_id: str = "query_id",
    vector: str = "embedding",
    probes: int | None = None,
    measured: int = 20,
) -> DataFrame:
    """About the k nearest: the best `measured` * k codes of the nearest cells, then measured exactly.

    A query looks into `probes` cells (as many as the sample needed, by default), and more while those hold fewer
    than `measured` * k vectors; so every query whose group has k vectors gets k. Of a cell's codes the best four times its even
    share are kept, k at least.
    """
    asked = _asked(index, queries, query_id, vector)
    routes = _routes(index, asked)
    probes, most = probes or index.model.probes, measured * k
    some = routes.where((F.col("place") <= probes) | (F.col("before") < most))
    per_cell = min(most, max(k, -(-4 * most // probes)))
    near = _ranked(_looked(index, asked, some, most, True, per_cell), ["query", "key"], most)
    pairs = near.select("query", "id", "key").join(
        index.rows.select("id", "key", F.col("vector").alias("_v")), ["id", "key"]
    ).join(asked.select("query", F.col("group").alias("key"), F.col("vector").alias("_q")), ["query", "key"])

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norms = F.sqrt(dot("_v", "_v")) * F.sqrt(dot("_q", "_q"))
    distance = F.coalesce(1 - F.try_divide(dot("_q", "_v"), norms), F.lit(1.0))
    exact = pairs.select("query", "key", "id", distance.alias("distance"))
    return _named(_ranked(exact, ["query", "key"], k), index.match, query_id, index.vector_id)


def indexed_search(queries: DataFrame, vectors: DataFrame, k: int = 3, match: str | None = None, query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """`cosine_top_k` by way of an index made for this one search."""
    index = build_index(vectors, match, vector_id, vector, **options)
    return indexed_top_k(index, queries, k, query_id, vector)


def probed_search(queries: DataFrame, vectors: DataFrame, k: int = 3, match: str | None = None, query_id: str = "query_id", vector_id: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """`probed_top_k` by way of an index made for this one search."""
    index = build_index(vectors, match, vector_id, vector, **options)
    return probed_top_k(index, queries, k, query_id, vector)
