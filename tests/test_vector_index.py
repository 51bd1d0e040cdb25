"""Search by cells: the exact one equals the full scan on fewer pairs, the one over codes finds nine in ten."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.operators import vector_index as vi
from loglattice.operators.retrieval import ann_top_k, cosine_top_k

SCHEMA = "vec_id long, embedding array<float>, tier string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clustered(n, size=16, centres=40, spread=0.12, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, size))
    return [(i, (middle[rng.integers(0, centres)] + spread * rng.standard_normal(size)).tolist(), "abc"[i % 3]) for i in range(n)]


def as_queries(vectors, tier=False):
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding", *(["tier"] if tier else []))


def same(got, want):
    columns = sorted(want.columns)
    rows = [sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(columns).collect()), key=repr) for df in (got, want)]
    return rows[0] == rows[1] and len(rows[0]) > 0


@pytest.mark.parametrize("match", [None, "tier"])
def test_exact_search_equals_the_full_scan(spark, match):
    rows = clustered(600)
    rows += [(1000 + i, rows[5][1], "a") for i in range(40)]  # copies: ties by id
    rows += [(2000, None, "a"), (2001, [0.0] * 16, "a"), (2002, [0.0] * 16, "b"), (2003, rows[3][1], None)]
    vectors = frame(spark, rows)
    queries = as_queries(vectors, match).where("query_id % 7 = 0 OR query_id >= 1990")
    options = {"match": match} if match else {}
    assert same(vi.indexed_search(queries, vectors, 4, **options), cosine_top_k(queries, vectors, 4, **options))


def test_few_pairs_are_multiplied_on_clustered_vectors(spark):
    vectors = frame(spark, clustered(3000))
    queries = as_queries(vectors).where("query_id % 10 = 0")
    index = vi.build_index(vectors)
    asked = vi._asked(index, queries, "query_id", "embedding")
    first, _, rest = vi.exact_routes(index, asked, 3)
    pairs = sum(part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for part in (first, rest))
    assert pairs < 3000 * 300 / 3
    assert same(vi.indexed_top_k(index, queries, 3), cosine_top_k(queries, vectors, 3))
    # Rows of the index are the vectors, once.
    assert index.rows.count() == 3000


@pytest.mark.parametrize("spread", [0.12, 5.0])
def test_codes_find_nine_in_ten(spark, spread):
    """On clustered vectors, and on vectors without any structure."""
    vectors = frame(spark, clustered(1500, spread=spread) + [(5000, None, "a"), (5001, [0.0] * 16, "b")])
    queries = as_queries(vectors).where("query_id % 5 = 0 OR query_id >= 5000")
    got = vi.probed_search(queries, vectors, 3)
    want = cosine_top_k(queries, vectors, 3)
    pairs = {(r["query_id"], r["vec_id"]) for r in got.collect()}
    wanted = {(r["query_id"], r["vec_id"]) for r in want.where("query_id < 5000").collect()}
    assert len(pairs & wanted) >= 0.9 * len(wanted)
    assert got.select("query_id").distinct().count() == want.select("query_id").distinct().count()
    assert got.groupBy("query_id").count().where("count <> 3").count() == 0


def test_odd_tables(spark):
    rows = clustered(5)
    vectors, none = frame(spark, rows), frame(spark, rows).limit(0)
    zero = frame(spark, [(1, [0.0, 0.0], "a"), (2, [0.0, 0.0], "b")])
    for search in (vi.indexed_search, vi.probed_search):
        assert search(as_queries(vectors), none, 3).count() == 0
        assert search(as_queries(none), vectors, 3).count() == 0
        assert search(as_queries(vectors), vectors, 9).count() == 25
        assert search(as_queries(zero), zero, 3).agg(F.min("distance"), F.count("*")).collect() == [(1.0, 4)]


def test_null_vectors_do_not_fail_the_hashed_search(spark):
    vectors = frame(spark, clustered(30) + [(99, None, "a")])
    assert ann_top_k(as_queries(vectors), vectors, 1).select("query_id").distinct().count() == 30


def test_a_query_goes_to_no_more_blocks_as_a_table_grows(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 16)

    def candidates(n):
        vectors = frame(spark, clustered(n, spread=5.0))
        queries = as_queries(vectors)
        index = vi.build_index(vectors)
        asked = vi._asked(index, queries, "query_id", "embedding")
        return vi._looked(index, asked, vi._routes(index, asked), 1, coded=False).count()

    assert candidates(800) <= 2 * 9 * 800


def test_index_search_over_blocks_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vi, "BLOCK_BYTES", 30 * 16 * 8)  # 30 rows of 16 dimensions
    vectors = frame(spark, clustered(500))
    assert same(vi.indexed_search(as_queries(vectors), vectors, 3), cosine_top_k(as_queries(vectors), vectors, 3))
