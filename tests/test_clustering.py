"""Clustered writes: nothing lost, both keys skip files, sizes follow bytes."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loglattice.sources.clustering import cell, curve, rank_bounds, write_clustered


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30_000):
        domain = "hot.com" if rng.random() < 0.33 else f"d{rng.randrange(300):03d}.com"
        rows.append((i, "2024-01-01" if rng.random() < 0.9 else "2024-01-02", domain if i % 50 else None, f"/page/{rng.randrange(300):03d}"))
    frame = spark.createDataFrame(rows, "query_id long, day string, recruiter_domain string, endpoint_path string")
    return frame.withColumn("date", F.to_date("day")).drop("day").repartition(4).cache()


def groups(path):
    """Least and greatest value of both keys, per row group."""
    found = []
    for file in glob.glob(f"{path}/date=2024-01-01/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            found.append({k: (s.min, s.max) for k, s in stats.items() if k in ("recruiter_domain", "endpoint_path")})
    return found


def share(found, key, value):
    return sum(g[key][0] <= value <= g[key][1] for g in found) / len(found)


def test_either_key_skips_most_row_groups(spark, log, tmp_path):
    path = str(tmp_path / "log")
    n = write_clustered(log, path, bytes_per_file=12_000)
    assert n > 60
    read = spark.read.parquet(path).select(log.columns)
    assert read.count() == 30_000 and read.exceptAll(log).count() == 0
    found = groups(path)
    pages = [share(found, "endpoint_path", f"/page/{i:03d}") for i in range(0, 300, 20)]
    domains = [share(found, "recruiter_domain", f"d{i:03d}.com") for i in range(0, 300, 20)]
    assert sum(pages) / len(pages) < 0.35 and sum(domains) / len(domains) < 0.35


@pytest.mark.parametrize("partitions", ["2", "8", "40"])
def test_file_size_follows_bytes(spark, log, tmp_path, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        path = str(tmp_path / "log")
        n = write_clustered(log, path, bytes_per_file=60_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = glob.glob(f"{path}/date=*/*.parquet")
    assert n <= len(files) <= n + 2  # a file that crosses midnight is two
    rows = [pq.ParquetFile(f).metadata.num_rows for f in files]
    assert sum(rows) == 30_000 and max(rows) < 2 * 30_000 / n


def test_odd_tables(spark, log, tmp_path):
    assert write_clustered(log.limit(0), str(tmp_path / "none")) == 1
    alike = log.withColumn("recruiter_domain", F.lit(None).cast("string")).withColumn("endpoint_path", F.lit("/x"))
    assert write_clustered(alike, str(tmp_path / "alike"), bytes_per_file=80_000) > 5
    assert spark.read.parquet(str(tmp_path / "alike")).count() == 30_000


def test_cells_and_curve(spark):
    rows = spark.createDataFrame([(v,) for v in [None, "a", "b", "c", "z"]], "v string")
    assert [r[0] for r in rows.select(cell("v", ["b", "c"])).collect()] == [0, 0, 1, 2, 2]
    assert rank_bounds(rows.where("v IS NULL"), "v", 4) == []
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    got = {(r["a"], r["b"]): r["z"] for r in pairs.select("a", "b", curve([F.col("a"), F.col("b")], 2).alias("z")).collect()}
    assert sorted(got.values()) == list(range(16)) and got[3, 0] == 0b1010 and got[1, 2] == 0b0110
