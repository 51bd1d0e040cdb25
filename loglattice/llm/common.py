"""Helpers the operators share: scratch tables, row identity, links to components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this package: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
BLANK_BYTES = " \t\n\x0b\f\r"


@lru_cache(maxsize=None)
def _own_root(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="loglattice-llm-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which driver and executors share.

    Only a session on one machine may leave that unset; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_root(spark.conf.get("spark.app.id"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later jobs read it, lost executors lose none of it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """As `written`, dealt by `column`: later joins on it leave these rows where they are.

    There are as many buckets as shuffle partitions, one file each. The table is external, in the shared folder.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, column).write.bucketBy(parts, column).option("path", path)
    dealt.option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component) of every id in `links` (a, b): the smallest id that links reach.

    Each round, every id points at the smallest id among its neighbours' pointers, and pointers are
    followed one step; both are joins on ids, pre-aggregated by min. Links shrink to star edges, so a
    large component is never gathered. Rounds stop once nothing changes.
    """
    both = links.select("a", "b").where("a <> b")
    edges = written(
        both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges"
    )
    while True:
        # Large star: every larger neighbour of a node points at the node's smallest neighbour.
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = written(large, f"{name}-large")
        # Small star: smaller neighbours of a node, and the node itself, point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        small = written(small, f"{name}-small")
        if _same(edges, small):
            break
        edges = small
    roots = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _same(left: DataFrame, right: DataFrame) -> bool:
    """Two edge sets without repeats are equal: same count, same sum of hashes, as a cheap order-free test."""
    def mark(df: DataFrame):
        return df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x"),
        ).first()

    return mark(left) == mark(right)
