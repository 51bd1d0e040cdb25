"""From raw documents to packed token sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as a table and read again
as the next one's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm.common import bucketed, written
from loglattice.llm.jaccard_join import jaccard_links
from loglattice.llm.mixing import cycled, mix
from loglattice.llm.packing import pack_tokens
from loglattice.llm.quality_model import quality_scores
from loglattice.llm.suffix_dedup import dedup_passages, readable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).where("predicted = 1").select(COLUMNS)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    return bucketed(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("uid")), "uid", name)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    rows = _numbered(docs, "pipeline-distinct")
    kept = jaccard_links(rows, threshold=0.8, uid="uid").where("kept").select("uid")
    return rows.join(kept, "uid", "left_semi").select(COLUMNS)


def fresh_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 200 bytes and more that also occur elsewhere."""
    cut = dedup_passages(docs.select(COLUMNS), threshold=200)
    return cut.withColumn("text", readable("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy the mix takes; every copy is whole."""
    rows = _numbered(docs, "pipeline-mix")
    taken, _ = mix(rows, F.array("source"), cycled, uid="uid", whole_copies=True)
    taken = written(taken.where("taken > 0").select("uid", "size", "taken"), "pipeline-taken")
    copies = F.sequence(F.lit(1), F.floor(F.col("taken") / F.col("size")).cast("int"))
    return rows.join(taken, "uid").withColumn("copy", F.explode(copies)).select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in sequences of 2048 tokens."""
    pieces, _ = pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "uid", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("suffix-array dedup", fresh_passages),
    ("mixing sources to target weights", mixed_documents),
    ("packing", packed_sequences),
]

#: SQL can train no classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-stage{k + 1}")
    return docs
