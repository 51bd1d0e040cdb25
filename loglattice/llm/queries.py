"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import hard_negatives, jaccard_join, mixing, packing, prefix_trie, quality_model
from loglattice.llm import quality_rules as rules
from loglattice.llm import suffix_dedup, token_counts, token_files, toxicity, vector_links, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_passages(docs, threshold=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken, about = mixing.mix(docs, F.array("source"), mixing.cycled)
    # One row per source.
    return taken.join(F.broadcast(about), F.get("sources", F.lit(0)).eqNullSafe(about["source"])).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.token_digests(token_files.read_tokens(manifest))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_links(docs, threshold=0.8).select("doc_id", "class_id", "n_links", "kept")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.read_packages(warc_zip.write_packages(table(spark, sf_dir, "pages")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces, _ = packing.pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op10_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.linked_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    taken = F.crc32(F.col("conv_id").cast("string")) % 9
    return prefix_trie.prefix_nodes(*prefix_trie.borrowed_starts(turns, base, taken, most=8))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").where(finite).select(
        "vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector")
    )
    return hard_negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_model": op6_quality_model,
    "op7_toxicity": op7_toxicity,
    "op8_warc_zip": op8_warc_zip,
    "op9_packing": op9_packing,
    "op10_vector_links": op10_vector_links,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
    "op13_hard_negatives": op13_hard_negatives,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
}
