"""Text files, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_corpus(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Path, name, stem and whole text of every matching file; bytes that are
    not UTF-8 become the replacement character."""
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
    )
    name = F.col("_metadata.file_name")
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.url_decode(name).alias("filename"),
        F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("stem"),
        F.make_valid_utf8(F.col("value")).alias("text"),
    )
