"""JSON lines: appended records of weak matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import WEAK_MATCH
from ..session import path_exists


def write_jsonl(df: DataFrame, path: str) -> None:
    """Append one JSON object per row."""
    df.write.mode("append").json(path)


def read_jsonl_tolerant(
    spark: SparkSession, path: str, schema: T.StructType = WEAK_MATCH
) -> DataFrame:
    """All readable records; blank and corrupt lines are skipped and a path
    that does not exist holds no records.

    Lines are checked one by one, not by the reader's own mode, whose notion of
    a corrupt line depends on the columns a query happens to need.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
