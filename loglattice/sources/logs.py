"""Reading and writing request logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HISTORIC_LOG, LIVE_LOG


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """The live log as the service writes it."""
    return spark.read.schema(LIVE_LOG).parquet(path)


def write_csv_log(df: DataFrame, path: str) -> None:
    """Header and rows; NULL becomes an empty field."""
    df.write.option("header", True).option("nullValue", "").option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ).csv(path)


def read_csv_log(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV log with a header. Types are detected, or fixed with `infer=False`,
    which saves a pass over the files.

    A time stamp that was read as text, or as a zone-less one, becomes a
    timestamp; text that is no time becomes NULL.
    """
    reader = spark.read.option("header", True).option("nullValue", "")
    if not infer:
        return reader.schema(HISTORIC_LOG).option(
            "timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
        ).csv(path)
    rows = reader.option("inferSchema", True).csv(path)
    if isinstance(rows.schema["timestamp"].dataType, T.StringType):
        return rows.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def historic_to_log(historic: DataFrame) -> DataFrame:
    """Give the historic log the column names the reports use."""
    return historic.withColumnsRenamed(
        {
            "timestamp": "request_timestamp",
            "endpoint_hit": "endpoint_path",
            "http_status": "http_status_code",
        }
    ).withColumn("date", F.to_date("request_timestamp"))


def write_partitioned(
    df: DataFrame,
    path: str,
    by: str = "date",
    cluster: Sequence[str] = ("recruiter_domain", "endpoint_path"),
    tie: str = "query_id",
    mode: str = "overwrite",
    files: int | None = None,
    rows_per_file: int = 5_000_000,
) -> None:
    """Write by day, clustered by the given keys.

    Rows are range-partitioned on (day, cluster keys, id) into `files` ranges (the
    shuffle partitions, unless given), so a hot day or a hot domain spreads over
    several files and each file covers a narrow key range that row-group
    statistics can skip. A file is closed after `rows_per_file` rows.
    """
    order = [by, *cluster]
    ranged = df.repartitionByRange(*([files] if files else []), *order, tie)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(by)
        .parquet(path)
    )


def replicate_rows(df: DataFrame, n: int = 10, id_column: str = "query_id") -> DataFrame:
    """Every row n times under fresh ids.

    Ids are `id * n + copy`: unique if the ids were, and made without the
    global ordering that a row number over the whole table needs.
    """
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return copies.withColumn(id_column, F.col(id_column) * n + F.col("_copy")).drop("_copy")


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result
