"""A ledger of synced ids as bitmaps: one row of 4 KB for every 32 768 ids.

An id is a bit in the bitmap of its bucket, so marking an id twice is marking it once, ledgers merge by OR, and a
ledger of a thousand million ids has thirty thousand rows. The log meets it by bucket; an
id is then one bit to look at. NULL is no id: it is never in a ledger, as it never equals one in a plain list of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITMAP = "bucket", "bitmap"


def bitmap_ledger(ids: DataFrame, id_column: str = "query_id") -> DataFrame:
    """(bucket, bitmap) of the ids of a frame; repeated ids count once."""
    known = ids.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("_id"))
    return known.groupBy(F.bitmap_bucket_number("_id").alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias(BITMAP)
    )


def merged_ledger(ledger: DataFrame) -> DataFrame:
    """One row per bucket of any number of ledgers, united or appended to one another."""
    return ledger.groupBy(BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def ids_in_ledger(ledger: DataFrame) -> DataFrame:
    """How many ids a merged ledger holds."""
    return ledger.agg(F.coalesce(F.sum(F.bitmap_count(BITMAP)), F.lit(0)).alias("ids"))


def _bit(bitmap: Column, id_column: Column) -> Column:
    """Whether the id's bit is set."""
    at = F.bitmap_bit_position(id_column)
    # One byte as a Latin-1 character; its code point is the byte's value.
    byte = F.ascii(F.decode(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return F.getbit(byte, (at % 8).cast("int")) == 1


def _met(log: DataFrame, ledger: DataFrame, id_column: str, how: str) -> DataFrame:
    number = F.col(id_column).cast("long")
    other = merged_ledger(ledger).select(F.col(BUCKET).alias("_bucket"), F.col(BITMAP).alias("_bitmap"))
    same = (F.bitmap_bucket_number(number) == F.col("_bucket")) & _bit(F.col("_bitmap"), number)
    return log.join(other, same, how)


def unsynced_by_bitmap(log: DataFrame, ledger: DataFrame, limit: int = 10_000, id_column: str = "query_id") -> DataFrame:
    """The oldest rows whose id the bitmap ledger does not hold; as `sync.unsynced_batch` over a list of ids."""
    return _met(log, ledger, id_column, "left_anti").orderBy(id_column).limit(limit)


def new_rows(log: DataFrame, ledger: DataFrame, id_column: str = "query_id") -> DataFrame:
    """All rows whose id the ledger does not hold."""
    return _met(log, ledger, id_column, "left_anti")


def mark_synced_by_bitmap(log: DataFrame, ledger: DataFrame, id_column: str = "query_id") -> DataFrame:
    """The log with its synced flag (0/1) set from a bitmap ledger."""
    marked = _met(log, ledger, id_column, "left")
    return marked.select(*[F.col(f"`{c}`") for c in log.columns], F.col("_bucket").isNotNull().cast("int").alias("synced"))


def sync_status_by_bitmap(log: DataFrame, ledger: DataFrame, id_column: str = "query_id") -> DataFrame:
    """Total, synced and pending rows by a bitmap ledger."""
    marked = mark_synced_by_bitmap(log.select(id_column), ledger, id_column)
    total, synced = F.count(F.lit(1)), F.count_if(F.col("synced") == 1)
    return marked.agg(total.alias("total"), synced.alias("synced"), (total - synced).alias("pending"))
