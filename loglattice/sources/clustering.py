"""Writing by day in the order of a space-filling curve over two keys, in files of a chosen size.

Each key's values are cut at sampled rank bounds into cells of about equal weight; the cells' numbers, bit by bit in
turn, are a row's place on the curve. Rows near one another on it agree in both keys' leading bits, so a
file covers a small part of either key, and a filter on either one skips most files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running

#: Each key has 2^BITS cells at most.
BITS = 6
SAMPLE = 8192


def rank_bounds(df: DataFrame, column: str, cells: int, sample: int = SAMPLE) -> list:
    """Up to cells - 1 ascending values that cut a column's rows into parts of about equal size.

    From a sample of bounded size, taken by a hash of the value and a random number, so that hot values weigh what they weigh.
    """
    known = df.where(F.col(column).isNotNull()).select(column)
    drawn = known.orderBy(F.rand(17)).limit(sample)
    values = [r[0] for r in drawn.orderBy(column).collect()]
    return sorted({values[len(values) * i // cells] for i in range(1, cells)}) if values else []


def cell(column: str, bounds: list) -> Column:
    """How many bounds are at or below the value; NULL lies before all values."""
    if not bounds:
        return F.lit(0)
    at_or_below = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column))
    return F.coalesce(F.size(at_or_below), F.lit(0))


def curve(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of all cell numbers in turn, highest first, as one number."""
    place = F.lit(0).cast("long")
    for bit in range(bits):
        for k, c in enumerate(cells):
            one = F.getbit(c, F.lit(bit)).cast("long")
            place = place + F.shiftleft(one, bit * len(cells) + len(cells) - 1 - k)
    return place


def write_clustered(
    df: DataFrame,
    path: str,
    by: str = "date",
    cluster: Sequence[str] = ("recruiter_domain", "endpoint_path"),
    bytes_per_file: int = 256 << 20,
    mode: str = "overwrite",
    bits: int = BITS,
) -> int:
    """Write `df` by day, clustered by two or more keys alike; returns the number of ranges written.

    `bytes_per_file` counts a row's values as text, before encoding and compression. Sizes are summed up along (day,
    curve), and a file is cut wherever they pass a multiple of it (rows that are equal in all columns share one); so its size follows the data whatever the number of
    partitions, and a cell that is too large alone, as a hot key's, is several files. The order is that of ranges, not
    of a sort: each task sorts its own file only.
    """
    bounds = {c: rank_bounds(df, c, 1 << bits) for c in cluster}
    size = F.lit(0).cast("long")
    for c in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    # Rows of a cell are told apart by a hash of everything in them, in 4096 parts.
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(4096))
    marked = df.withColumns({"_curve": curve([cell(c, b) for c, b in bounds.items()], bits), "_size": size, "_part": part})
    cells = marked.groupBy(F.col(by).alias("_day"), F.col("_curve").alias("_at")).agg(F.sum("_size").alias("_bytes"))
    upto = running(cells, [], ["_day", "_at"], {"_upto": ("sum", F.col("_bytes"))})
    total = cells.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    files = int(total // bytes_per_file) + 1
    before = F.col("_upto") - F.col("_bytes") + F.col("_bytes") * F.col("_part") / 4096
    same = F.col(by).eqNullSafe(F.col("_day")) & (F.col("_curve") == F.col("_at"))
    placed = marked.join(upto, same).withColumn("_file", F.floor(before / bytes_per_file).cast("int"))
    order = [by, "_curve", *cluster]
    (
        placed.repartitionById(files, F.col("_file")).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in df.columns])
        .write.mode(mode).partitionBy(by).parquet(path)
    )
    return files
