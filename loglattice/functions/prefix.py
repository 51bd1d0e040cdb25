"""Running aggregates over any number of rows: no task ever holds a whole key, or all rows where there is no key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.session import scratch_path

#: Per kind: the aggregate, and how the total of what came before is merged with a row's own.
KINDS = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, own, before)),
    "xor": (F.bit_xor, lambda before, own: F.coalesce(before.bitwiseXOR(own), own, before)),
    "max": (F.max, F.greatest),
}


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder; later jobs read it, and rows keep the places they were given."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str | Column],
    values: dict[str, tuple[str, Column]],
    parts: int | None = None,
    part: str | None = None,
) -> DataFrame:
    """`rows` with a column per entry of `values`: the aggregate (kind, expression) of a row's key up to and with the row.

    Rows are dealt to `parts` ranges (shuffle partitions by default) of (keys, order) and summed up per range; the
    totals, one row per range and key, are shifted by one range and added to what each range runs up itself. So a hot
    key, or no key at all, is spread like any other rows. `order` should tell rows of a key apart: rows that tie
    are taken in any order. NULL keys are a key; NULL values are passed over by "sum", "xor" and "max" as by
    the aggregates. `part` names a column to keep a row's range under.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex[:8]
    own = part or f"part_{mark}"
    inputs = {name: f"value{i}_{mark}" for i, name in enumerate(values)}
    given = rows.select(*[F.col(f"`{c}`") for c in rows.columns], *[e.alias(inputs[n]) for n, (_, e) in values.items()])
    dealt = given.repartitionByRange(parts, *keys, *order) if keys or order else given
    dealt = stored(dealt.withColumn(own, F.spark_partition_id()), "running")

    totals = dealt.groupBy(own, *keys).agg(*[KINDS[kind][0](inputs[n]).alias(inputs[n]) for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col(own).alias(f"of_{mark}"),
        *[F.col(f"`{k}`").alias(f"key{i}_{mark}") for i, k in enumerate(keys)],
        *[KINDS[kind][0](inputs[n]).over(earlier).alias(f"before_{inputs[n]}") for n, (kind, _) in values.items()],
    )
    same = F.col(own) == F.col(f"of_{mark}")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"key{i}_{mark}"))
    upto = Window.partitionBy(own, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = [
        KINDS[kind][1](F.col(f"before_{inputs[n]}"), KINDS[kind][0](inputs[n]).over(upto)).alias(n)
        for n, (kind, _) in values.items()
    ]
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return dealt.join(before, same).select(*kept, *([own] if part else []), *merged)


def page_of(rows: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows `offset` to `offset + limit` in order, wherever in a large table that is.

    Rows are dealt to ranges of the order and counted per range (a number per partition reaches the driver). Only the
    ranges the page lies in are read and sorted, so no task gathers the rows before it.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = f"part_{uuid.uuid4().hex[:8]}"
    path = scratch_path(spark, "ranges")
    dealt = rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id())
    dealt.write.partitionBy(part).parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    counts = dict(dealt.groupBy(part).count().collect())
    before, first, wanted = 0, 0, []
    for p in sorted(counts):
        if before < offset + limit and before + counts[p] > offset:
            first = first if wanted else offset - before
            wanted.append(p)
        before += counts[p]
    page = dealt.where(F.col(part).isin(wanted)) if wanted else dealt.where(F.lit(False))
    return page.orderBy(*order).offset(first).limit(limit).drop(part)


def ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """`rows` with RANK() by one column, largest first, NULL last, over all rows.

    Rows are counted per value, counts run up over ranges of values, and a value's rank is joined back: ties share it, and
    nothing but a total per range ever meets in one task.
    """
    mark = uuid.uuid4().hex[:8]
    value, n, upto = f"value_{mark}", f"n_{mark}", f"upto_{mark}"
    per = rows.groupBy(F.col(f"`{by}`").alias(value)).agg(F.count(F.lit(1)).alias(n))
    ran = running(per, [], [F.col(value).desc_nulls_last()], {upto: ("sum", F.col(n))})
    ranks = ran.select(value, (F.col(upto) - F.col(n) + 1).cast("int").alias(name))
    return rows.join(ranks, F.col(f"`{by}`").eqNullSafe(F.col(value))).drop(value)
