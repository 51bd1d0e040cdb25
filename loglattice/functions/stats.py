"""Aggregates that give the same answer however the rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def percent(part: Column, whole: Column, digits: int) -> Column:
    """`part / whole` in percent; NULL, not an error, when whole is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def mean(value: Column, digits: int = 2) -> Column:
    """Rounded average; NULLs do not count, a NaN makes it NaN."""
    return _rounded(F.avg(value), digits)


def mean_of(total: Column, n: Column, digits: int = 2) -> Column:
    """Rounded average from a sum and the number of values in it."""
    return _rounded(F.try_divide(total.cast("double"), n.cast("double")), digits)


def _rounded(ratio: Column, digits: int) -> Column:
    """Rounded half up. Sums of doubles differ in their last digits with the order of rows;
    rounding those away first keeps them from flipping a tie."""
    return F.round(F.round(ratio, digits + 7), digits)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (`_n`) per key and value, NULL included. It combines on the map
    side, so a key that holds a third of the log is never sorted whole."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact discrete quantiles from `value_counts`: one row per key, one column
    per prob.

    The smallest value whose cumulative share reaches p, NULLs ignored. Running
    totals are taken over whole units of the value; only the unit that holds a
    quantile is looked at value by value. Both passes, and whatever else is
    computed from the same counts, read one shuffle: no predicate on the value
    is used that could be pushed below it and make the plans differ. Without a
    key the running totals are taken over ranges of units, see `prefix.running`.
    """
    keys = list(keys)
    known = F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
    number = F.col(value).cast("double")
    # NULLs apart, NaN after all numbers; units beyond a long's range share the outermost ones
    unit = (
        F.when(number.isNull(), F.lit(-(2**62)))
        .when(F.isnan(number), F.lit(2**62))
        .otherwise(F.floor(F.greatest(F.lit(-1e18), F.least(F.lit(1e18), number))))
    )
    counts = counts.withColumn("_unit", unit).withColumn("_known", known)
    units = counts.groupBy(*keys, "_unit").agg(F.sum("_known").alias("_n"))
    per_key = Window.partitionBy(*keys)
    upto_here = (Window.unboundedPreceding, Window.currentRow)
    so_far = per_key.orderBy("_unit").rowsBetween(*upto_here)
    targets = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(p))).alias("rank"),
            )
            for name, p in probs.items()
        ]
    )
    below = F.col("_upto") - F.col("_n")
    if keys:
        totals = units.withColumn("_upto", F.sum("_n").over(so_far)).withColumn("_total", F.sum("_n").over(per_key))
    else:
        ran = running(units, [], ["_unit"], {"_upto": ("sum", F.col("_n"))})
        totals = ran.withColumn("_total", units.agg(F.sum("_n")).scalar())
    hits = (
        totals.withColumn("_t", F.explode(targets))
        .where((F.col("_t.rank") <= F.col("_upto")) & (F.col("_t.rank") > below))
        .select(
            *[F.col(k).alias(f"_h_{k}") for k in keys],
            F.col("_unit").alias("_h_unit"),
            F.col("_t.name").alias("_name"),
            (F.col("_t.rank") - below).alias("_rest"),
        )
    )
    same = [F.col("_unit") == F.col("_h_unit")]
    same += [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    inside = Window.partitionBy(*keys, "_name").orderBy(value).rowsBetween(*upto_here)
    picked = (
        counts.join(hits, same)
        .withColumn("_upto", F.sum("_known").over(inside))
        .where(F.col("_upto") >= F.col("_rest"))
    )
    return picked.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_name") == n, F.col(value))).alias(n) for n in probs]
    )


def approx_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Quantiles of the rows from one mergeable sketch per key; rank error
    1/accuracy."""
    sketch = F.percentile_approx(value, list(probs.values()), accuracy)
    return df.groupBy(*keys).agg(sketch.alias("_q")).select(
        *keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(probs)]
    )
