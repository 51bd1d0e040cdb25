"""Exploding arrays that are costly to make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(
    df: DataFrame, keep: Sequence[str | Column], items: str, position: str, value: str
) -> DataFrame:
    """One row per element of the array column `items`, with its position.

    The plain generator makes the optimizer put a filter for non-empty arrays
    below it, and that filter computes the whole array a second time. The outer
    one does not; the rows it adds for empty arrays are dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, value))
    return rows.where(F.col(position).isNotNull())
