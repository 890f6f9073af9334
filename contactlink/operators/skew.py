"""Ranks and carried values inside groups that may be arbitrarily large.

A plain window puts a whole group into one task. Here a group is cut into slices of the
order column: a slice spans 2**bits values of a unique integer, hence at most that many
rows, whatever the group's size. Windows run inside slices; only one summary row per
slice is carried across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 20


def _sliced(df: DataFrame, order: str, bits: int) -> DataFrame:
    return df.withColumn("_slice", F.shiftright(F.col(order), bits))


def with_position(df: DataFrame, keys: list[str], order: str, bits: int = SLICE_BITS) -> DataFrame:
    """Add ``pos`` (0-based rank in the group by ``order``) and ``n`` (group size)."""
    sliced = _sliced(df, order, bits)
    parts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    parts = parts.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_rows").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order))
    ranked = sliced.withColumn("_rank", inside)
    return (
        ranked.join(parts, [*keys, "_slice"])
        .withColumn("pos", F.col("_before") + F.col("_rank") - 1)
        .drop("_slice", "_before", "_rank")
    )


def with_followers(df: DataFrame, keys: list[str], order: str, bits: int = SLICE_BITS) -> DataFrame:
    """Add ``n_later``, ``next_later`` and ``last_later``: the rows after this one in its group."""
    sliced = _sliced(df, order, bits)
    inside = Window.partitionBy(*keys, "_slice").orderBy(F.col(order).desc())
    later = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(order).alias("_first"), F.max(order).alias("_last")
    )
    parts = parts.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_rows").over(later), F.lit(0)).alias("_rows_later"),
        F.min("_first").over(later).alias("_next_slice"),
        F.max("_last").over(Window.partitionBy(*keys)).alias("_group_last"),
    )
    return (
        sliced.withColumn("_rank", F.row_number().over(inside))
        .withColumn("_lead", F.lag(order).over(inside))
        .join(parts, [*keys, "_slice"])
        .withColumn("n_later", F.col("_rank") - 1 + F.col("_rows_later"))
        .withColumn("next_later", F.coalesce("_lead", "_next_slice"))
        .withColumn("last_later", F.when(F.col("n_later") > 0, F.col("_group_last")))
        .drop("_slice", "_rank", "_lead", "_rows_later", "_next_slice", "_group_last")
    )


def with_last_before(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, bits: int = SLICE_BITS
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` among earlier rows of the group."""
    sliced = _sliced(df, order, bits)
    before = (Window.unboundedPreceding, -1)
    parts = sliced.groupBy(*keys, "_slice").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(*before)
    parts = parts.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(by_slice).alias("_carried"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(*before)
    return (
        sliced.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(parts, [*keys, "_slice"])
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_slice", "_inside", "_carried")
    )
