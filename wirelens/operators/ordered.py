"""Ordered computations over keys of any size.

A plain window function sends all rows of one key to one task. These helpers
split a key into consecutive buckets first: the window runs inside
``keys + bucket`` and a summary of one row per bucket supplies the value carried
in from the buckets before. A key holding a third of all rows is then spread
over as many tasks as it has buckets.

``bucket`` must not decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _attach(df: DataFrame, carry: DataFrame, on: list[str]) -> DataFrame:
    """Join the per-bucket carry back; null-safe on every key."""
    renamed = carry.select(*[F.col(c).alias(f"_c_{c}") for c in on],
                           *[c for c in carry.columns if c not in on])
    cond = None
    for c in on:
        test = df[c].eqNullSafe(renamed[f"_c_{c}"])
        cond = test if cond is None else cond & test
    return df.join(renamed, cond, "left").drop(*[f"_c_{c}" for c in on])


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
           columns: Sequence[str]) -> DataFrame:
    """Add ``prev_<column>`` from the row before in ``order``."""
    on = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    value = F.struct(*columns)
    inside = Window.partitionBy(*on).orderBy(*order)
    last = rows.groupBy(*on).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carry = last.select(*on, F.lag("_last").over(across).alias("_carry"))
    rows = rows.withColumn("_lag", F.lag(value).over(inside))
    joined = _attach(rows, carry, on)
    prev = F.coalesce(F.col("_lag"), F.col("_carry"))
    return joined.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
             name: str = "rank") -> DataFrame:
    """Add a 1-based row number in ``order``."""
    on = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*on).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        .select(*on, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    rows = rows.withColumn("_rn", F.row_number().over(inside))
    joined = _attach(rows, carry, on)
    return joined.select(*df.columns, (F.col("_rn") + F.col("_offset")).cast("bigint").alias(name))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Add the largest ``value`` among the rows before (or up to) each row."""
    on = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*on).agg(F.max("_value").alias("_top"))
        .select(*on, F.max("_top").over(before).alias("_carry"))
    )
    rows = rows.withColumn("_run", F.max("_value").over(inside))
    joined = _attach(rows, carry, on)
    # greatest() skips nulls, so an empty prefix stays null.
    return joined.select(*df.columns, F.greatest("_run", "_carry").alias(name))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                value: Column, name: str, total: str | None = None) -> DataFrame:
    """Add the sum of ``value`` up to and including each row, and per key as ``total``."""
    on = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*on).agg(F.sum("_value").alias("_part"))
        .select(*on, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"),
                F.sum("_part").over(Window.partitionBy(*keys)).alias("_total"))
    )
    rows = rows.withColumn("_run", F.sum("_value").over(inside))
    joined = _attach(rows, carry, on)
    extra = [F.col("_total").alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_run") + F.col("_offset")).alias(name), *extra)


def last_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
               value: str, name: str) -> DataFrame:
    """Add the last ``value`` that is not null up to and including each row, null before the first."""
    on = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter(F.col(value).isNotNull()).groupBy(*on).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    # Buckets without a value take the carry too, so every bucket has a summary row.
    last = rows.select(*on).distinct().join(last, on, "left")
    carry = last.select(*on, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    rows = rows.withColumn("_run", F.last(value, ignorenulls=True).over(inside))
    joined = _attach(rows, carry, on)
    return joined.select(*df.columns, F.coalesce("_run", "_carry").alias(name))
