"""Order statistics from counts per value, range by range, so that no task holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """value, n, upto: each distinct value with its count and the count of all values up to it.  NULLs are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # Written once: the ranges must be the same where their totals and their rows are read.
    ranged = cut(counts.repartitionByRange("value").withColumn("_r", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = ranged.groupBy("_r").agg(F.sum("n").alias("held")).select("_r", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_r").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(starts, "_r").select("value", "n", (F.col("_start") + F.sum("n").over(inside)).alias("upto"))


def values_at(counts: DataFrame, positions: list[Column]) -> list[Column]:
    """Scalars: the values at 0-based positions of the sorted column that `counts` describes."""
    found = counts.agg(*[F.min(F.when(F.col("upto") > p, F.col("value"))).alias(f"v{i}") for i, p in enumerate(positions)])
    one = found.select(F.array(*found.columns)).scalar()
    return [F.get(one, F.lit(i)) for i in range(len(positions))]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[Column]:
    """Interpolated quantiles of a column as scalars; NULL for an empty column."""
    counts = running_counts(df, value)
    last = counts.agg(F.max("upto")).scalar() - 1
    exact = [s * last for s in shares]
    both = values_at(counts, [x for e in exact for x in (F.floor(e), F.ceil(e))])
    return [lo + (hi - lo) * (e - F.floor(e)) for e, lo, hi in zip(exact, both[::2], both[1::2], strict=True)]


def nearest_rank(df: DataFrame, value: str, share: float) -> Column:
    """The value at position round(share x (n - 1)), halves to even, as a scalar."""
    counts = running_counts(df, value)
    return values_at(counts, [F.bround(F.lit(share) * (counts.agg(F.max("upto")).scalar() - 1), 0)])[0]
