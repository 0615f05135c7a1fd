"""Exact quantiles without one task that holds all values: ranks over counts of values, dealt by ranges that a sketch of the values bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the different values are dealt into, and the error of their bounds as a share of all.
RANGES, ERROR = 256, 0.001


def ranked_values(df: DataFrame, value: str) -> DataFrame:
    """value, n (rows that have it), first_rank (rows with a smaller one) and total, for each different value that is not null."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    bounds = sorted(set(counted.approxQuantile("value", [i / RANGES for i in range(1, RANGES)], ERROR)))  # of the values, so one far from the others moves none
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("value"))) if bounds else F.lit(0)
    placed = counted.select("value", "n", at.alias("at"))
    sums = placed.groupBy("at").agg(F.sum("n").alias("in_range"))  # RANGES rows at most
    sums = sums.select("at", (F.sum("in_range").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_range")).alias("base"), F.sum("in_range").over(Window.partitionBy()).alias("total"))
    before = F.sum("n").over(Window.partitionBy("at").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return placed.withColumn("before", before).join(F.broadcast(sums), "at").select("value", "n", (F.col("base") + F.col("before")).alias("first_rank"), "total")


def value_at(rank: Column) -> Column:
    """Aggregate over ranked_values(): the value at a rank counted from 0."""
    return F.max(F.when((F.col("first_rank") <= rank) & (rank < F.col("first_rank") + F.col("n")), F.col("value")))


def percentile_cont(p: float) -> Column:
    """Aggregate over ranked_values(): the continuous percentile."""
    at = (F.col("total") - 1) * F.lit(p)
    low, high = value_at(F.floor(at)), value_at(F.ceil(at))
    share = F.max(at - F.floor(at))
    return low + (high - low) * share


def nearest_rank(p: float) -> Column:
    """Aggregate over ranked_values(): the value at the rank nearest to p, halves to the even one."""
    return value_at(F.bround((F.col("total") - 1) * F.lit(p)))
