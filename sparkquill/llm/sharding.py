"""Operator 3, sharding: Hilbert-curve ordering of metadata, cut into runs.

Several metadata dimensions are quantised at quantiles, rows are ordered by the curve index of
their cell, and the order is cut into runs whose row counts differ by one at most. Rows of a run
lie near each other in every dimension, so that files' minima and maxima prune on all of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Rows of one cell are dealt over so many parts, so that a hot cell is no single task.
PARTS = 1024
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def hilbert_table(dims: int, bits: int) -> list[int]:
    """Curve index of each cell; the first dimension has the highest bits of the cell's number."""
    out = []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - d) & (1 << bits) - 1 for d in range(dims)]
        q = 1 << bits - 1
        while q > 1:
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[d]) & q - 1
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t, q = 0, 1 << bits - 1
        while q > 1:
            t ^= q - 1 if x[-1] & q else 0
            q >>= 1
        x = [v ^ t for v in x]
        index = 0
        for b in reversed(range(bits)):
            for v in x:
                index = index << 1 | v >> b & 1
        out.append(index)
    return out


def levels(rows: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """For each dimension the level of a row, 0 to 2 ** bits - 1, by quantiles of the column.

    Numbers are compared with approximate quantiles. Whole strings (and any other type, as strings) are
    first counted; the values that hold the quantiles of the sorted counts are the bounds, so that
    strings with a long common beginning are told apart as well.
    """
    kinds, out, n = dict(rows.dtypes), [], 1 << bits
    numbers = [d for d in dims if kinds[d] in NUMBERS or kinds[d].startswith("decimal")]
    cuts = [i / n for i in range(1, n)]
    bounds = dict(zip(numbers, rows.agg(*(F.percentile_approx(F.col(d).cast("double"), cuts, 10000) for d in numbers)).first())) if numbers else {}
    for d in dims:
        column = F.col(d).cast("double") if d in numbers else F.col(d).cast("string")
        if d not in numbers:
            bounds[d] = string_bounds(rows.select(column.alias("v")), n)
        out.append(sum((F.coalesce((column > F.lit(b)).cast("int"), F.lit(0)) for b in bounds[d] or []), F.lit(0)))
    return out


def string_bounds(rows: DataFrame, n: int) -> list[str]:
    """At most n - 1 values of v, ascending: those that hold the quantiles. Values are range-partitioned and counted there; only n - 1 rows come to the driver."""
    counted = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("p", F.spark_partition_id())
    scratch = Scratch(rows.sparkSession)
    counted = scratch.stage(counted, "values")
    sums = counted.groupBy("p").agg(F.sum("n").alias("in_part"))
    before = sums.withColumn("base", F.sum("in_part").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_part")).withColumn("total", F.sum("in_part").over(Window.partitionBy()))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.join(F.broadcast(before), "p").withColumn("upto", upto).where(f"(upto - n) * {n} div total <> upto * {n} div total")
    out = sorted(r[0] for r in placed.select("v").collect())[: n - 1]
    scratch.drop("values")
    return out


def hilbert_shards(rows: DataFrame, key: str, dims: list[str], shards: int, bits: int = 4, out: tuple[str, str, str] = ("curve", "shard", "slot")) -> DataFrame:
    """rows with the columns curve, shard and slot.

    Shards 0 to shards - 1 have row counts that differ by one at most; slot numbers the rows of a
    shard without gaps from 0. Rows are ordered by curve index, a hash of the key, the key, then
    the other columns of dims. Nulls: a null dimension lies in the first quantile, a null key sorts
    first. Repeated rows each get a slot of their own. An empty table gives an empty table.
    Quantiles are read once, from all rows; columns of these names already there are replaced.
    """
    if len(dims) * bits > 14:
        raise ValueError("the curve's table has 2 ** 14 cells at most")
    cell = F.lit(0)
    for level in levels(rows, dims, bits):
        cell = cell * (1 << bits) + level
    table = F.from_json(F.lit(json.dumps(hilbert_table(len(dims), bits))), "array<int>")
    curve, shard, slot = out
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    # what is carried lies in one struct, so that no column of rows meets a name of ours
    placed = rows.select(F.struct(*(F.col(c) for c in rows.columns if c not in out)).alias("row"), F.get(table, cell).alias("curve"), part.alias("part"), F.struct(key, *(d for d in dims if d != key)).alias("tie"))
    sizes = placed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    # two levels: at most 2 ** 14 cells in one window, at most PARTS rows in each of the others
    cells = sizes.groupBy("curve").agg(F.sum("n").alias("in_cell"))
    cells = cells.select("curve", (F.sum("in_cell").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_cell")).alias("base"), F.sum("in_cell").over(Window.partitionBy()).alias("total"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("skip", F.sum("n").over(before) - F.col("n")).join(cells, "curve").select("curve", "part", (F.col("base") + F.col("skip")).alias("first"), "total")
    place = F.row_number().over(Window.partitionBy("curve", "part").orderBy("tie"))
    placed = placed.withColumn("nth", place).join(sizes, ["curve", "part"]).withColumn("at", F.col("first") + F.col("nth") - 1)
    placed = placed.withColumn("shard", F.expr(f"int(at * {shards} div total)"))
    return placed.select("row.*", F.col("curve").alias(curve), F.col("shard").alias(shard), F.expr(f"at - (shard * total + {shards - 1}) div {shards}").alias(slot))
