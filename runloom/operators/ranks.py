"""Global ranks and running totals without a one-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import scratch

SLICES = 64


def _slice(of: Column, bounds: list) -> Column:
    return reduce(lambda a, b: a + b, ((of >= F.lit(b)).cast("int") for b in bounds), F.lit(0))


def running(df: DataFrame, order: str, values: list[str], descending: bool = False) -> DataFrame:
    """df with `cum_x` for each x of values: the total over all rows at or before this one in order.

    Equal orders share one total. The numeric order column is cut at approximate quantiles into SLICES slices; totals run
    inside a slice, and the slices' own totals, at most SLICES + 1 rows, are added by a broadcast join. df is written once
    first, as quantiles and totals each read it.
    """
    df = scratch.table(df, "running")
    key = -F.col(order) if descending else F.col(order)
    df = df.withColumn("_k", key.cast("double"))
    bounds = df.agg(F.percentile_approx("_k", [i / SLICES for i in range(1, SLICES)], 1000)).first()[0] or []
    df = df.withColumn("_slice", _slice(F.col("_k"), sorted(set(bounds))))
    inside = Window.partitionBy("_slice").orderBy("_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy("_slice").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # over at most SLICES + 1 rows
    totals = totals.select("_slice", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    out = df.join(F.broadcast(totals), "_slice")
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(inside) + F.col(f"_o_{v}"))
    return out.drop("_k", "_slice", *[f"_o_{v}" for v in values])


def midranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the mid-rank of value over all rows (null where value is null)."""
    df = scratch.table(df, "ranked")
    counts = running(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, ["n"])
    ranks = counts.select(F.col(value).alias("_v"), (F.col("cum_n") - F.col("n") / 2 + 0.5).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def row_numbers(df: DataFrame, order: str, tie: str, out: str, descending: bool = False) -> DataFrame:
    """df with 1-based row numbers by order, ties by the unique column tie; null orders get no number."""
    df = scratch.table(df, "ranked")
    counts = running(df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count(F.lit(1)).alias("n")), order, ["n"], descending)
    counts = counts.select(F.col(order).alias("_v"), (F.col("cum_n") - F.col("n")).alias("_before"))
    inside = Window.partitionBy(order).orderBy(tie)
    return df.join(counts, F.col(order) == F.col("_v"), "left").withColumn(out, F.when(F.col(order).isNotNull(), F.col("_before") + F.row_number().over(inside))).drop("_v", "_before")
