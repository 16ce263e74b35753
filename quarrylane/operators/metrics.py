"""Percentiles by three definitions, and distances of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _at(rows: DataFrame, value: str, by: list[str], index: Column) -> DataFrame:
    """The value at a 0-based place of each group's order.

    Equal values are counted first, so what is ordered within a group is its
    distinct values only.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(value))
    placed = counted.withColumn("_end", upto).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    return placed.where((index >= F.col("_end") - F.col("_c")) & (index < F.col("_end"))).select(*by, F.col(value).alias("percentile"))


def nearest_rank(rows: DataFrame, value: str, by: list[str], p: float) -> DataFrame:
    """Place round((n - 1) p), halves to even."""
    return _at(rows, value, by, F.bround((F.col("n") - 1) * F.lit(p)).cast("long"))


def floor_index(rows: DataFrame, value: str, by: list[str], p: float) -> DataFrame:
    """Place floor((n - 1) p)."""
    return _at(rows, value, by, F.floor((F.col("n") - 1) * F.lit(p)).cast("long"))


def interpolated(rows: DataFrame, value: str, by: list[str], p: float) -> DataFrame:
    """Linear between neighbours."""
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(p)).alias("percentile"))


def js_divergence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(js_divergence, max_share_delta) of two relations' distributions over a key, in bits."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    totals = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    shares = both.crossJoin(F.broadcast(totals)).select((F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return shares.agg(
        (F.sum(part(F.col("p"))) / 2 + F.sum(part(F.col("q"))) / 2).alias("js_divergence"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_share_delta")
    )


def transition_ratios(cases: DataFrame, by: str, subgroup: str) -> DataFrame:
    """Transitions of each ``by`` with net improvement, ratio, rates and technical shares; a share of nothing is null."""
    n = lambda prefix: F.count_if(F.col(subgroup).startswith(prefix))
    counts = cases.groupBy(by).agg(
        F.count("*").alias("total"), n("T1").alias("repairs"), n("T2").alias("regressions"), n("T3").alias("persistent"), n("T4").alias("stable"), n("T1a").alias("t1a"), n("T2a").alias("t2a"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 9)
    return counts.select(
        by, "total", "repairs", "regressions", "persistent", "stable", (F.col("repairs") - F.col("regressions")).alias("net_improvement"),
        share("repairs", "regressions").alias("repair_to_regression_ratio"), share("repairs", "total").alias("repair_rate"), share("regressions", "total").alias("regression_rate"),
        share("persistent", "total").alias("persistent_rate"), share("stable", "total").alias("stable_rate"),
        share("t1a", "repairs").alias("technical_share_of_repairs"), share("t2a", "regressions").alias("technical_share_of_regressions"),
    )
