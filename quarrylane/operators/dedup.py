"""Deduplication that depends on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.operators.lineage import settled


def first_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; nulls are a key value like any other."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, and every row without a key; those without one are not ranked."""
    keyed = rows.where(F.col(key).isNotNull())
    last = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return last.unionByName(rows.where(F.col(key).isNull()))


def greedy_sequential(rows: DataFrame, order: str, first: str, second: str) -> DataFrame:
    """Rows in order, each kept if no kept row before it has its first or its second key.

    A dropped row adds no key, so this is no window.  Rounds: a row that comes first
    in both its groups is kept; every row that shares a key with a kept one is gone;
    the rest go on.  Equal to the sequential scan, in few rounds.
    """
    left, kept = settled(rows), None
    while not left.isEmpty():
        firsts = left.withColumn("_a", F.min(order).over(Window.partitionBy(first))).withColumn("_b", F.min(order).over(Window.partitionBy(second)))
        taken = settled(firsts.where((F.col(order) == F.col("_a")) & (F.col(order) == F.col("_b"))).drop("_a", "_b"))
        kept = taken if kept is None else kept.unionByName(taken)
        for key in (first, second):
            left = left.join(taken.select(F.col(key).alias("_key")).distinct(), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        left = settled(left)
    return kept if kept is not None else rows.limit(0)
