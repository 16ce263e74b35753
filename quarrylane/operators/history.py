"""Training histories: upsert, smoothing, as-of, intervals, unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(value: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def upsert(rows: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """One row a key: the last non-null value of each column."""
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values])


def smoothed(rows: DataFrame, by: list[str], order: str, value: str, alpha: float) -> DataFrame:
    """(by, order, ema): the exponential moving average within each group, in one pass over its ordered values.

    A group is one run's history, which one task holds; missing values are left out.
    """
    import pandas as pd

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([order, value])
        return group[[*by, order]].assign(ema=group[value].ewm(alpha=alpha, adjust=False).mean())

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, order)) + ", ema double"
    return rows.select(*by, order, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()).groupBy(*by).applyInPandas(smooth, schema)


def merge_by_step(rows: DataFrame, posthoc: DataFrame, step: str) -> DataFrame:
    """``rows`` updated by the post-hoc row of their step: its columns replace those of the same name, others are added.

    A null of a post-hoc row leaves a value as it is; steps without one, or with a null, stay.
    """
    found = posthoc.select(F.col(step).alias("_step"), *[F.col(c).alias(f"_new_{c}") for c in posthoc.columns if c != step])
    joined = rows.join(found, F.col(step) == F.col("_step"), "left")
    new = [c for c in posthoc.columns if c not in rows.columns]
    kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in posthoc.columns and c != step else F.col(c) for c in rows.columns]
    return joined.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in new])


def last_at_or_before(points: DataFrame, events: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, order, value): for each event the last non-null value at or before it; one union and one window, no range join."""
    both = points.select(by, order, value, F.lit(0).alias("_side")).unionByName(
        events.select(by, order, F.lit(None).cast(dict(points.dtypes)[value]).alias(value), F.lit(1).alias("_side"))
    )
    found = F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order, "_side"))
    return both.withColumn("_found", found).where("_side = 1").select(by, order, F.col("_found").alias(value))


def intervals(points: DataFrame, ends: DataFrame, by: str, order: str) -> DataFrame:
    """``points`` with ``interval_end``: the first end at or after the point, null after the last."""
    both = points.select(by, order, F.lit(0).alias("_side"), F.lit(None).cast(dict(ends.dtypes)[order]).alias("_end")).unionByName(
        ends.select(by, order, F.lit(1).alias("_side"), F.col(order).alias("_end"))
    )
    following = Window.partitionBy(by).orderBy(order, "_side").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("interval_end", F.first("_end", ignorenulls=True).over(following)).where("_side = 0").drop("_side", "_end")


def long_rows(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """(ids, metric, value) without nulls."""
    return wide.unpivot(ids, metrics, "metric", "value").where("value IS NOT NULL")
