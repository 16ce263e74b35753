"""Paired statistics of runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963984540054


def mcnemar(n01: Column, n10: Column, without: float | None = 1.0) -> Column:
    """Exact two-sided McNemar probability; ``without`` is the value when no pair differs.

    The binomial tail is folded in logarithms of its terms' ratios, starting from the
    largest, so it does not underflow for many pairs.
    """
    n, low = n01 + n10, F.least(n01, n10)
    # The term at `low` relative to itself is 1; each step down multiplies by k / (n - k + 1).
    folded = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(low - 1, F.lit(0).cast("long"))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.when(
            i < low,
            F.struct(
                (acc["term"] * (low - i) / (n - low + i + 1)).alias("term"),
                (acc["total"] + acc["term"] * (low - i) / (n - low + i + 1)).alias("total"),
            ),
        ).otherwise(acc),
        lambda acc: acc["total"],
    )
    log_choose = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(low, F.lit(1).cast("long"))),
        F.lit(0.0),
        lambda acc, i: F.when(i <= low, acc + F.log((n - low + i).cast("double")) - F.log(i.cast("double"))).otherwise(acc),
    )
    tail = F.exp(log_choose + F.log(folded) - n * F.log(F.lit(2.0)))
    return F.when(n == 0, F.lit(without).cast("double")).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def holm(rows: DataFrame, p: str, family: list[str], ties: list[str]) -> DataFrame:
    """``rows`` with ``holm_p``: the running maximum of min(1, (m - rank) p) within each family."""
    order = Window.partitionBy(*family).orderBy(p, *ties)
    size = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_step", step).withColumn("holm_p", F.max("_step").over(order)).drop("_step")


def wilson(successes: Column, total: Column) -> Column:
    """Struct (low, high) of the Wilson interval."""
    p = successes / total
    denominator = 1 + Z * Z / total
    centre = (p + Z * Z / (2 * total)) / denominator
    radius = Z * F.sqrt(p * (1 - p) / total + Z * Z / (4 * total * total)) / denominator
    return F.struct((centre - radius).alias("low"), (centre + radius).alias("high"))


def paired(cases: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Counts, rates and the McNemar probability of paired 0/1 outcomes, by group."""
    x, y = F.col(a), F.col(b)
    sums = cases.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(x).cast("long").alias("a_correct"), F.sum(y).cast("long").alias("b_correct"),
        F.count_if((x == 1) & (y == 1)).alias("both_correct"), F.count_if((x == 0) & (y == 0)).alias("both_wrong"),
        F.count_if((x == 0) & (y == 1)).alias("n01"), F.count_if((x == 1) & (y == 0)).alias("n10"),
    )
    delta = (F.col("b_correct") - F.col("a_correct")) / F.col("n")
    return sums.withColumns(
        {
            "delta": delta,
            "relative_error_reduction": F.when(F.col("a_correct") < F.col("n"), delta / (1 - F.col("a_correct") / F.col("n"))),
            "mcnemar_p": mcnemar(F.col("n01"), F.col("n10")),
        }
    )


def resampled_means(values: DataFrame, value: str, position: str, by: list[str], replicates: int) -> DataFrame:
    """(group, replicate, mean): resamples whose draws are hashes of (replicate, draw), so every engine draws alike.

    Positions are 0 .. n-1 within the group.  Replicates are dealt out as rows, each
    draw is one equi-join, and means are aggregated before their shuffle.
    """
    sizes = values.groupBy(*by).agg(F.count("*").cast("long").alias("size"))
    draws = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draws = draws.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    digest = F.md5(F.concat_ws("|", F.col("replicate").cast("string"), F.col("draw").cast("string")))
    chosen = F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.col("size"))
    drawn = draws.select(*by, "replicate", chosen.alias(position))
    return drawn.join(values, [*by, position]).groupBy(*by, "replicate").agg(F.avg(value).alias("mean"))


def did_interval(by: str, replicates: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """95 % percentile interval of a difference in differences, from one group's (by, treated, diff, n) counts.

    Both arms are resampled on their own; replicates are multinomial counts of the distinct
    differences.  A group with one arm has no interval.  The group's name is the seed.
    """

    def interval(group: pd.DataFrame) -> pd.DataFrame:
        name = group[by].iloc[0]
        random = np.random.default_rng(int.from_bytes(hashlib.sha256(f"did|{name}".encode()).digest()[:8], "little"))

        def means(treated: bool) -> np.ndarray:
            arm = group[group["treated"] == treated].sort_values("diff")
            n, diff = arm["n"].to_numpy(), arm["diff"].to_numpy()
            return np.concatenate([random.multinomial(n.sum(), n / n.sum(), min(250, replicates - a)) @ diff for a in range(0, replicates, 250)]) / n.sum()

        if group["treated"].nunique() < 2:
            return pd.DataFrame({by: [name], "ci_low": [None], "ci_high": [None]})
        low, high = np.quantile(means(True) - means(False), [0.025, 0.975])
        return pd.DataFrame({by: [name], "ci_low": [low], "ci_high": [high]})

    return interval


def bootstrap_interval(replicates: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """95 % percentile interval of the mean of one group's (lang, diff, n) counts.

    Drawing n rows with replacement gives each distinct value a multinomial count, so
    whole replicates are drawn without their rows.  The group's name is the seed.
    """

    def interval(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("diff")
        name, n = group["lang"].iloc[0], group["n"].to_numpy()
        random = np.random.default_rng(int.from_bytes(hashlib.sha256(str(name).encode()).digest()[:8], "little"))
        means = np.concatenate([random.multinomial(n.sum(), n / n.sum(), min(250, replicates - a)) @ group["diff"].to_numpy() for a in range(0, replicates, 250)]) / n.sum()
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"lang": [name], "ci_low": [low], "ci_high": [high]})

    return interval
