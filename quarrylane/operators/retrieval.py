"""Exact vector top-k in blocks, filters, reranking and the similarity gate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bounds of one cell of pool rows and queries.
POOL_ROWS = 50_000
QUERY_ROWS = 5_000


def scored_pairs(queries: DataFrame, pool: DataFrame, k: int, same_id: bool = False) -> DataFrame:
    """(query_id, id, score): each query's best candidates of every cell, by inner product.

    ``queries`` and ``pool`` have ``id``, ``group`` (a string) and ``vector``.  A candidate never has the
    query's own id unless ``same_id``.  Queries and pool rows meet in cells of bounded
    size, multiplied as matrices; scores are rounded to 9 digits, so that equal vectors
    tie whatever the order of summation, and ties go to smaller ids.
    """
    counts = pool.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    rows, blocks = (max(1, -(-n // most)) for n, most in zip(counts, (POOL_ROWS, QUERY_ROWS)))
    rows = max(rows, min(pool.sparkSession.sparkContext.defaultParallelism, -(-counts[0] // 256) or 1))
    left, right = _dealt(queries, F.lit(rows), F.lit(blocks), "block", "part"), _dealt(pool, F.lit(rows), F.lit(blocks), "part", "block")
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(_best(k, same_id), PAIR_SCHEMA)


PAIR_SCHEMA = "query_id long, id long, score double"


def _dealt(rows: DataFrame, parts: Column, blocks: Column, own: str, other: str) -> DataFrame:
    """``rows`` by their own cell number, once for every number of the other side."""
    n = {"part": parts, "block": blocks}
    placed = rows.withColumn(own, F.pmod(F.xxhash64("id"), n[own]).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), n[other].cast("int") - 1))).select("id", "group", "vector", "part", "block")


def _best(k: int, same_id: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The best candidates of each query in one cell."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        b = b.sort_values("id")
        own, other = a["id"].to_numpy(), b["id"].to_numpy()
        score = np.round(np.stack(a["vector"]).astype(float) @ np.stack(b["vector"]).astype(float).T, 9)
        if not same_id:
            score[own[:, None] == other[None, :]] = -np.inf
        top = np.argsort(-score, 1, kind="stable")[:, :k]
        found = np.take_along_axis(score, top, 1)
        keep = found.ravel() > -np.inf
        return pd.DataFrame({"query_id": np.repeat(own, top.shape[1])[keep], "id": other[top].ravel()[keep], "score": found.ravel()[keep]})

    return best


def top_k(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best."""
    return _ranked(scored_pairs(queries, pool, k), k)


def top_k_within_groups(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): each row's ``k`` best among the other rows of its own group.

    All groups are searched in one job: the group is part of the cell, and each group
    has as many cells as its size asks for.  Rows without a group match nothing.
    """
    rows = rows.where("group IS NOT NULL")
    n, cores = F.count("*"), rows.sparkSession.sparkContext.defaultParallelism
    parts = F.greatest(F.ceil(n / POOL_ROWS), F.least(F.lit(cores), F.ceil(n / 256))).cast("int")
    sizes = rows.groupBy(F.col("group").alias("of_group")).agg(parts.alias("parts"), F.ceil(n / QUERY_ROWS).cast("int").alias("blocks"))
    sized = rows.join(sizes, F.col("group") == F.col("of_group"))
    left, right = (_dealt(sized, F.col("parts"), F.col("blocks"), *names) for names in (("block", "part"), ("part", "block")))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    cell = ("group", "part", "block")
    return _ranked(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_best(k, False), PAIR_SCHEMA), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


def gate(score: Column, threshold: float) -> Column:
    """``fewshot`` at the threshold or above, else ``zero_shot``; a missing score is ``zero_shot``."""
    return F.when(score >= threshold, "fewshot").otherwise("zero_shot")


def set_minimum_gate(scores: Column, wanted: int, threshold: float) -> Column:
    """The gate on the smallest score; a wrong number of scores, or one that is not finite, is an error."""
    bad = (F.size(scores) != wanted) | F.exists(scores, lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))
    checked = F.when(bad, F.raise_error(F.lit("selected scores are missing or not finite")).cast("double")).otherwise(F.array_min(scores))
    return gate(checked, threshold)


def distinct_top(candidates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` distinct ids of each query by rank."""
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    once = candidates.withColumn("_n", first).where("_n = 1").drop("_n")
    return once.withColumn("place", again).where(F.col("place") <= k)
