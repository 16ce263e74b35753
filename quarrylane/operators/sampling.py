"""Deterministic sampling: orders by hash, quotas, strata and buckets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions.sqlfeatures import stable_key
from quarrylane.operators.lineage import settled


def first_by_hash(rows: DataFrame, seed: str, id_: str, n: int) -> DataFrame:
    """The first ``n`` rows in hash order."""
    return rows.orderBy(stable_key(F.lit(seed), F.col(id_).cast("string")), id_).limit(n)


def apportion(total: int, sizes: dict) -> dict:
    """Largest remainders, none over its size; ties go to the larger group, then to the later key.

    Each group first gets the whole part of its share.  What is left is dealt out one
    by one in order of remainder, round after round over the groups that have room.
    """
    whole = sum(sizes.values())
    if total > whole:
        raise ValueError(f"cannot take {total} of {whole}")
    shares = {k: n / whole * total if whole else 0.0 for k, n in sizes.items()}
    taken = {k: min(sizes[k], math.floor(s)) for k, s in shares.items()}
    queue = sorted(sizes, key=lambda k: (math.floor(shares[k]) - shares[k], -sizes[k]))
    while (left := total - sum(taken.values())) > 0:
        for k in [k for k in queue if taken[k] < sizes[k]][:left]:
            taken[k] += 1
    return taken


def proportional_with_caps(weights: dict, capacities: dict, total: int, tie: Callable[[object], str]) -> dict:
    """Whole parts of weighted shares up to capacity, then remainders; repeated until the total is reached."""
    taken = dict.fromkeys(capacities, 0)
    while (left := total - sum(taken.values())) > 0:
        room = [k for k in capacities if taken[k] < capacities[k]]
        if not room:
            raise ValueError(f"{left} of {total} cannot be allocated")
        weight = {k: max(weights.get(k, 0.0), 0.0) for k in room}
        if not sum(weight.values()):
            weight = dict.fromkeys(room, 1.0)
        share = {k: left * weight[k] / sum(weight.values()) for k in room}
        for k in room:
            taken[k] += min(capacities[k] - taken[k], math.floor(share[k]))
        left = total - sum(taken.values())
        for k in sorted(room, key=lambda k: (math.floor(share[k]) - share[k], tie(k)))[: max(left, 0)] if left > 0 else []:
            if taken[k] < capacities[k]:
                taken[k] += 1
    return taken


def apportion_with_minimums(total: int, sizes: dict, minimums: dict, capacities: dict | None = None) -> dict:
    """Minimums first (never over the size or the capacity), the rest one by one to the group farthest below its share."""
    whole = sum(sizes.values())
    most = sizes if capacities is None else {k: capacities.get(k, 0) for k in sizes}
    taken = {k: min(most[k], minimums.get(k, 0)) for k in sizes}
    if sum(taken.values()) > total or total > sum(most.values()):
        raise ValueError("minimums and sizes do not allow the total")
    share = {k: n / whole * total if whole else 0.0 for k, n in sizes.items()}
    while sum(taken.values()) < total:
        best = max((k for k in sizes if taken[k] < most[k]), key=lambda k: (share[k] - taken[k], sizes[k], str(k)))
        taken[best] += 1
    return taken


def with_quotas(rows: DataFrame, quotas: dict, group: str, order: Column, id_: str) -> DataFrame:
    """The first rows of each group up to its quota; the quota table has a row a group."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, int(n)) for k, n in quotas.items()], f"_group {dict(rows.dtypes)[group]}, _quota long")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, id_))
    # The constant bound lets every task keep only so many rows of a group before the shuffle.
    ranked = rows.withColumn("_rank", rank).where(F.col("_rank") <= max(quotas.values(), default=0))
    joined = ranked.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_group")))
    return joined.where("_rank <= _quota").drop("_group", "_quota", "_rank")


def stratified(rows: DataFrame, group: str, id_: str, n: int, scope: str) -> DataFrame:
    """``n`` rows by proportional quotas of a signature, in hash order within each."""
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    order = stable_key(F.lit(scope), F.col(group), F.col(id_).cast("string"))
    return with_quotas(rows, apportion(n, dict(sorted(sizes.items()))), group, order, id_)


def priority_fill(rows: DataFrame, rare: Column, aggregation: Column, id_: str, target: int, rate: float, seed: str) -> DataFrame:
    """All rare rows, then aggregations up to ``round(target * rate)`` in all, then simple rows, then further aggregations.

    Adds ``selection_bucket``.  Too many rare rows, or too few in all, is an error.
    """
    kind = F.when(rare, "rare").when(aggregation, "aggregation").otherwise("simple")
    placed = rows.withColumns({"_kind": kind, "_agg": aggregation})
    counts = {r["_kind"]: r for r in placed.groupBy("_kind").agg(F.count("*").alias("n"), F.count_if("_agg").alias("agg")).collect()}
    n = lambda k: counts[k]["n"] if k in counts else 0
    if n("rare") > target or sum(map(n, ("rare", "aggregation", "simple"))) < target:
        raise ValueError("the target cannot be met")
    wanted = max(0, round(target * rate) - (counts["rare"]["agg"] if "rare" in counts else 0))
    first = min(wanted, n("aggregation"), target - n("rare"))
    simple = min(target - n("rare") - first, n("simple"))
    extra = target - n("rare") - first - simple
    rank = F.row_number().over(Window.partitionBy("_kind").orderBy(stable_key(F.lit(seed), F.col(id_).cast("string")), id_))
    chosen = placed.withColumn("_rank", rank).where(F.col("_rank") <= target).withColumn(
        "selection_bucket",
        F.when(F.col("_kind") == "rare", "rare_complexity")
        .when((F.col("_kind") == "aggregation") & (F.col("_rank") <= first), "aggregation_fill")
        .when((F.col("_kind") == "aggregation") & (F.col("_rank") <= first + extra), "extra_aggregation_fill")
        .when((F.col("_kind") == "simple") & (F.col("_rank") <= simple), "simple_fill"),
    )
    return chosen.where("selection_bucket IS NOT NULL").drop("_kind", "_agg", "_rank")


def extra_fill(candidates: DataFrame, aggregation: Column, id_: str, extra: int, rate: float, total: int, held: int, seed: str) -> DataFrame:
    """``extra`` candidates beside preserved rows, so that of ``total`` rows in all a ``rate`` are aggregations.

    ``held`` preserved rows are aggregations already.  Simple rows fill up; what they lack
    aggregations give, and too few candidates are an error.  Adds ``selection_bucket``.
    """
    placed = candidates.withColumn("_kind", F.coalesce(aggregation, F.lit(False)))
    counts = {r["_kind"]: r["n"] for r in placed.groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    first = min(max(0, round(total * rate) - held), extra, counts.get(True, 0))
    simple = min(extra - first, counts.get(False, 0))
    if first + simple < extra and counts.get(True, 0) < extra - simple:
        raise ValueError(f"{sum(counts.values())} candidates cannot give {extra} rows")
    rank = F.row_number().over(Window.partitionBy("_kind").orderBy(stable_key(F.lit(seed), F.col(id_).cast("string")), id_))
    bucket = (
        F.when(F.col("_kind") & (F.col("_rank") <= first), "extra_aggregation_fill")
        .when(F.when(F.col("_kind"), F.col("_rank") <= extra - simple).otherwise(F.col("_rank") <= simple), "extra_simple_fill")
    )
    ranked = placed.withColumn("_rank", rank).where(F.col("_rank") <= extra)
    return ranked.withColumn("selection_bucket", bucket).where("selection_bucket IS NOT NULL").drop("_kind", "_rank")


def review_sample(rows: DataFrame, by: str, group: str, quotas: dict[str, int], id_: str, total: int, seed: str) -> DataFrame:
    """``total`` rows of each ``by``: a quota of each group first, then others in hash order.

    Adds ``place`` and ``swapped``, the blind order of a pair, by the parity of a hash.
    """
    key = stable_key(F.lit(seed), F.col(id_).cast("string"))
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(group)], F.lit(0))
    first = F.row_number().over(Window.partitionBy(by, group).orderBy(key, id_)) <= quota
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_first"), key, id_))
    sampled = rows.withColumn("_first", first).withColumn("place", place).where(F.col("place") <= total)
    return sampled.withColumn("swapped", F.conv(F.substring(key, 64, 1), 16, 10).cast("int") % 2 == 1).drop("_first")


def buckets_without_replacement(rows: DataFrame, id_: str, buckets: list[tuple[str, Column, Column, int]], total: int) -> DataFrame:
    """Top rows of each bucket in turn, none twice, then the best of the rest up to ``total``.

    ``buckets`` are (name, condition, score, n); higher scores first, ties by id.
    Adds ``selection_bucket``.  A handful of small jobs, one a bucket.
    """
    left, parts, taken = rows, [], 0
    for name, condition, score, n in [*buckets, ("fallback", F.lit(True), F.lit(0.0), None)]:
        n = total - taken if n is None else min(n, total - taken)
        part = settled(left.where(condition).orderBy(F.desc(score), id_).limit(n).withColumn("selection_bucket", F.lit(name)))
        taken += part.count()
        parts.append(part)
        left = left.join(part.select(F.col(id_).alias("_taken")), F.col(id_) == F.col("_taken"), "left_anti")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
