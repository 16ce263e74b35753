"""Comparisons of runs: matched cases, retrieval traces, gates, parts of prompts and registers of artefacts (STA-9, VAL-3, VAL-5, VAL-7, VAL-8, VAL-11, FEA-33)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import statistics


def matched_pairs(rows: DataFrame, case: str, run: str, outcome: str) -> DataFrame:
    """(run_a, run_b, a, b): the 0/1 outcomes of every two runs that have a case, the smaller run first.

    A case that a run has more than once counts once, with its best outcome; rows with a
    null in any of the three columns take no part.  Cases are shuffled once and are never
    longer than twice the number of runs.
    """
    entry = F.struct(F.col(run).alias("run"), F.col(outcome).cast("int").alias("outcome"))
    whole = F.col(case).isNotNull() & F.col(run).isNotNull() & F.col(outcome).isNotNull()
    cases = rows.where(whole).groupBy(case).agg(F.collect_set(entry).alias("o"))
    better = lambda x: F.exists("o", lambda y: (y["run"] == x["run"]) & (y["outcome"] > x["outcome"]))
    best = cases.select(F.filter("o", lambda x: ~better(x)).alias("o"))
    pair = lambda x, y: F.struct(x["run"].alias("run_a"), y["run"].alias("run_b"), x["outcome"].alias("a"), y["outcome"].alias("b"))
    later = lambda x: F.transform(F.filter("o", lambda y: y["run"] > x["run"]), lambda y: pair(x, y))
    return best.select(F.explode(F.flatten(F.transform("o", later))).alias("p")).select("p.*")


def matched_comparison(pairs: DataFrame, name: str, level: float = 0.05) -> DataFrame:
    """One row for every two runs: paired statistics, Holm's correction over all of them, direction and significance.

    Labels speak of the second run, under ``name``.
    """
    found = statistics.paired(pairs, ["run_a", "run_b"]).withColumns({"mcnemar_p": F.round("mcnemar_p", 12), "_family": F.lit(1)})
    held = statistics.holm(found, "mcnemar_p", ["_family"], ["run_a", "run_b"]).drop("_family")
    up, down = F.col("delta") > 0, F.col("delta") < 0
    direction = F.when(up, f"{name}_BETTER").when(down, f"{name}_WORSE").otherwise("IDENTICAL_POINT_ESTIMATE")
    strong = F.when(up, f"HOLM_SIGNIFICANT_{name}_ADVANTAGE").otherwise(f"HOLM_SIGNIFICANT_{name}_DISADVANTAGE")
    return held.withColumns({"direction": direction, "significance": F.when(F.col("holm_p") < level, strong).otherwise("NOT_HOLM_SIGNIFICANT")})


def traces(ranked: DataFrame) -> DataFrame:
    """(query_id, ids, scores) by rank, of (query_id, rank, id, score) rows."""
    found = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("s"))
    return found.select("query_id", F.transform("s", lambda x: x["id"]).alias("ids"), F.transform("s", lambda x: x["score"]).alias("scores"))


def compare_traces(left: DataFrame, right: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: queries of two runs, those of one run only, those with the same ids in the same order, and the differences of scores.

    Scores are compared place by place where both runs retrieved equally many.
    """
    other = right.select(F.col("query_id").alias("_query"), F.col("ids").alias("_ids"), F.col("scores").alias("_scores"))
    both = left.join(other, F.col("query_id") == F.col("_query"), "full_outer")
    deltas = F.when(F.size("scores") == F.size("_scores"), F.zip_with("scores", "_scores", lambda x, y: F.abs(x - y)))
    both = both.withColumn("deltas", deltas)
    total = F.sum(F.aggregate("deltas", F.lit(0.0), lambda acc, x: acc + x))
    return both.agg(
        F.count("*").alias("queries"), F.count_if(F.col("_query").isNull()).alias("only_left"), F.count_if(F.col("query_id").isNull()).alias("only_right"),
        F.count_if(F.col("ids") == F.col("_ids")).alias("same_ids"), F.count_if(F.array_max("deltas") <= tolerance).alias("within_tolerance"),
        F.max(F.array_max("deltas")).alias("max_delta"), (total / F.sum(F.when(F.col("deltas").isNotNull(), F.size("deltas")))).alias("mean_delta"),
    )


def retrieval_identity(found: DataFrame) -> DataFrame:
    """(runs, variants, queries) of (run, query_id, ids) rows: how many queries so many runs have, with so many different answers."""
    each = found.groupBy("query_id").agg(F.count_distinct("run").alias("runs"), F.count_distinct(F.to_json("ids")).alias("variants"))
    return each.groupBy("runs", "variants").agg(F.count("*").alias("queries"))


def gate_identity(gated: DataFrame, zero: DataFrame, ungated: DataFrame, key: str, decision: str, columns: tuple[str, ...]) -> DataFrame:
    """(decision, n, identical): rows of a gated run that equal the ungated run's where examples were let through, else the zero-shot run's.

    A row whose counterpart is missing is not identical.
    """

    def beside(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        renamed = other.select(F.col(key).alias(f"_{name}"), *[F.col(c).alias(f"_{name}_{c}") for c in columns])
        return rows.join(renamed, F.col(key) == F.col(f"_{name}"), "left")

    def same(name: str) -> Column:
        equal = F.col(f"_{name}").isNotNull()
        for c in columns:
            equal = equal & F.col(c).eqNullSafe(F.col(f"_{name}_{c}"))
        return equal

    rows = beside(beside(gated, zero, "zero"), ungated, "ungated")
    identical = F.when(F.col(decision) == "fewshot", same("ungated")).otherwise(same("zero"))
    return rows.groupBy(F.col(decision).alias("decision")).agg(F.count("*").alias("n"), F.count_if(identical).alias("identical"))


def token_components(segments: list[tuple[str, Column]], count: Callable[[Column], Column]) -> Column:
    """Struct of the tokens that each named part adds to the text before it, and of the ``total``.

    Parts of one name are summed; a null part is empty.  ``count`` gives the tokens of a
    text, so where a token runs over a boundary it belongs to the part that began it.
    """
    prefix, before, parts = F.lit(""), F.lit(0), {}
    for name, text in segments:
        prefix = F.concat(prefix, F.coalesce(text, F.lit("")))
        upto = count(prefix)
        parts[name] = parts.get(name, F.lit(0)) + upto - before
        before = upto
    return F.struct(*[n.cast("long").alias(name) for name, n in parts.items()], before.cast("long").alias("total"))


def artefact_register(spark: SparkSession, wanted: DataFrame, folder: str) -> DataFrame:
    """(requirement, artefacts, present, missing, status) of (requirement, artefact) rows against what lies in a folder.

    An artefact is the name of a file or of a folder with files, at any depth.  A
    requirement is ``complete`` if it names artefacts and all are there, else ``open``;
    rows without an artefact only make their requirement known.
    """
    root = re.sub(r"^\w+:/+", "/", folder).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    inner = F.element_at(F.split("path", re.escape(root), 2), -1)
    there = files.select(F.explode(F.split(inner, "/")).alias("name")).distinct()
    rows = wanted.distinct().join(there, F.col("artefact") == F.col("name"), "left")
    lacking = F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.col("artefact"))))
    found = rows.groupBy("requirement").agg(F.count("artefact").alias("artefacts"), F.count("name").alias("present"), F.array_join(lacking, ",").alias("missing"))
    whole = (F.col("artefacts") > 0) & (F.col("present") == F.col("artefacts"))
    return found.withColumn("status", F.when(whole, "complete").otherwise("open"))
