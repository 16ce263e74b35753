"""Comparisons of runs against plain Python, with nulls, repeats, ties and empty tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import runs


def test_matched_pairs(spark):
    random = np.random.default_rng(5)
    rows = [(int(c), str(r), int(o)) for c, r, o in zip(random.integers(0, 40, 300), random.integers(0, 5, 300), random.integers(0, 2, 300))]
    odd = [(None, "1", 1), (3, None, 1), (3, "1", None)]
    df = spark.createDataFrame(rows + odd, "case long, run string, ok int")
    best = {}
    for c, r, o in rows:
        best[c, r] = max(o, best.get((c, r), 0))
    plain = sorted((a, b, best[c, a], best[c, b]) for c in range(40) for a, b in itertools.combinations("01234", 2) if (c, a) in best and (c, b) in best)
    assert sorted(map(tuple, runs.matched_pairs(df, "case", "run", "ok").collect())) == plain
    assert runs.matched_pairs(df.limit(0), "case", "run", "ok").count() == 0


def test_matched_comparison(spark):
    pairs = [("x", "y", 0, 1)] * 12 + [("x", "y", 1, 1)] * 3 + [("x", "z", 1, 0), ("x", "z", 0, 1), ("y", "z", 1, 0)]
    found = {(r["run_a"], r["run_b"]): r for r in runs.matched_comparison(spark.createDataFrame(pairs, "run_a string, run_b string, a int, b int"), "K3").collect()}
    assert found["x", "y"]["holm_p"] == pytest.approx(3 * 2 / 2**12) and found["x", "y"]["significance"] == "HOLM_SIGNIFICANT_K3_ADVANTAGE"
    assert [found[k]["direction"] for k in (("x", "y"), ("x", "z"), ("y", "z"))] == ["K3_BETTER", "IDENTICAL_POINT_ESTIMATE", "K3_WORSE"]
    assert found["y", "z"]["significance"] == "NOT_HOLM_SIGNIFICANT"


def test_traces(spark):
    kinds = "query_id long, ids array<long>, scores array<double>"
    left = spark.createDataFrame([(1, [5, 6], [0.9, 0.8]), (2, [5], [0.7]), (3, [7], [0.5]), (4, [8, 9], [0.4, 0.3])], kinds)
    right = spark.createDataFrame([(1, [5, 6], [0.9, 0.8]), (2, [6], [0.7]), (4, [8], [0.4]), (5, [1], [0.1])], kinds)
    row = runs.compare_traces(left, right).first()
    assert tuple(row)[:5] == (5, 1, 1, 1, 2) and row["max_delta"] == 0.0 and row["mean_delta"] == 0.0
    assert runs.compare_traces(left.limit(0), right.limit(0)).first()["queries"] == 0
    both = left.withColumn("run", F.lit("a")).unionByName(right.withColumn("run", F.lit("b")))
    assert {tuple(r) for r in runs.retrieval_identity(both).collect()} == {(2, 1, 1), (2, 2, 2), (1, 1, 2)}
    ranked = spark.createDataFrame([(1, 2, 6, 0.8), (1, 1, 5, 0.9)], "query_id long, rank long, id long, score double")
    assert [tuple(r) for r in runs.traces(ranked).collect()] == [(1, [5, 6], [0.9, 0.8])]


def test_gate_identity(spark):
    gated = spark.createDataFrame([(1, "fewshot", "p"), (2, "fewshot", None), (3, "zero_shot", "q"), (4, "zero_shot", "r")], "id long, gate string, out string")
    zero = spark.createDataFrame([(1, "z"), (3, "q")], "id long, out string")
    ungated = spark.createDataFrame([(1, "p"), (2, None), (4, "r")], "id long, out string")
    assert {tuple(r) for r in runs.gate_identity(gated, zero, ungated, "id", "gate", ("out",)).collect()} == {("fewshot", 2, 2), ("zero_shot", 2, 1)}


def test_token_components(spark):
    df = spark.createDataFrame([("ab", "c d"), (None, "x"), ("", "")], "a string, b string")
    part = runs.token_components([("first", F.col("a")), ("second", F.col("b")), ("first", F.lit("!"))], lambda t: F.regexp_count(t, F.lit("[a-z]+|!")))
    assert [tuple(r[0]) for r in df.select(part).collect()] == [(2, 1, 3), (1, 1, 2), (1, 0, 1)]


def test_artefact_register(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.csv").write_text("x")
    (tmp_path / "b.csv").write_text("x")
    rows = [("one", "a.csv"), ("one", "b.csv"), ("one", "b.csv"), ("two", "deep"), ("two", "c.csv"), ("three", None), ("four", tmp_path.name)]
    found = runs.artefact_register(spark, spark.createDataFrame(rows, "requirement string, artefact string"), str(tmp_path)).collect()
    assert {tuple(r) for r in found} == {("one", 2, 2, "", "complete"), ("two", 2, 1, "c.csv", "open"), ("three", 0, 0, "", "open"), ("four", 1, 0, tmp_path.name, "open")}
