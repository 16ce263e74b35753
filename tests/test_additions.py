"""Splits by strata, intervals, ratios, fills and sinks against plain Python."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import history, overlap, sampling, strata
from quarrylane.plans import aggregates, registry
from quarrylane.sources import io

SF = "/root/testdata/sf0.001"


def test_strata_split(spark):
    random = np.random.default_rng(3)
    rows, component = [], 0
    while len(rows) < 400:
        db = f"d{int(random.integers(0, 9))}" if component % 7 else "rare"
        for _ in range(int(random.integers(1, 4))):
            rows.append((len(rows), component, db, bool(random.integers(0, 2))))
        component += 1
    df = spark.createDataFrame(rows, "id long, component long, db string, flag boolean").repartition(3)
    forced = spark.createDataFrame([(c,) for c in range(0, component, 11)], "component long")
    args = ("component", "db", {"flag": F.col("flag")}, {"retrieval": 80, "validation": 41}, "s", forced)
    found = [tuple(r) for r in strata.split_by_strata(df, *args).select("id", "component", "db", "role").collect()]
    assert sorted(found) == sorted(map(tuple, strata.split_by_strata(df.repartition(5), *args).select("id", "component", "db", "role").collect()))
    assert Counter(r[3] for r in found) == {"retrieval": 80, "validation": 41, "train": len(rows) - 121}
    role = {}
    for _, c, _, name in found:
        assert role.setdefault(c, name) == name and not (c % 11 == 0 and name != "train")
    pool = Counter(r[2] for r in rows)
    for name, total in (("retrieval", 80), ("validation", 41)):
        has = Counter(r[2] for r in found if r[3] == name)
        for db, n in pool.items():
            if n >= strata.FREQUENT:
                assert has[db] >= min(1 + int(0.5 * n / len(rows) * total), n // 4)
    with pytest.raises(ValueError):
        strata.split_by_strata(df, "component", "db", {}, {"a": 399, "b": 2}, "s", forced)


def test_difference_in_differences_interval(spark):
    found = {r["source"]: r for r in registry.queries()["sta5_bootstrap_interval"](spark, SF).collect()}
    rows = aggregates.labelled(spark, SF).select("source", (F.col("lang") == "en").alias("t"), (F.col("b") - F.col("a")).alias("d")).toPandas()
    random = np.random.default_rng(1)
    assert set(found) == set(rows["source"])
    for source, own in rows.groupby("source"):
        arms = [own[own["t"] == t]["d"].to_numpy(float) for t in (True, False)]
        if not all(map(len, arms)):
            assert found[source]["ci_low"] is None
            continue
        means = [a[random.integers(0, len(a), (10_000, len(a)))].mean(1) for a in arms]
        plain = np.quantile(means[0] - means[1], [0.025, 0.975])
        assert (found[source]["ci_low"], found[source]["ci_high"]) == pytest.approx(tuple(plain), abs=2 / min(map(len, arms)))


def test_token_jaccard_and_sequence_ratio(spark):
    random = np.random.default_rng(2)
    names = [f"tok{i}" for i in range(12)] + ["the", "of", "ab", "is"]
    sets = {i: sorted({names[int(k)] for k in random.integers(0, 16, int(random.integers(0, 9)))}) for i in range(150)}
    df = spark.createDataFrame(list(sets.items()), "id long, words array<string>").repartition(3)
    plain = set()
    for i, a in sets.items():
        scored = []
        for j, b in sets.items():
            both, either = set(a) & set(b), set(a) | set(b)
            if i != j and any(len(w) >= 3 and w not in overlap.STOP_WORDS for w in both) and 100 * len(both) >= 45 * len(either):
                scored.append((len(both) / len(either), j))
        plain |= {(i, j, round(s, 9), k + 1) for k, (s, j) in enumerate(sorted(scored, reverse=True)[:5])}
    found = overlap.token_jaccard(df, df, overlap.STOP_WORDS).collect()
    assert {(r["id"], r["other"], round(r["jaccard"], 9), r["rank"]) for r in found} == plain and len(found) == len(plain)
    pairs = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in pairs.select(overlap.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, None, 1.0]


def test_extra_fill_and_minimums(spark):
    df = spark.range(20).withColumn("agg", F.col("id") % 4 == 0)
    fill = lambda extra, rate, held: Counter(r["selection_bucket"] for r in sampling.extra_fill(df, F.col("agg"), "id", extra, rate, 20, held, "s").collect())
    assert fill(10, 0.4, 5) == {"extra_aggregation_fill": 3, "extra_simple_fill": 7}
    assert fill(18, 0.1, 5) == {"extra_simple_fill": 18} and fill(20, 1.0, 0) == {"extra_aggregation_fill": 5, "extra_simple_fill": 15}
    with pytest.raises(ValueError):
        fill(21, 0.4, 0)
    assert sampling.apportion_with_minimums(6, {"a": 90, "b": 10}, {"b": 2}, {"a": 3, "b": 5}) == {"a": 3, "b": 3}


def test_merge_by_step(spark):
    rows = spark.createDataFrame([(1, 0.5, "x"), (2, 0.4, "y"), (None, 0.3, "z")], "step long, loss double, name string")
    posthoc = spark.createDataFrame([(1, 9.0, 7), (2, None, 8), (3, 1.0, 9)], "step long, loss double, tokens long")
    assert sorted(map(tuple, history.merge_by_step(rows, posthoc, "step").collect()), key=str) == sorted([(1, 9.0, "x", 7), (2, 0.4, "y", 8), (None, 0.3, "z", None)], key=str)


def test_history_directories(spark, tmp_path):
    import os

    empty = tmp_path / "empty"
    empty.mkdir()
    assert io.load_history(spark, str(empty)).count() == 0
    with pytest.raises(ValueError):
        io.load_history(spark, str(tmp_path / "none"))
    run = tmp_path / "run"
    (run / "checkpoint-1").mkdir(parents=True)
    (run / "checkpoint-1" / "trainer_state.json").write_text('{"log_history": [{"step": 1, "loss": 0.5}]}')
    assert [r["step"] for r in io.load_history(spark, str(run)).collect()] == [1.0]
    (run / "a.log").write_text("{'loss': 0.1}")
    (run / "b.log").write_text("{'loss': 0.2} {'loss': 0.3}")
    os.utime(run / "a.log", (1, 1))
    assert sorted(r["loss"] for r in io.load_history(spark, str(run)).collect()) == [0.2, 0.3]
    io.append_history(spark.createDataFrame([(1, 0.25)], "step long, loss double"), str(run))
    io.append_history(spark.createDataFrame([(2, 0.75)], "step long, loss double"), str(run))
    assert sorted(r["loss"] for r in io.load_history(spark, str(run)).collect()) == [0.25, 0.75]


def test_write_all_is_whole_or_nothing(spark, tmp_path):
    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    io.write_all({f"{tmp_path}/a": good})
    with pytest.raises(Exception, match="no"):
        io.write_all({f"{tmp_path}/a": spark.range(9), f"{tmp_path}/b": bad})
    assert spark.read.json(f"{tmp_path}/a").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["a"]
    io.write_all({f"{tmp_path}/a": spark.range(4), f"{tmp_path}/b": good})
    assert spark.read.json(f"{tmp_path}/a").count() == 4 and spark.read.json(f"{tmp_path}/b").count() == 3


def joins_of(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Join" in line or "Broadcast" in line]


@pytest.fixture
def no_small_sides(spark):
    """Every side of a join counts as too large to be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_execution_match_broadcasts_no_subquery(spark, no_small_sides):
    found = joins_of(registry.queries()["exe1_set6_exec_match"](spark, SF))
    assert found and not any("Broadcast" in line for line in found)


@pytest.mark.parametrize("xs", [[1, 2, None], [], [1, 3]])
@pytest.mark.parametrize("ys", [[], [1], [1, None], [None], [5, 5]])
def test_not_in_without_null_aware_joins(spark, no_small_sides, xs, ys):
    from quarrylane.operators import execution

    spark.createDataFrame([(x,) for x in xs], "x int").createOrReplaceTempView("not_in_a")
    spark.createDataFrame([(y,) for y in ys], "y int").createOrReplaceTempView("not_in_b")
    plain = execution.statement(spark, "SELECT x FROM not_in_a WHERE x NOT IN (SELECT y FROM not_in_b -- )\n) AND 'NOT IN (' <> ')'")
    assert sorted(map(str, plain.collect())) == sorted(f"Row(x={x})" for x in xs if not ys or x is not None and None not in ys and x not in ys)
    assert not any("Broadcast" in line for line in joins_of(plain))
    truth = lambda x: True if not ys else False if x is not None and x in ys else None if x is None or None in ys else True
    shown = execution.statement(spark, "SELECT x, x NOT IN (SELECT y FROM not_in_b) AS k FROM not_in_a").collect()
    assert sorted(map(str, shown)) == sorted(f"Row(x={x}, k={truth(x)})" for x in xs)
    # Subqueries that read outer columns, and operands that are no plain column, stay as they are.
    for text in ("SELECT x FROM not_in_a WHERE x NOT IN (SELECT y FROM not_in_b WHERE y = x)", "SELECT x FROM not_in_a WHERE x + 1 NOT IN (SELECT y FROM not_in_b)"):
        assert sorted(map(str, execution.statement(spark, text).collect())) == sorted(map(str, spark.sql(text).collect()))


def test_execution_accuracy_broadcasts_no_subquery(spark, no_small_sides):
    found = registry.flagship(spark, SF)
    assert joins_of(found) and not any("Broadcast" in line for line in joins_of(found))
    matches = [r["exec_match"] for r in registry.queries()["exe1_set6_exec_match"](spark, SF).collect()]
    assert tuple(found.first())[:2] == (len(matches), sum(matches))


def plain_neighbours(rows, others, percent=45, most=5):
    found = []
    for i, a in rows:
        scored = []
        for j, b in others:
            both, either = set(a or ()) & set(b or ()), set(a or ()) | set(b or ())
            if None not in (i, j) and i != j and any(len(w) >= 3 and w not in overlap.STOP_WORDS for w in both) and 100 * len(both) >= percent * len(either):
                scored.append((len(both) / len(either), j))
        found += [(i, j, round(s, 9), k + 1) for k, (s, j) in enumerate(sorted(scored, reverse=True)[:most])]
    return sorted(found)


@pytest.fixture
def small_blocks(monkeypatch):
    from quarrylane.operators import tokensets

    for name, value in (("BLOCK_ENTRIES", 300), ("FEW", 0), ("SHORT_CODES", 5), ("CHUNK", 3), ("INDEX", 7)):
        monkeypatch.setattr(tokensets, name, value)


@pytest.mark.parametrize("clashes", [1 << 20, -1])
def test_token_jaccard_by_blocks(spark, small_blocks, monkeypatch, clashes):
    from quarrylane.operators import tokensets

    monkeypatch.setattr(tokensets, "MOST_CLASHES", clashes)
    random = np.random.default_rng(5)
    names = [f"tok{i}" for i in range(30)] + ["the", "of", "ab", "is", "éé"]
    sets = [(f"r{i}", sorted({names[int(k)] for k in random.integers(0, 35, int(random.integers(0, 25)))})) for i in range(120)]
    sets += [(f"copy{i}", names[3:20]) for i in range(40)] + [("stop", ["the", "of"]), ("stop2", ["the", "of"]), ("null", None), (None, names[3:20]), ("none", [])]
    others = [(f"r{i + 100}", w) for i, (_, w) in enumerate(sets[:60])] + sets[130:]
    df, more = (spark.createDataFrame(x, "id string, words array<string>").repartition(3) for x in (sets, others))
    show = lambda d: sorted((r["id"], r["other"], round(r["jaccard"], 9), r["rank"]) for r in d.collect())
    assert show(overlap.token_jaccard(df, df, overlap.STOP_WORDS)) == plain_neighbours(sets, sets)
    assert show(overlap.token_jaccard(df, more, overlap.STOP_WORDS)) == plain_neighbours(sets, others)
    assert overlap.token_jaccard(df.limit(0), df.limit(0), overlap.STOP_WORDS).collect() == []


def test_token_jaccard_moves_no_candidate_pairs(spark, no_small_sides):
    plan = registry.queries()["jn10_token_jaccard"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan
