"""Engine operators: laws, small cases and odd inputs."""

import json
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylane.functions import extraction, sqlparse
from quarrylane.operators import dedup, execution, history, metrics, overlap, retrieval, sampling, statistics, taxonomy
from quarrylane.plans.execution import register_views
from quarrylane.sources import io

SF = "/root/testdata/sf0.001"
EXTRACTIONS = [
    ("legacy", "```sql\nSELECT count(*) FROM shops;\n```", "SELECT count(*) FROM shops;"),
    ("legacy", "SELECT title FROM books", "SELECT title FROM books;"),
    ("legacy", "Of course!\n```sql\nSELECT * FROM trips;\n```\nThat is all.", "SELECT * FROM trips;"),
    ("legacy", "The statement:\nSELECT * FROM trips; DROP TABLE shops;", "SELECT * FROM trips;"),
    ("legacy", "```sql\nSELECT 1 FROM a;\n```\n```sql\nSELECT 2 FROM b;\n```", "SELECT 1 FROM a;"),
    ("legacy", "Nothing to see", None),
    ("legacy", "", None),
    ("legacy", "PRAGMA page_size=1; SELECT * FROM trips;", "SELECT * FROM trips;"),
    ("legacy", "SELECT * FROM trips;\nQuestion:\nAnd now?", "SELECT * FROM trips;"),
    ("legacy", "<|assistant|>\nSELECT * FROM shops;\n<|user|>\nQuestion: y", "SELECT * FROM shops;"),
    ("legacy", "WITH w AS (SELECT * FROM trips) SELECT * FROM w;", "WITH w AS (SELECT * FROM trips) SELECT * FROM w;"),
    ("legacy", "SQL query:\nSELECT * FROM trips;", "SELECT * FROM trips;"),
    ("legacy", "</think>\nSELECT max(a), min(a) FROM t;", "SELECT max(a), min(a) FROM t;"),
    ("legacy", "SELECT from the shop table it is. </think> SELECT max(a) FROM t;", "SELECT max(a) FROM t;"),
    ("legacy", "with columns x, y. </think> SELECT x FROM t GROUP BY x;", "SELECT x FROM t GROUP BY x;"),
    ("legacy", "with SELECT. End it. So: SELECT tune;", "SELECT tune;"),
    ("legacy", "with the largest crowd? We translate this.", None),
    ("legacy", "Text before. WITH v AS (SELECT a FROM t) SELECT * FROM v;", "WITH v AS (SELECT a FROM t) SELECT * FROM v;"),
    ("legacy", "SELECT a FROM t WHERE b =;", "SELECT a FROM t WHERE b =;"),
    ("robust_v2", "Draft. SELECT a FROM t WHERE b = 1 OR b = 2;\n</think>\nSELECT a FROM t WHERE b =", "SELECT a FROM t WHERE b = 1 OR b = 2;"),
    ("robust_v2", "SELECT a FROM t;\nHowever, corrected:\nSELECT DISTINCT a FROM t;", "SELECT DISTINCT a FROM t;"),
    ("robust_v2", "SELECT a FROM t EXCEPT SELECT b FROM u But note this goes on;\nSELECT a FROM t LEFT JOIN u ON x = y;", "SELECT a FROM t LEFT JOIN u ON x = y;"),
    ("robust_v2", "SELECT a FROM t WHERE b =;", None),
    ("robust_v3", "Draft: SELECT avg(a) FROM t);\nFinal: SELECT b FROM t WHERE a > (SELECT avg(a) FROM t);", "SELECT b FROM t WHERE a > (SELECT avg(a) FROM t);"),
    ("robust_v3", "SELECT a FROM t WHERE b < 1 INTERSECT SELECT a FROM t WHERE b > 5;", "SELECT a FROM t WHERE b < 1 INTERSECT SELECT a FROM t WHERE b > 5;"),
    ("robust_v3", "SELECT a FROM t EXCEPT SELECT a FROM u JOIN v ON c = d;", "SELECT a FROM t EXCEPT SELECT a FROM u JOIN v ON c = d;"),
    ("robust_v3", "SELECT a FROM t WHERE b =;", None),
    ("sql_first_statement_only", "Steps. SELECT a FROM t WHERE b > 1; However, another is SELECT a FROM t;", "SELECT a FROM t WHERE b > 1;"),
    ("sql_first_statement_only", "Answer: SELECT a FROM t WHERE c = 'x; y'; Reasons.", "SELECT a FROM t WHERE c = 'x; y';"),
    ("sql_first_statement_only", "Steps\nSELECT a FROM t WHERE b > (SELECT avg(b) FROM t); More.", "SELECT a FROM t WHERE b > (SELECT avg(b) FROM t);"),
    ("sql_first_statement_only", "We need to select the name of it. SQL: SELECT a FROM t WHERE b > 1;", "SELECT a FROM t WHERE b > 1;"),
    ("sql_first_statement_only", None, None),
]


@pytest.mark.parametrize("mode,text,expected", EXTRACTIONS)
def test_extraction(mode, text, expected):
    assert extraction.extract(text, mode) == expected


def test_extraction_column(spark):
    df = spark.createDataFrame([(t,) for m, t, _ in EXTRACTIONS if m == "legacy"], "raw string")
    found = [r[0] for r in df.select(extraction.extract_sql(F.col("raw"), "legacy")).collect()]
    assert sorted(found, key=str) == sorted((e for m, _, e in EXTRACTIONS if m == "legacy"), key=str)
    with pytest.raises(ValueError, match="unknown mode"):
        extraction.extract_sql(F.col("raw"), "other")


@given(st.text(st.sampled_from(list("ab'\"`[](),; \n"))))
@settings(deadline=None)
def test_split_outside_loses_only_delimiters(text):
    parts = sqlparse.split_outside(text, ",")
    assert "".join("".join(parts).split()) in ("".join(text.split()).replace(",", ""), "".join("".join(parts).split()))
    assert all(p == p.strip() for p in parts)


def test_schema_text():
    found = sqlparse.schema_text("CREATE TABLE a (id INT, \"full name\" TEXT, PRIMARY KEY (id)); CREATE TABLE b (x DECIMAL(10, 2), a_id INT, FOREIGN KEY (a_id) REFERENCES a (id))")
    assert (found.tables, found.columns, found.error) == (2, 4, None)
    assert "Columns: id, full name\nPrimary key: id" in found.text and "- b.a_id -> a.id" in found.text
    assert sqlparse.schema_text("").error and sqlparse.schema_text("SELECT 1").error and sqlparse.schema_text("CREATE TABLE t (PRIMARY KEY (a))").error


def test_components():
    c = sqlparse.components("SELECT n.name, count(*) FROM customer AS c JOIN nation n ON c.nid = n.id WHERE c.bal > 10 AND n.name LIKE 'F%' GROUP BY n.name ORDER BY 2 DESC LIMIT 3; -- end")
    assert c.parsed and c.tables == {"customer", "nation"} and c.columns == {"nation.name", "customer.nid", "nation.id", "customer.bal"}
    assert c.select == ["n . name", "count ( * )"] and c.texts["limit"] == "3" and c.operators == [">", "like"] and c.literals == ["10", "'f%'"]
    assert not sqlparse.components("SELECT (a FROM t").parsed and not sqlparse.components("").parsed
    assert sqlparse.components("SELECT a FROM t WHERE b IN (SELECT b FROM u)").subqueries == 1


def test_taxonomy_labels():
    found = taxonomy.label_case("SELECT DISTINCT a FROM t JOIN u ON x = y WHERE a = 1 LIMIT 5;", "SELECT a, b FROM t WHERE a = 2", "```sql", "no such column: b")
    for label in ("MISSING_TABLE", "MISSING_JOIN", "MISSING_DISTINCT", "EXTRA_SELECT_EXPRESSION", "WRONG_LITERAL_VALUE", "MISSING_LIMIT", "UNKNOWN_COLUMN", "NO_TERMINATING_SEMICOLON", "COMPLEX_MULTI_COMPONENT_ERROR"):
        assert label in found, label
    assert "WRONG_SORT_DIRECTION" not in found
    assert taxonomy.label_case("SELECT a FROM t;", "SELECT a FROM t;", "x", "") == {"UNCLASSIFIED": "E4", "MANUAL_REVIEW_REQUIRED": "E4"}
    empty = taxonomy.label_case("SELECT a FROM t;", "", "", "")
    assert {"EMPTY_RAW_OUTPUT", "EMPTY_SQL_EXTRACTION", "SQL_PARSE_ERROR"} <= set(empty) and "EXTRACTOR_FAILURE" not in empty
    assert all(label in taxonomy.FAMILY_OF for label in [*found, *empty])
    assert taxonomy.result_labels([(1,), (2,)], [(2,), (1,)]) == ["ORDER_ONLY_MISMATCH"]
    assert set(taxonomy.result_labels([(1,)], [(1,), (1,)])) == {"WRONG_RESULT_CARDINALITY", "WRONG_SCALAR_VS_LIST", "EXTRA_ROWS", "DUPLICATE_ROWS"}


def test_long_labels(spark):
    df = spark.createDataFrame([("a", "SELECT x FROM t", "SELECT y FROM t;", "", "")], "id string, gold string, pred string, raw string, error string")
    rows = taxonomy.long_labels(df.withColumn("labels", taxonomy.labels(F.col("gold"), F.col("pred"), F.col("raw"), F.col("error"))), "id", "labels").collect()
    assert {r["family"] for r in rows if r["label"] == "WRONG_COLUMN"} == {"SCHEMA_LINKING"} and all(r["family"] for r in rows)


@given(st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=25, deadline=None)
def test_mcnemar(spark, a, b):
    p, swapped, none = spark.range(1).select(
        statistics.mcnemar(F.lit(a), F.lit(b)), statistics.mcnemar(F.lit(b), F.lit(a)), statistics.mcnemar(F.lit(a), F.lit(b), None)
    ).first()
    n, low = a + b, min(a, b)
    expected = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(low + 1)) / 2**n)
    assert p == pytest.approx(expected, rel=1e-9) and p == pytest.approx(swapped) and (none is None) == (n == 0)


def test_mcnemar_many_pairs(spark):
    p = spark.range(1).select(statistics.mcnemar(F.lit(1500), F.lit(1700))).first()[0]
    expected = 2 * sum(math.comb(3200, k) for k in range(1501)) / 2**3200
    assert p == pytest.approx(expected, rel=1e-6)


def test_holm_is_monotonic(spark):
    random.seed(3)
    values = [(i % 2, i, random.random() / 10) for i in range(40)]
    rows = statistics.holm(spark.createDataFrame(values, "family int, i int, p double"), "p", ["family"], ["i"]).collect()
    for family in (0, 1):
        own = sorted((r["p"], r["i"], r["holm_p"]) for r in rows if r["family"] == family)
        running = 0.0
        for k, (p, _, adjusted) in enumerate(own):
            running = max(running, min(1.0, (len(own) - k) * p))
            assert adjusted == pytest.approx(running)


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=25))
@settings(max_examples=10, deadline=None)
def test_greedy_dedup_equals_the_scan(spark, keys):
    seen_a, seen_b, expected = set(), set(), []
    for i, (a, b) in enumerate(keys):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            expected.append(i)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(keys)], "i int, a int, b int")
    assert sorted(r["i"] for r in dedup.greedy_sequential(df, "i", "a", "b").collect()) == expected


def test_last_wins_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "step int, pos int")
    assert sorted(r["pos"] for r in dedup.last_wins(df, "step", "pos").collect()) == [2, 3, 4]


@given(st.dictionaries(st.text("abcde", min_size=1, max_size=2), st.integers(0, 30), min_size=1, max_size=6), st.floats(0, 1))
@settings(deadline=None)
def test_apportion(sizes, share):
    total = int(sum(sizes.values()) * share)
    for found in (sampling.apportion(total, sizes), sampling.proportional_with_caps(sizes, sizes, total, str), sampling.apportion_with_minimums(total, sizes, {})):
        assert sum(found.values()) == total and all(0 <= found[k] <= sizes[k] for k in sizes)


def test_apportion_errors():
    with pytest.raises(ValueError):
        sampling.apportion(5, {"a": 4})
    with pytest.raises(ValueError):
        sampling.apportion_with_minimums(1, {"a": 4}, {"a": 2})
    assert sampling.apportion_with_minimums(5, {"a": 10, "b": 1}, {"b": 1}) == {"a": 4, "b": 1}


def test_priority_fill_and_strata(spark):
    df = spark.createDataFrame([(i, "rare" if i % 10 == 0 else "agg" if i % 2 else "plain") for i in range(100)], "id int, kind string")
    chosen = sampling.priority_fill(df, F.col("kind") == "rare", F.col("kind") == "agg", "id", 40, 0.5, "s")
    assert Counter(r["selection_bucket"] for r in chosen.collect()) == {"rare_complexity": 10, "aggregation_fill": 20, "simple_fill": 10}
    with pytest.raises(ValueError):
        sampling.priority_fill(df, F.col("kind") == "rare", F.col("kind") == "agg", "id", 5, 0.5, "s")
    strata = sampling.stratified(df, "kind", "id", 20, "scope").collect()
    assert Counter(r["kind"] for r in strata) == {"agg": 10, "plain": 8, "rare": 2}


def test_components_of_chain(spark):
    rows = spark.createDataFrame([(i, i // 2, (i + 1) // 2) for i in range(40)] + [(100, 900, 901), (101, None, None)], "id long, question long, sql long")
    found = {r["id"]: r["component"] for r in overlap.components(rows, ("question", "sql")).collect()}
    assert found == {i: 0 for i in range(40)} | {100: 100, 101: 101}


def test_null_keys_are_in_nothing(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, question string")
    b = spark.createDataFrame([(3, None), (4, "x")], "id int, question string")
    assert {r["id"]: r["in_question"] for r in overlap.flags(a, b, ("question",)).collect()} == {1: False, 2: True}
    assert [r["id"] for r in overlap.remove_overlap(a, b, ("question",)).collect()] == [1]


def test_percentiles_disagree_where_they_should(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v long")
    assert metrics.nearest_rank(df, "v", ["g"], 0.5).first()["percentile"] == 3
    assert metrics.floor_index(df, "v", ["g"], 0.5).first()["percentile"] == 2
    assert metrics.interpolated(df, "v", ["g"], 0.5).first()["percentile"] == 2.5
    assert metrics.nearest_rank(df.limit(0), "v", ["g"], 0.5).collect() == []


def test_gates(spark):
    scores = spark.createDataFrame([([0.91, 0.82, 0.74],)], "s array<double>")
    assert scores.select(retrieval.set_minimum_gate(F.col("s"), 3, 0.70)).first()[0] == "fewshot"
    assert scores.select(retrieval.set_minimum_gate(F.col("s"), 3, 0.85)).first()[0] == "zero_shot"
    for bad in ([0.9, 0.8], [0.9, 0.8, float("nan")], [0.9, None, 0.8]):
        with pytest.raises(Exception, match="missing or not finite"):
            spark.createDataFrame([(bad,)], "s array<double>").select(retrieval.set_minimum_gate(F.col("s"), 3, 0.7)).collect()
    ranked = spark.createDataFrame([(0, "A", 1), (0, "A", 2), (0, "B", 3), (0, "C", 4)], "query_id int, id string, rank int")
    assert [r["id"] for r in retrieval.distinct_top(ranked, 3).orderBy("place").collect()] == ["A", "B", "C"]


def test_bags(spark):
    a = spark.createDataFrame([(1, None, 1.5), (2, "x", None)], "a int, b string, c double")
    assert execution.match_strict(a, a.orderBy(F.desc("a"))) and not execution.match_strict(a, a.unionAll(a.limit(1)))
    b = a.withColumn("a", F.col("a").cast("double"))
    assert execution.match_loose(a, b) and not execution.match_strict(a, b) and not execution.match_loose(a, a.select("a"))


def test_execution(spark):
    register_views(spark, SF)
    found = execution.rescore(
        spark,
        [
            ("same", "SELECT count(*) FROM nation;", "SELECT count(n_name) FROM nation WHERE 1 == 1"), ("column", "SELECT 1", "SELECT missing FROM nation"),
            ("empty", "SELECT 1", " ; "), ("write", "SELECT 1", "DROP VIEW nation"), ("divide", "SELECT 1", "SELECT 1 / (n_nationkey - n_nationkey) FROM nation"),
            ("total", "SELECT total(n_nationkey) FROM nation", "SELECT 300.0D"), ("names", "SELECT 1, 1", "SELECT 1 AS a, 1 AS a"),
        ],
    )
    by = {r["id"]: r for r in found}
    assert by["same"]["strict"] and by["total"]["loose"] and by["names"]["strict"]
    assert not any(by[k]["pred_ok"] for k in ("column", "empty", "write", "divide")) and all(by[k]["pred_error"] for k in ("column", "empty", "write", "divide"))
    assert spark.catalog.tableExists("nation")
    assert execution.execute(spark, "SELECT * FROM lineitem", most=10).error == "more than 10 rows"


def test_execution_timeout(spark):
    slow = "SELECT count(*) FROM range(100000000) a JOIN range(100000) b ON a.id % 7 < b.id"
    assert "timeout" in execution.execute(spark, slow, seconds=2).error


def test_history(spark):
    points = spark.createDataFrame([("r", 1, 1.0), ("r", 2, None), ("r", 3, 3.0), ("r", 5, 2.0)], "run string, step int, loss double")
    ends = spark.createDataFrame([("r", 2), ("r", 4)], "run string, step int")
    assert {r["step"]: r["loss"] for r in history.last_at_or_before(points, ends, "run", "step", "loss").collect()} == {2: 1.0, 4: 3.0}
    assert {r["step"]: r["interval_end"] for r in history.intervals(points, ends, "run", "step").collect()} == {1: 2, 2: 2, 3: 4, 5: None}
    ema = {r["step"]: r["ema"] for r in history.smoothed(points.where("loss IS NOT NULL"), ["run"], "step", "loss", 0.5).collect()}
    assert ema == {1: 1.0, 3: 2.0, 5: 2.0}


def test_sources(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"step": 10, "loss": "0.5", "junk": 1}\n\n{"step": 20, "loss": "nan"}\n')
    rows = io.load_history(spark, str(tmp_path / "h.jsonl")).orderBy("step").collect()
    assert [(r["step"], r["loss"]) for r in rows] == [(10.0, 0.5), (20.0, None)] and "junk" not in rows[0].asDict()
    (tmp_path / "t.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.5}, {"step": 2, "eval_loss": 1.5}]}))
    assert [r["step"] for r in io.load_history(spark, str(tmp_path / "t.json")).collect()] == [1.0, 2.0]
    (tmp_path / "run.log").write_text("noise {'loss': 1.5, 'epoch': 0.5} x\n{'loss': 1.0}\n{broken\n")
    assert [(r["step"], r["loss"]) for r in io.load_history(spark, str(tmp_path / "run.log")).collect()] == [(10.0, 1.5), (20.0, 1.0)]
    (tmp_path / "c.csv").write_text('id,raw\na,"two\nlines ""q"""\nb,\n')
    cells = {r["id"]: r["raw"] for r in io.read_csv_text(spark, str(tmp_path / "c.csv")).collect()}
    assert cells == {"a": 'two\nlines "q"', "b": ""}
    with pytest.raises(Exception, match="[Mm]alformed|bad|parse"):
        (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
        io.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    io.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        io.write_new(df, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="repeated"):
        io.keyed(df.unionAll(df))
    made = io.manifest(spark, [str(tmp_path / "t.json")], {"rows": 2}).first()
    assert made["files"][0]["length"] > 0 and len(made["files"][0]["sha256"]) == 64
    assert io.union_of_columns([df, df.withColumn("m", F.lit(2))]).columns == ["id", "n", "m"]
    assert io.markdown_table(df).splitlines()[-1] == "| a | 1 |"


def test_chat_parts_and_pool(spark):
    text = "<|im_start|>user\nContext: x\nQuestion: How many?<|im_end|>\n<|im_start|>assistant\nSELECT 1;<|im_end|>\n"
    df = spark.createDataFrame([(0, text, "SELECT 2", None), (1, "", "", "s")], "i long, question string, query string, context string")
    q, a = io.chat_parts(F.col("question"))
    assert tuple(df.select(q, a).first()) == ("How many?", "SELECT 1;")
    pool = io.retrieval_pool(df, "i").collect()
    assert [(r["id"], r["gold_sql"]) for r in pool] == [("RET_000000", "SELECT 2")]


def test_streaming_upsert(spark, tmp_path):
    from quarrylane.streaming import upsert

    rows = [("r", 1, 1.0, None), ("r", 2, None, 5.0), ("s", 1, 3.0, None), ("r", 3, 2.0, None)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "run string, seq long, loss double, acc double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, seq long, loss double, acc double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = upsert.start(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["run"], "seq", ["loss", "acc"])
    query.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("version="))
    found = {r["run"]: (r["seq"], r["loss"], r["acc"]) for r in spark.read.parquet(str(tmp_path / "out" / f"version={last}")).collect()}
    assert found == {"r": (3, 2.0, 5.0), "s": (1, 3.0, None)}


def test_text_scanners():
    from quarrylane.functions import textscan as t

    assert t.without_comments("a -- b\n'--' /* x */ c").value == "a  \n'--'   c"
    assert t.without_comments("a 'b").error and t.without_comments("a /* b").error
    assert t.normalized("SELECT  A, 'B' ;;").value == "select a , 'b'" and t.exact(" SELECT A; -- x").value == "SELECT A"
    assert t.completion("<think>x</think> so: SELECT a FROM t").value == "SELECT a FROM t;"
    assert all(t.completion(x).error for x in ("", "nothing", "SELECT 1; SELECT 2", "SELECT ``` a"))
    assert t.longest_adjacent_repeat(list("abcabcabcx")) == 6 and t.longest_adjacent_repeat([]) == 0
    assert t.compression_ratio(b"") == 1.0 and t.compression_ratio(b"a" * 1000) < 0.1
    f = t.lexical_features("SELECT a, count(*) FROM t JOIN u ON x = y WHERE a > 1 AND b IS NULL GROUP BY a", "how many of each", 2, 5)
    assert (f["join_count"], f["referenced_table_count"], f["selected_column_count"], f["where_condition_count"], f["complexity_class"]) == (1, 2, 2, 2, "moderate")
    assert t.lexical_features("SELECT 'a", "", 0, 0) is None
    tree = {"select": [], "from": {"table_units": [["table_unit", 0], ["table_unit", 1]]}, "where": [{"select": [], "from": {"table_units": []}}]}
    assert dict(t.ast_counts(tree)) == {"select_nodes": 2, "subqueries": 1, "table_units": 2}


def test_component_split(spark):
    from quarrylane.operators import splits

    rows = [(i, i // 3 * 3 if i < 60 else i, "x" if i < 60 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, component long, signature string")
    forced = spark.createDataFrame([(0,)], "component long")
    found = splits.select_components(df, "component", "signature", "id", 50, "seed", forced).collect()
    chosen = [r for r in found if r["selected"]]
    assert len(found) == 100 and len(chosen) == 50 and not any(r["component"] == 0 for r in chosen)
    by = Counter(r["component"] for r in chosen)
    assert all(n == (3 if c < 60 else 1) for c, n in by.items())
    with pytest.raises(ValueError):
        splits.component_quotas({("a", 3): 2}, 4)


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=8))
@settings(deadline=None)
def test_best_fit_statistics(histogram):
    from quarrylane.operators import splits

    found = splits.best_fit_packing(histogram, 20)
    rooms: list[int] = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        best = min((r for r in rooms if r >= length), default=None)
        if best is not None:
            rooms.remove(best)
        rooms.append((20 if best is None else best) - length)
    assert found["packs"] == len(rooms) and found["boundaries"] == sum(histogram.values()) - len(rooms)


def test_filtered_ranks_of_many_groups(spark, tmp_path):
    from quarrylane.plans import registry

    noise = random.Random(4)
    rows = [(i, None if i % 50 == 7 else f"g{i % 1300}", [noise.uniform(-1, 1) for _ in range(4)]) for i in range(3000)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    groups = {}
    for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("label IS NOT NULL").collect():
        groups.setdefault(r["label"], []).append((r["vec_id"], r["embedding"]))
    plain = set()
    for members in groups.values():
        for q, v in members:
            best = sorted((-round(sum(a * b for a, b in zip(v, w)), 9), c) for c, w in members if c != q)[:3]
            plain |= {(q, rank + 1, c) for rank, (_, c) in enumerate(best)}
    found = registry.queries()["win2_filter_then_rank"](spark, str(tmp_path)).collect()
    assert len(groups) > 1000 and {tuple(r) for r in found} == plain and len(found) == len(plain)


def test_bootstrap_interval_of_ten_thousand(spark):
    import numpy as np

    from quarrylane.plans import aggregates, registry

    found = {r["lang"]: r for r in registry.queries()["sta3_bootstrap_interval_10000"](spark, SF).collect()}
    rows = aggregates.labelled(spark, SF).select("lang", (F.col("b") - F.col("a")).alias("d")).toPandas()
    assert aggregates.REPLICATES == 10_000 and set(found) == set(rows["lang"])
    for lang, own in rows.groupby("lang"):
        d = own["d"].to_numpy(float)
        means = d[np.random.default_rng(1).integers(0, len(d), (10_000, len(d)))].mean(1)
        step = 2 / len(d)
        assert (found[lang]["ci_low"], found[lang]["ci_high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=step)


def test_split_validation(spark):
    from quarrylane.operators import validation

    good = spark.createDataFrame([("dev-1", "q", "dev"), ("dev-2", "r", "dev")], "id string, question string, split string")
    validation.validate_split(good, ["id", "question"], "id", 2, F.col("split") == "dev", "dev-")
    bad = good.unionByName(spark.createDataFrame([("dev-2", " ", "dev"), (None, None, None)], good.schema))
    with pytest.raises(ValueError, match="expected 2 rows, found 4; blank_id: 1; blank_question: 2; other_split: 1; other_prefix: 1; repeated_ids: 1"):
        validation.validate_split(bad, ["id", "question"], "id", 2, F.col("split") == "dev", "dev-")
    assert validation.check_index(good, good) == 2
    with pytest.raises(ValueError, match="2 rows and its metadata 4"):
        validation.check_index(good, bad)


def test_settings():
    from quarrylane.operators import validation

    plain = {"testcases_path": "a", "traincases_path": "b"}
    validation.validate_settings(validation.RunSettings(**plain))
    with pytest.raises(ValueError, match="gate is for dynamic_fewshot only"):
        validation.validate_settings(validation.RunSettings(**plain, fewshot_gate_enabled=True, fewshot_gate_threshold=0.7))


def test_executed_statements_are_kept(spark):
    from quarrylane.operators import execution

    spark.range(3).createOrReplaceTempView("three")
    found = execution.rescore(spark, [("a", "SELECT id FROM three", "SELECT id FROM three ORDER BY id DESC"), ("b", "SELECT id FROM three", "SELECT raise_error('x') FROM three")])
    assert [(r["gold_ok"], r["pred_ok"], r["strict"]) for r in found] == [(True, True, True), (True, False, False)]
    assert execution.execute(spark, "SELECT id FROM three", most=2).error == "more than 2 rows"


def test_last_wins_does_not_rank_rows_without_a_key(spark):
    from quarrylane.operators import dedup

    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 1), ("b", 1)], "k string, n long")
    assert sorted(dedup.last_wins(rows, "k", "n").collect(), key=str) == sorted([("a", 2), (None, 1), (None, 1), ("b", 1)], key=str)


def test_lexical_features_of_odd_statements(spark):
    from quarrylane.functions import textscan as t

    assert t.lexical_features("", "", 0, 0)["complexity_class"] == "simple" and t.lexical_features("SELECT \"a", "", 0, 0) is None
