"""Queries that compare runs (STA-9, VAL-3, VAL-5, VAL-7, VAL-8, VAL-11, FEA-33).

Runs of retrieval are three searches of the same vectors: the best of all, the best of
the query's own group, and those of its group among the best of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import retrieval, runs
from quarrylane.plans.aggregates import TAIL
from quarrylane.plans.execution import MICRO, SCORES, flt5, vectors, win2b
from quarrylane.plans.registry import register
from quarrylane.plans.relational import table


def sta9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as runs and orders as cases; a large quantity is a correct answer."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("large"))
    found = runs.matched_comparison(runs.matched_pairs(rows, "l_orderkey", "l_linenumber", "large"), "LATER")
    return found.select("run_a", "run_b", "n", "n01", "n10", *[F.round(c, 6).alias(c) for c in ("delta", "mcnemar_p", "holm_p")], "direction", "significance")


register(
    "sta9_matched_comparison", sta9,
    f"""WITH o AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity > 25 AS INTEGER)) AS x FROM lineitem GROUP BY ALL),
    c AS (SELECT p.l_linenumber AS run_a, q.l_linenumber AS run_b, count(*) AS n, count(*) FILTER (WHERE p.x < q.x) AS n01, count(*) FILTER (WHERE p.x > q.x) AS n10
      FROM o p JOIN o q ON p.l_orderkey = q.l_orderkey AND p.l_linenumber < q.l_linenumber GROUP BY ALL),
    p AS (SELECT *, (n01 - n10) / n AS d, round({TAIL.format(n='n01', m='n10', none='1.0')}, 12) AS p FROM c),
    k AS (SELECT *, row_number() OVER (ORDER BY p, run_a, run_b) AS place, count(*) OVER () AS size FROM p),
    h AS (SELECT *, max(least(1.0, (size - place + 1) * p)) OVER (ORDER BY place) AS h FROM k)
    SELECT run_a, run_b, n, n01, n10, round(d, 6) AS delta, round(p, 6) AS mcnemar_p, round(h, 6) AS holm_p,
      CASE WHEN d > 0 THEN 'LATER_BETTER' WHEN d < 0 THEN 'LATER_WORSE' ELSE 'IDENTICAL_POINT_ESTIMATE' END AS direction,
      CASE WHEN h >= 0.05 THEN 'NOT_HOLM_SIGNIFICANT' WHEN d > 0 THEN 'HOLM_SIGNIFICANT_LATER_ADVANTAGE' ELSE 'HOLM_SIGNIFICANT_LATER_DISADVANTAGE' END AS significance FROM h""",
)


def best_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return runs.traces(retrieval.top_k(v, v, 3))


def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.traces(retrieval.top_k_within_groups(vectors(spark, sf_dir), 3))


def group_among_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.traces(win2b(spark, sf_dir).select("query_id", F.col("place").alias("rank"), "id", F.lit(None).cast("double").alias("score")))


#: The three runs as lists, by query.
THREE_RUNS = (
    f"{SCORES}, w AS (SELECT query_id, list(id ORDER BY rank) AS ids, list(score ORDER BY rank) AS scores FROM r WHERE rank <= 3 GROUP BY query_id), "
    "g1 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE ql = pl), "
    "g AS (SELECT query_id, list(id ORDER BY k) AS ids, list(score ORDER BY k) AS scores FROM g1 WHERE k <= 3 GROUP BY query_id), "
    "a1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM r WHERE rank <= 10 AND ql = pl), "
    "a AS (SELECT query_id, list(id ORDER BY k) AS ids FROM a1 WHERE k <= 3 GROUP BY query_id)"
)


def val3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different answers the three runs give a query."""
    found = [f(spark, sf_dir).select(F.lit(f.__name__).alias("run"), "query_id", "ids") for f in (best_of_all, best_of_group, group_among_best)]
    return runs.retrieval_identity(found[0].unionByName(found[1]).unionByName(found[2]))


register(
    "val3_retrieval_identity", val3,
    f"""WITH {THREE_RUNS}, u AS (SELECT query_id, ids FROM w UNION ALL SELECT query_id, ids FROM g UNION ALL SELECT query_id, ids FROM a),
    n AS (SELECT query_id, count(*) AS runs, count(DISTINCT ids) AS variants FROM u GROUP BY query_id) SELECT runs, variants, count(*) AS queries FROM n GROUP BY ALL""",
)


def val57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of the own group as a gated run, beside the search of all and what its group has among the best of all."""
    decisions = flt5(spark, sf_dir).select(F.col("query_id").alias("q"), "minimum_gate")
    gated = best_of_group(spark, sf_dir).join(decisions, F.col("query_id") == F.col("q")).drop("q")
    return runs.gate_identity(gated, group_among_best(spark, sf_dir), best_of_all(spark, sf_dir), "query_id", "minimum_gate", ("ids",))


register(
    "val5_val7_gate_identity", val57,
    f"""WITH {THREE_RUNS}, d AS (SELECT query_id, CASE WHEN min(score) >= 0.7 THEN 'fewshot' ELSE 'zero_shot' END AS decision FROM r WHERE rank <= 3 GROUP BY query_id),
    j AS (SELECT decision, g.ids AS mine, CASE WHEN decision = 'fewshot' THEN w.ids ELSE a.ids END AS other FROM g JOIN d USING (query_id) LEFT JOIN w USING (query_id) LEFT JOIN a USING (query_id))
    SELECT decision, count(*) AS n, count(*) FILTER (WHERE mine = other) AS identical FROM j GROUP BY decision""",
)


def val8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of the search of all beside that of the own group; differences in millionths."""
    found = runs.compare_traces(best_of_all(spark, sf_dir), best_of_group(spark, sf_dir))
    return found.withColumns({"max_delta": MICRO(F.col("max_delta")), "mean_delta": F.round("mean_delta", 6)})


register(
    "val8_trace_comparison", val8,
    f"""WITH {THREE_RUNS}, j AS (SELECT w.query_id AS l, g.query_id AS r, w.ids = g.ids AS same,
      CASE WHEN len(w.scores) = len(g.scores) THEN list_transform(range(1, len(w.scores) + 1), lambda i: abs(w.scores[i] - g.scores[i])) END AS d FROM w FULL JOIN g ON w.query_id = g.query_id)
    SELECT count(*) AS queries, count(*) FILTER (WHERE r IS NULL) AS only_left, count(*) FILTER (WHERE l IS NULL) AS only_right, count(*) FILTER (WHERE same) AS same_ids,
      count(*) FILTER (WHERE list_max(d) <= 1e-12) AS within_tolerance, CAST(floor(max(list_max(d)) * 1000000) AS BIGINT) AS max_delta, round(sum(list_sum(d)) / sum(len(d)), 6) AS mean_delta FROM j""",
)

#: Runs of ASCII letters and digits, and every other character but the space.
PLAIN_TOKEN = "[A-Za-z0-9]+|[^A-Za-z0-9 ]"


def fea33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that roles, texts and ends add to rendered turns; a role runs into its text."""
    parts = runs.token_components([("other", F.lit("> ")), ("role", F.col("role")), ("text", F.col("text")), ("other", F.lit("\n"))], lambda t: F.regexp_count(t, F.lit(PLAIN_TOKEN)))
    counted = table(spark, sf_dir, "conversations").select(F.col("role").alias("of"), parts.alias("p"))
    return counted.groupBy("of").agg(*[F.sum(f"p.{c}").alias(f"{c}_tokens") for c in ("other", "role", "text", "total")])


_TOKENS = f"len(regexp_extract_all({{0}}, '{PLAIN_TOKEN}'))"
register(
    "fea33_token_components", fea33,
    f"""WITH c AS (SELECT role, coalesce(role, '') AS a, coalesce(text, '') AS b FROM conversations),
    n AS (SELECT role, {_TOKENS.format("'> '")} AS x, {_TOKENS.format("'> ' || a")} AS y, {_TOKENS.format("'> ' || a || b")} AS z, {_TOKENS.format("'> ' || a || b || chr(10)")} AS total FROM c)
    SELECT role AS "of", CAST(sum(x + total - z) AS BIGINT) AS other_tokens, CAST(sum(y - x) AS BIGINT) AS role_tokens, CAST(sum(z - y) AS BIGINT) AS text_tokens, CAST(sum(total) AS BIGINT) AS total_tokens FROM n GROUP BY role""",
)

#: (requirement, artefact) of a study of the given tables.
WANTED = [
    ("quality study", "documents.parquet"), ("quality study", "labels.parquet"), ("retrieval", "embeddings.parquet"), ("retrieval", "vectors.index"),
    ("web pages", "pages.parquet"), ("review", "review.parquet"), ("review", "agreement.parquet"), ("conclusions", None),
]

register(
    "val11_artefact_register",
    lambda spark, sf_dir: runs.artefact_register(spark, spark.createDataFrame(WANTED, "requirement string, artefact string"), sf_dir),
    f"""WITH w AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in r) + ')' for r in WANTED)}) w(requirement, artefact)),
    j AS (SELECT requirement, artefact, table_name FROM w LEFT JOIN information_schema.tables t ON artefact = table_name || '.parquet')
    SELECT requirement, count(artefact) AS artefacts, count(table_name) AS present, coalesce(string_agg(artefact, ',' ORDER BY artefact) FILTER (WHERE table_name IS NULL), '') AS missing,
      CASE WHEN count(artefact) > 0 AND count(artefact) = count(table_name) THEN 'complete' ELSE 'open' END AS status FROM j GROUP BY requirement""",
)
