"""Execution match of gold and predicted statements over the star schema (SET-6, EXE-1, EXE-6), and vector retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions import sqlfeatures as S
from quarrylane.operators import execution, retrieval
from quarrylane.plans.registry import register
from quarrylane.plans.relational import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: (id, gold, pred) over the star schema; both engines read these texts.
SUITE = [
    ("m1", "SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY 2 DESC"),
    ("m2", "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'", "SELECT count(*) FROM orders WHERE o_orderstatus = 'O'"),
    ("m3", "SELECT DISTINCT c_mktsegment FROM customer", "SELECT c_mktsegment FROM customer"),
    ("m4", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    ("m5", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey", "SELECT n_name, r_name FROM region JOIN nation ON r_regionkey = n_regionkey"),
    ("m6", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0", "SELECT s_suppkey FROM supplier WHERE NOT s_acctbal <= 0"),
]
SUITE_SQL = " UNION ALL ".join(
    f"SELECT '{i}' AS case_id, NOT EXISTS (SELECT * FROM (({g}) EXCEPT ALL (SELECT * FROM ({p}) p{k}))) AND NOT EXISTS (SELECT * FROM (({p}) EXCEPT ALL (SELECT * FROM ({g}) g{k}))) AS exec_match"
    for k, (i, g, p) in enumerate((i, g.replace("ORDER BY 2 DESC", ""), p.replace("ORDER BY 2 DESC", "")) for i, g, p in SUITE)
)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """The star schema's tables as views of this session."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def exec_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, exec_match) of the suite."""
    register_views(spark, sf_dir)
    return execution.statement(spark, SUITE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution match accuracy over the suite."""
    return exec_matches(spark, sf_dir).agg(F.count("*").alias("cases"), F.count_if("exec_match").alias("matches"), F.round(F.avg(F.col("exec_match").cast("int")), 6).alias("ema"))


register("exe1_set6_exec_match", exec_matches, SUITE_SQL)
register("flagship_exec_match_accuracy", flagship, f"SELECT count(*) AS cases, count(*) FILTER (WHERE exec_match) AS matches, round(avg(CAST(exec_match AS INTEGER)), 6) AS ema FROM ({SUITE_SQL})")


#: Scores have nine digits; rounding them again would meet half-way cases, so millionths are cut.
MICRO = lambda score: F.floor(score * 1000000)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("group"), F.col("embedding").alias("vector"))


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    return retrieval.top_k(v, v, k)


SCORES = (
    "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.id AS query_id, p.id, q.label AS ql, p.label AS pl, round(list_dot_product(q.e, p.e), 9) AS score FROM v q JOIN v p ON q.id <> p.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"
)
register(
    "jn8_vector_top_k", lambda spark, sf_dir: neighbours(spark, sf_dir, 10).withColumn("score", MICRO(F.col("score"))),
    f"WITH {SCORES} SELECT query_id, rank, id, CAST(floor(score * 1000000) AS BIGINT) AS score FROM r WHERE rank <= 10",
)
register(
    "jn9_self_neighbours",
    lambda spark, sf_dir: neighbours(spark, sf_dir, 1).agg(*[F.count_if(F.col("score") >= t).alias(f"at_least_{int(100 * t)}") for t in (0.95, 0.9, 0.85)], F.round(F.avg("score"), 6).alias("mean_best")),
    f"WITH {SCORES} SELECT count(*) FILTER (WHERE score >= 0.95) AS at_least_95, count(*) FILTER (WHERE score >= 0.9) AS at_least_90, count(*) FILTER (WHERE score >= 0.85) AS at_least_85, round(avg(score), 6) AS mean_best FROM r WHERE rank = 1",
)


def with_labels(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = vectors(spark, sf_dir)
    q, p = v.select(F.col("id").alias("q"), F.col("group").alias("ql")), v.select(F.col("id").alias("p"), F.col("group").alias("pl"))
    n = neighbours(spark, sf_dir, k)
    return n.join(q, F.col("query_id") == F.col("q")).join(p, F.col("id") == F.col("p")).drop("q", "p")


register(
    "flt3_filter_reasons",
    lambda spark, sf_dir: with_labels(spark, sf_dir, 20).select(F.when(F.col("score") >= 0.999, "same_question").when(F.col("ql") != F.col("pl"), "db_mismatch").otherwise("kept").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    f"WITH {SCORES} SELECT CASE WHEN score >= 0.999 THEN 'same_question' WHEN ql <> pl THEN 'db_mismatch' ELSE 'kept' END AS reason, count(*) AS n FROM r WHERE rank <= 20 GROUP BY 1",
)


def win2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten first, then the filter, then ranks again: may leave fewer than three."""
    kept = with_labels(spark, sf_dir, 10).where("ql = pl")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("place", place.cast("long")).where("place <= 3").select("query_id", "place", "id")


register(
    "win2b_rank_then_filter", win2b,
    f"WITH {SCORES} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, id FROM r WHERE rank <= 10 AND ql = pl QUALIFY place <= 3",
)


def win2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter before the ranks: exact filtered top three; groups are searched on their own."""
    return retrieval.top_k_within_groups(vectors(spark, sf_dir), 3).select("query_id", "rank", "id")


register("win2_filter_then_rank", win2, f"WITH {SCORES} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id FROM s WHERE ql = pl QUALIFY rank <= 3")


def win1(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = F.when(F.col("ql") == F.col("pl"), 0.08).otherwise(-0.04)
    x = with_labels(spark, sf_dir, 10).withColumn("final", F.round(F.col("score") + bonus, 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc("score"), "rank", "id"))
    return x.withColumn("place", place.cast("long")).select("query_id", "place", "id", MICRO(F.col("final")).alias("final"))


register(
    "win1_rerank", win1,
    f"WITH {SCORES}, f AS (SELECT *, round(score + CASE WHEN ql = pl THEN 0.08::DOUBLE ELSE -0.04::DOUBLE END, 9) AS f FROM r WHERE rank <= 10) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, score DESC, rank, id) AS place, id, CAST(floor(f * 1000000) AS BIGINT) AS final FROM f",
)
register(
    "win3_distinct_top",
    lambda spark, sf_dir: retrieval.distinct_top(with_labels(spark, sf_dir, 10).select("query_id", F.col("pl").alias("id"), "rank"), 3).select("query_id", "id", F.col("place").cast("long").alias("place")),
    f"WITH {SCORES}, d AS (SELECT query_id, CAST(pl AS VARCHAR) AS id, min(rank) AS rank FROM r WHERE rank <= 10 GROUP BY ALL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM d QUALIFY place <= 3",
)


def flt5(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = neighbours(spark, sf_dir, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s")).select("query_id", F.transform("s", lambda x: x["score"]).alias("scores"))
    return best.select(
        "query_id", retrieval.gate(F.try_element_at("scores", F.lit(1)), 0.7).alias("first_gate"), retrieval.set_minimum_gate(F.col("scores"), 3, 0.7).alias("minimum_gate"),
        MICRO(F.array_min("scores")).alias("gate_score"))


register(
    "flt5_flt6_gates", flt5,
    f"WITH {SCORES} SELECT query_id, CASE WHEN max(score) >= 0.7 THEN 'fewshot' ELSE 'zero_shot' END AS first_gate, CASE WHEN min(score) >= 0.7 THEN 'fewshot' ELSE 'zero_shot' END AS minimum_gate, CAST(floor(min(score) * 1000000) AS BIGINT) AS gate_score FROM r WHERE rank <= 3 GROUP BY query_id",
)
register(
    "agg19_match_rates",
    lambda spark, sf_dir: with_labels(spark, sf_dir, 3).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, (F.col("ql") == F.col("pl")).cast("int"))).alias("top1"), F.max((F.col("ql") == F.col("pl")).cast("int")).alias("any3")).agg(
        F.round(F.avg("top1"), 6).alias("top1_rate"), F.round(F.avg("any3"), 6).alias("top3_coverage")),
    f"WITH {SCORES}, q AS (SELECT query_id, max(CASE WHEN rank = 1 THEN CAST(ql = pl AS INTEGER) END) AS t, max(CAST(ql = pl AS INTEGER)) AS a FROM r WHERE rank <= 3 GROUP BY 1) SELECT round(avg(t), 6) AS top1_rate, round(avg(a), 6) AS top3_coverage FROM q",
)
register(
    "agg22_score_slots",
    lambda spark, sf_dir: neighbours(spark, sf_dir, 3).groupBy("rank").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most")),
    f"WITH {SCORES} SELECT rank, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most FROM r WHERE rank <= 3 GROUP BY rank",
)
register(
    "sta11_gate_bins",
    lambda spark, sf_dir: with_labels(spark, sf_dir, 1).groupBy(S.similarity_bin(F.col("score")).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("ql") == F.col("pl")).cast("int")), 6).alias("match_rate")),
    f"WITH {SCORES} SELECT CASE WHEN score < 0.6 THEN '<0.60' WHEN score < 0.7 THEN '0.60-<0.70' WHEN score < 0.85 THEN '0.70-<0.85' ELSE '>=0.85' END AS bin, count(*) AS n, round(avg(CAST(ql = pl AS INTEGER)), 6) AS match_rate FROM r WHERE rank = 1 GROUP BY 1",
)
