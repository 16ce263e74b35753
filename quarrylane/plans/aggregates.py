"""Queries over aggregates, statistics, windows, sampling, history and validation (AGG-*, STA-*, WIN-*, HIS-*, VAL-*, TAX-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions import normalize as N
from quarrylane.functions import sqlfeatures as S
from quarrylane.operators import dedup, history, metrics, sampling, statistics, taxonomy, validation
from quarrylane.plans.registry import register
from quarrylane.plans.relational import table
from quarrylane.plans.text import sql_collapse


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired outcomes of two runs by case, with source as model and language as condition."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", F.col("quality").alias("a"), F.col("toxic").alias("b"))


LAB = "lab AS (SELECT doc_id, lang, source, n_chars, quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id))"


def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("rate"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.min("l_tax").alias("min_tax"), F.max("l_tax").alias("max_tax"),
    )


register(
    "agg1_run_rollup", agg1,
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS rate, round(avg(l_quantity), 6) AS avg_quantity, round(sum(l_extendedprice), 2) AS sum_price, "
    "min(l_tax) AS min_tax, max(l_tax) AS max_tax FROM lineitem GROUP BY ALL",
)


def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("a")
    percent = lambda m: F.when((m >= 0) & (m <= 1), m * 100).otherwise(m)
    return labelled(spark, sf_dir).groupBy("source").agg(
        F.round(percent(mean), 6).alias("ema"), F.round(percent(F.avg("n_chars")), 6).alias("avg_chars"), F.min_by("lang", "doc_id").alias("first_lang"))


register(
    "agg2_run_summary", agg2,
    f"WITH {LAB} SELECT source, round(avg(a) * 100, 6) AS ema, round(CASE WHEN avg(n_chars) <= 1 THEN avg(n_chars) * 100 ELSE avg(n_chars) END, 6) AS avg_chars, arg_min(lang, doc_id) AS first_lang FROM lab GROUP BY source",
)
MEASURES = {"n": ("count(*)", lambda: F.count("*")), "correct": ("CAST(sum(a) AS BIGINT)", lambda: F.sum("a").cast("long")), "toxic": ("CAST(sum(b) AS BIGINT)", lambda: F.sum("b").cast("long")),
            "long_texts": ("count(*) FILTER (WHERE n_chars > 4000)", lambda: F.count_if(F.col("n_chars") > 4000)), "max_chars": ("max(n_chars)", lambda: F.max("n_chars")),
            "share": ("round(avg(CASE WHEN a = 1 AND b = 0 THEN 1.0 ELSE 0.0 END), 6)", lambda: F.round(F.avg(F.when((F.col("a") == 1) & (F.col("b") == 0), 1.0).otherwise(0.0)), 6))}
register(
    "agg3_metric_summary",
    lambda spark, sf_dir: labelled(spark, sf_dir).groupBy("source", "lang").agg(*[e().alias(n) for n, (_, e) in MEASURES.items()]),
    f"WITH {LAB} SELECT source, lang, {', '.join(f'{e} AS {n}' for n, (e, _) in MEASURES.items())} FROM lab GROUP BY ALL",
)


def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    bins = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return d.groupBy("lang", bins.alias("length_bin")).agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("\n")).alias("with_lines"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


register(
    "agg4_distribution", agg4,
    "SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS length_bin, count(*) AS n, "
    "count(*) FILTER (WHERE contains(text, chr(10))) AS with_lines, round(avg(n_chars), 6) AS avg_chars FROM documents GROUP BY ALL",
)
RANKED = "r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)"
for name, make, index in (("agg5_nearest_rank", metrics.nearest_rank, "CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)"), ("agg7_floor_index", metrics.floor_index, "CAST(floor((n - 1) * 0.9) AS BIGINT)")):
    register(
        f"{name}_percentile",
        lambda spark, sf_dir, make=make: make(table(spark, sf_dir, "documents"), "n_chars", ["lang"], 0.9),
        f"WITH {RANKED} SELECT lang, n_chars AS percentile FROM r WHERE i = {index}",
    )
register(
    "agg6_interpolated_percentile",
    lambda spark, sf_dir: metrics.interpolated(table(spark, sf_dir, "documents"), "n_chars", ["lang"], 0.95).withColumn("percentile", F.round("percentile", 6)),
    "SELECT lang, round(quantile_cont(n_chars, 0.95), 6) AS percentile FROM documents GROUP BY lang",
)
register(
    "agg8_duplicate_counts",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("doc_id")).alias("duplicate_ids"), (F.count("*") - F.count_distinct(F.md5("text"))).alias("duplicate_texts"),
        (F.count("*") - F.count_distinct(F.struct("source", F.md5("text")))).alias("duplicate_pairs")),
    "SELECT count(*) AS n, count(*) - count(DISTINCT doc_id) AS duplicate_ids, count(*) - count(DISTINCT md5(text)) AS duplicate_texts, count(*) - count(DISTINCT source || '|' || md5(text)) AS duplicate_pairs FROM documents",
)
register(
    "agg9_group_deltas",
    lambda spark, sf_dir: labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg("b") - F.avg("a"), 6).alias("delta")),
    f"WITH {LAB} SELECT source, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b) - avg(a), 6) AS delta FROM lab GROUP BY source",
)
THRESHOLDS = (0.5, 0.6, 0.7, 0.85, 0.95)


def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate thresholds and the always, never and oracle policies, simulated on paired outcomes in one pass."""
    rules = [("threshold", t) for t in THRESHOLDS] + [("always", None), ("never", None), ("oracle", None)]
    grid = F.broadcast(spark.createDataFrame(rules, "rule string, threshold double"))
    similarity = (F.col("n_chars") % 100) / 100
    use = F.when(F.col("rule") == "always", True).when(F.col("rule") == "never", False).when(F.col("rule") == "oracle", (F.col("a") == 0) & (F.col("b") == 1)).otherwise(similarity >= F.col("threshold"))
    x = labelled(spark, sf_dir).crossJoin(grid).withColumn("use", use).withColumn("chosen", F.when(F.col("use"), F.col("b")).otherwise(F.col("a")))
    sums = x.groupBy("rule", "threshold").agg(
        F.count_if("use").alias("fewshot_cases"), F.round(F.avg("chosen"), 6).alias("ema"), F.round(F.avg(F.col("chosen") - F.col("a")), 6).alias("delta_vs_zero"),
        F.count_if(F.col("use") & (F.col("a") == 0) & (F.col("b") == 1)).alias("rescues"), F.count_if(F.col("use") & (F.col("a") == 1) & (F.col("b") == 0)).alias("regressions"),
    )
    return sums.withColumn("mcnemar_p", F.round(statistics.mcnemar(F.col("regressions"), F.col("rescues"), None), 9))


# An independent binomial tail by log-gamma for the oracle.
TAIL = "(SELECT CASE WHEN {n} + {m} = 0 THEN {none} ELSE least(1.0, 2 * sum(exp(lgamma({n} + {m} + 1) - lgamma(k + 1) - lgamma({n} + {m} - k + 1) - ({n} + {m}) * ln(2.0)))) END FROM range(0, least({n}, {m}) + 1) t(k))"
register(
    "agg10_gate_simulation", agg10,
    f"WITH {LAB}, g AS (SELECT * FROM (VALUES {', '.join(f"('threshold', {t}::DOUBLE)" for t in THRESHOLDS)}, ('always', NULL), ('never', NULL), ('oracle', NULL)) t(rule, threshold)), "
    "x AS (SELECT *, CASE rule WHEN 'always' THEN true WHEN 'never' THEN false WHEN 'oracle' THEN a = 0 AND b = 1 ELSE (n_chars % 100) / 100 >= threshold END AS use FROM lab, g), "
    "s AS (SELECT rule, threshold, count(*) FILTER (WHERE use) AS fewshot_cases, round(avg(CASE WHEN use THEN b ELSE a END), 6) AS ema, round(avg(CASE WHEN use THEN b - a ELSE 0 END), 6) AS delta_vs_zero, "
    "count(*) FILTER (WHERE use AND a = 0 AND b = 1) AS rescues, count(*) FILTER (WHERE use AND a = 1 AND b = 0) AS regressions FROM x GROUP BY ALL) "
    f"SELECT *, round({TAIL.format(n='regressions', m='rescues', none='NULL')}, 9) AS mcnemar_p FROM s",
)


def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled(spark, sf_dir).createOrReplaceTempView("agg11_labelled")
    return spark.sql("SELECT source, lang, CAST(grouping_id(source, lang) AS BIGINT) AS level, count(*) AS n, CAST(sum(a) AS BIGINT) AS correct FROM agg11_labelled GROUP BY GROUPING SETS ((source), (lang), (source, lang))")


register(
    "agg11_grouping_sets", agg11,
    f"WITH {LAB} SELECT source, lang, CAST(grouping_id(source, lang) AS BIGINT) AS level, count(*) AS n, CAST(sum(a) AS BIGINT) AS correct FROM lab GROUP BY GROUPING SETS ((source), (lang), (source, lang))",
)
register(
    "agg12_most_common",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20),
    "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 20",
)
register(
    "agg13_double_counting",
    lambda spark, sf_dir: labelled(spark, sf_dir).select("source", F.explode(F.array_compact(F.array(F.when(F.col("a") == 0, "wrong"), F.when(F.col("b") == 1, "toxic")))).alias("problem")).groupBy("source").agg(F.count("*").alias("problems")),
    f"WITH {LAB} SELECT source, count(*) AS problems FROM (SELECT source FROM lab WHERE a = 0 UNION ALL SELECT source FROM lab WHERE b = 1) GROUP BY source",
)
register(
    "agg14_js_divergence",
    lambda spark, sf_dir: metrics.js_divergence(table(spark, sf_dir, "documents"), labelled(spark, sf_dir), "source").select(F.round("js_divergence", 9).alias("js_divergence"), F.round("max_share_delta", 9).alias("max_share_delta")),
    f"WITH {LAB}, a AS (SELECT source, count(*) / (SELECT count(*) FROM documents) AS p FROM documents GROUP BY 1), b AS (SELECT source, count(*) / (SELECT count(*) FROM lab) AS q FROM lab GROUP BY 1), "
    "j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b USING (source)) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 9) AS js_divergence, "
    "round(max(abs(p - q)), 9) AS max_share_delta FROM j",
)


def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), labelled(spark, sf_dir)
    expected = d.groupBy("source").agg(F.count("*").alias("pool"))
    actual = l.groupBy("source").agg(F.count("*").alias("selected"))
    total = F.sum("selected").over(Window.partitionBy()) / F.sum("pool").over(Window.partitionBy())
    joined = expected.join(actual, "source", "left").fillna(0, ["selected"])
    ratio = F.col("selected") / (F.col("pool") * total)
    return joined.select("source", "pool", "selected", F.round(ratio, 6).alias("ratio"), F.when(ratio >= 2, "over").when(ratio <= 0.5, "under").otherwise("expected").alias("representation"))


AGG15 = (
    f"WITH {LAB}, e AS (SELECT source, count(*) AS pool FROM documents GROUP BY 1), a AS (SELECT source, count(*) AS selected FROM lab GROUP BY 1), j AS (SELECT source, pool, coalesce(selected, 0) AS selected FROM e LEFT JOIN a USING (source)), "
    "r AS (SELECT *, selected / (pool * ((SELECT sum(selected) FROM j) / (SELECT sum(pool) FROM j))) AS ratio FROM j) SELECT source, pool, selected, round(ratio, 6) AS ratio, CASE WHEN ratio >= 2 THEN 'over' WHEN ratio <= 0.5 THEN 'under' ELSE 'expected' END AS representation FROM r"
)
register("agg15_agg25_representation", agg15, AGG15)
register(
    "agg16_typed_multiset",
    lambda spark, sf_dir: table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(F.count("*").alias("n")),
    "SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL",
)
register(
    "agg17_case_order_hash",
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["turn"].cast("string"), x["role"])), "\n"), 256).alias("order_hash")),
    "SELECT conv_id, sha256(string_agg(turn || role, chr(10) ORDER BY turn, role)) AS order_hash FROM conversations GROUP BY conv_id",
)
register(
    "agg18_token_weighted_loss",
    lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum(F.abs("value")) / F.sum(F.length("props"))).alias("loss")).select(
        "event_type", F.round("loss", 6).alias("loss"), F.round(F.when(F.col("loss") < 700, F.exp("loss")).otherwise(F.lit(float("inf"))), 4).alias("perplexity")),
    "SELECT event_type, round(l, 6) AS loss, round(CASE WHEN l < 700 THEN exp(l) ELSE 'inf'::DOUBLE END, 4) AS perplexity FROM (SELECT event_type, sum(abs(value)) / sum(length(props)) AS l FROM events GROUP BY 1)",
)


def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_compact(F.array(F.when(F.col("a") == 0, "QUALITY"), F.when(F.col("b") == 1, "TOXIC"), F.when(F.col("n_chars") > 4000, "LONG")))
    found = labelled(spark, sf_dir).select("doc_id", F.explode(labels).alias("family")).groupBy("family").agg(F.count_distinct("doc_id").alias("cases"))
    return found.withColumn("share", F.round(F.col("cases") / F.sum("cases").over(Window.partitionBy()), 6))


register(
    "agg20_family_shares", agg20,
    f"WITH {LAB}, f AS (SELECT doc_id, 'QUALITY' AS family FROM lab WHERE a = 0 UNION ALL SELECT doc_id, 'TOXIC' FROM lab WHERE b = 1 UNION ALL SELECT doc_id, 'LONG' FROM lab WHERE n_chars > 4000), "
    "c AS (SELECT family, count(DISTINCT doc_id) AS cases FROM f GROUP BY 1) SELECT family, cases, round(cases / (SELECT sum(cases) FROM c), 6) AS share FROM c",
)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired outcomes with their subgroup; long documents stand for executable statements."""
    return labelled(spark, sf_dir).withColumn("subgroup", taxonomy.transition(F.col("a") == 1, F.col("b") == 1, F.col("n_chars") > 500, F.col("n_chars") > 1000))


def tax3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(spark, sf_dir).groupBy(F.substring("subgroup", 1, 2).alias("transition"), "subgroup").agg(F.count("*").alias("n"))


register(
    "tax3_agg21_transitions", tax3,
    f"WITH {LAB}, t AS (SELECT CASE WHEN a = 0 AND b = 1 THEN CASE WHEN n_chars <= 500 THEN 'T1a' ELSE 'T1b' END WHEN a = 1 AND b = 0 THEN CASE WHEN n_chars <= 1000 THEN 'T2a' ELSE 'T2b' END "
    "WHEN a = 0 AND b = 0 THEN CASE WHEN n_chars <= 500 AND n_chars <= 1000 THEN 'T3a' ELSE 'T3b' END ELSE 'T4' END AS subgroup FROM lab) SELECT substr(subgroup, 1, 2) AS transition, subgroup, count(*) AS n FROM t GROUP BY ALL",
)


def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of each source with what is derived from them."""
    return metrics.transition_ratios(transitions(spark, sf_dir), "source", "subgroup")


register(
    "agg21_transition_ratios", agg21,
    f"""WITH {LAB}, t AS (SELECT source, CASE WHEN a = 0 AND b = 1 THEN CASE WHEN n_chars <= 500 THEN 'T1a' ELSE 'T1b' END WHEN a = 1 AND b = 0 THEN CASE WHEN n_chars <= 1000 THEN 'T2a' ELSE 'T2b' END
    WHEN a = 0 AND b = 0 THEN 'T3' ELSE 'T4' END AS g FROM lab), c AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE g LIKE 'T1%') AS repairs, count(*) FILTER (WHERE g LIKE 'T2%') AS regressions,
    count(*) FILTER (WHERE g = 'T3') AS persistent, count(*) FILTER (WHERE g = 'T4') AS stable, count(*) FILTER (WHERE g = 'T1a') AS t1a, count(*) FILTER (WHERE g = 'T2a') AS t2a FROM t GROUP BY source)
    SELECT source, total, repairs, regressions, persistent, stable, repairs - regressions AS net_improvement, round(repairs / nullif(regressions, 0), 9) AS repair_to_regression_ratio, round(repairs / total, 9) AS repair_rate,
    round(regressions / total, 9) AS regression_rate, round(persistent / total, 9) AS persistent_rate, round(stable / total, 9) AS stable_rate, round(t1a / nullif(repairs, 0), 9) AS technical_share_of_repairs,
    round(t2a / nullif(regressions, 0), 9) AS technical_share_of_regressions FROM c""",
)
register(
    "agg24_length_statistics",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2048).alias("over_limit"), *[F.round(F.percentile("n_chars", F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.95)], F.max("n_chars").alias("longest")),
    "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2048) AS over_limit, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS longest FROM documents GROUP BY lang",
)

# Paired statistics.
PAIRED = (
    f"WITH {LAB}, s AS (SELECT source, count(*) AS n, CAST(sum(a) AS BIGINT) AS a_correct, CAST(sum(b) AS BIGINT) AS b_correct, count(*) FILTER (WHERE a = 1 AND b = 1) AS both_correct, "
    "count(*) FILTER (WHERE a = 0 AND b = 0) AS both_wrong, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10 FROM lab GROUP BY source), "
    f"p AS (SELECT *, (b_correct - a_correct) / n AS d, {TAIL.format(n='n01', m='n10', none='1.0')} AS m FROM s)"
)
register(
    "sta1_sta4_paired_statistics",
    lambda spark, sf_dir: statistics.paired(labelled(spark, sf_dir), ["source"]).withColumns({c: F.round(c, 9) for c in ("delta", "relative_error_reduction", "mcnemar_p")}),
    f"{PAIRED} SELECT source, n, a_correct, b_correct, both_correct, both_wrong, n01, n10, round(d, 9) AS delta, CASE WHEN a_correct < n THEN round(d / (1 - a_correct / n), 9) END AS relative_error_reduction, round(m, 9) AS mcnemar_p FROM p",
)
register(
    "sta2_holm",
    lambda spark, sf_dir: statistics.holm(statistics.paired(labelled(spark, sf_dir), ["lang", "source"]), "mcnemar_p", ["lang"], ["source"]).select("lang", "source", F.round("mcnemar_p", 9).alias("mcnemar_p"), F.round("holm_p", 9).alias("holm_p")),
    f"WITH {LAB}, s AS (SELECT lang, source, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10 FROM lab GROUP BY ALL), p AS (SELECT lang, source, {TAIL.format(n='n01', m='n10', none='1.0')} AS m FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(m, 12), source) AS k, count(*) OVER (PARTITION BY lang) AS c FROM p) SELECT lang, source, round(m, 9) AS mcnemar_p, round(max(least(1.0, (c - k + 1) * m)) OVER (PARTITION BY lang ORDER BY k), 9) AS holm_p FROM r",
)


def sta3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("lang", (F.col("b") - F.col("a")).alias("diff"), (F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1).cast("long").alias("pos"))
    means = statistics.resampled_means(rows, "diff", "pos", ["lang"], 100)
    return means.groupBy("lang").agg(F.round(F.percentile("mean", F.lit(0.025)), 9).alias("ci_low"), F.round(F.percentile("mean", F.lit(0.975)), 9).alias("ci_high"))


register(
    "sta3_bootstrap_interval", sta3,
    f"WITH {LAB}, r AS (SELECT lang, b - a AS diff, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM lab), "
    "d AS (SELECT r.lang, rep, CAST('0x' || substr(md5(rep || '|' || r.pos), 1, 12) AS BIGINT) % r.n AS pick FROM r, range(1, 101) t(rep)), "
    "m AS (SELECT d.lang, rep, avg(r.diff) AS mean FROM d JOIN r ON r.lang = d.lang AND r.pos = d.pick GROUP BY ALL) SELECT lang, round(quantile_cont(mean, 0.025), 9) AS ci_low, round(quantile_cont(mean, 0.975), 9) AS ci_high FROM m GROUP BY lang",
)
#: Replicates of the reference.
REPLICATES = 10_000


def sta3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of ``REPLICATES`` resamples; how often a resample has each distinct difference is one multinomial draw."""
    counts = labelled(spark, sf_dir).groupBy("lang", (F.col("b") - F.col("a")).cast("double").alias("diff")).agg(F.count("*").alias("n")).where("diff IS NOT NULL")
    return counts.groupBy("lang").applyInPandas(statistics.bootstrap_interval(REPLICATES), "lang string, ci_low double, ci_high double").select(
        "lang", *[F.round(c, 9).alias(c) for c in ("ci_low", "ci_high")])


register("sta3_bootstrap_interval_10000", sta3_whole)
register(
    "sta5_difference_in_differences",
    lambda spark, sf_dir: labelled(spark, sf_dir).groupBy("source").agg(
        F.round(F.avg(F.when(F.col("lang") == "en", F.col("b") - F.col("a"))) - F.avg(F.when(F.col("lang") != "en", F.col("b") - F.col("a"))), 9).alias("did")),
    f"WITH {LAB} SELECT source, round(avg(b - a) FILTER (WHERE lang = 'en') - avg(b - a) FILTER (WHERE lang <> 'en'), 9) AS did FROM lab GROUP BY source",
)


def sta5_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the same estimate over ``REPLICATES`` resamples."""
    diff = (F.col("b") - F.col("a")).cast("double")
    counts = labelled(spark, sf_dir).groupBy("source", (F.col("lang") == "en").alias("treated"), diff.alias("diff")).agg(F.count("*").alias("n")).where("diff IS NOT NULL AND treated IS NOT NULL")
    found = counts.groupBy("source").applyInPandas(statistics.did_interval("source", REPLICATES), "source string, ci_low double, ci_high double")
    return found.select("source", *[F.round(c, 9).alias(c) for c in ("ci_low", "ci_high")])


register("sta5_bootstrap_interval", sta5_interval)


def sta6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labelled(spark, sf_dir).groupBy("source").agg(F.sum("a").alias("k"), F.count("*").alias("n"))
    w = statistics.wilson(F.col("k"), F.col("n"))
    return s.select("source", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


register(
    "sta6_wilson", sta6,
    f"WITH {LAB}, s AS (SELECT source, sum(a)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM lab GROUP BY 1) SELECT source, "
    "round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM s",
)


def sta8(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = labelled(spark, sf_dir).groupBy("lang").agg(F.avg(F.col("b") - F.col("a")).alias("gain"))
    o = g.select(F.col("lang").alias("other"), F.col("gain").alias("other_gain"))
    return g.join(o, F.col("lang") < F.col("other")).select("lang", "other", F.round(F.col("gain") - F.col("other_gain"), 9).alias("difference"))


register(
    "sta8_heterogeneity", sta8,
    f"WITH {LAB}, g AS (SELECT lang, avg(b - a) AS gain FROM lab GROUP BY 1) SELECT x.lang, y.lang AS other, round(x.gain - y.gain, 9) AS difference FROM g x JOIN g y ON x.lang < y.lang",
)
register(
    "sta11_similarity_bins",
    lambda spark, sf_dir: F.broadcast(spark.createDataFrame([("<0.60",), ("0.60-<0.70",), ("0.70-<0.85",), (">=0.85",)], "bin string")).join(
        labelled(spark, sf_dir).groupBy(S.similarity_bin((F.col("n_chars") % 100) / 100).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b")), "bin", "left").fillna(0, ["n"]),
    f"WITH {LAB}, x AS (SELECT *, (n_chars % 100) / 100 AS s FROM lab), y AS (SELECT CASE WHEN s < 0.6 THEN '<0.60' WHEN s < 0.7 THEN '0.60-<0.70' WHEN s < 0.85 THEN '0.70-<0.85' ELSE '>=0.85' END AS bin, a, b FROM x), "
    "v AS (SELECT * FROM (VALUES ('<0.60'), ('0.60-<0.70'), ('0.70-<0.85'), ('>=0.85')) t(bin)) SELECT bin, count(a) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b FROM v LEFT JOIN y USING (bin) GROUP BY bin",
)

# Windows, ranking and sampling.
register(
    "win6_fixed_split",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", S.stable_key(F.lit("13"), F.lit("split"), F.col("doc_id").cast("string")).alias("k")).select(
        "doc_id", F.when(F.substring("k", 1, 1) < "c", "train").when(F.substring("k", 1, 1) < "e", "validation").otherwise("test").alias("split")),
    "SELECT doc_id, CASE WHEN substr(k, 1, 1) < 'c' THEN 'train' WHEN substr(k, 1, 1) < 'e' THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, sha256('13|split|' || doc_id) AS k FROM documents)",
)
register(
    "win4_win7_hash_sample",
    lambda spark, sf_dir: sampling.first_by_hash(table(spark, sf_dir, "documents").select("doc_id"), "42", "doc_id", 100),
    "SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 100",
)


def win8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.priority_fill(d, (F.col("lang") == "es"), F.col("n_chars") > 3000, "doc_id", 3 * d.count() // 5, 0.4, "11").select("doc_id", "selection_bucket")


register(
    "win8_priority_fill", win8,
    """WITH d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'rare' WHEN n_chars > 3000 THEN 'aggregation' ELSE 'simple' END AS kind, n_chars > 3000 AS agg FROM documents),
    c AS (SELECT 3 * count(*) // 5 AS target, count(*) FILTER (WHERE kind = 'rare') AS r, count(*) FILTER (WHERE kind = 'aggregation') AS a, count(*) FILTER (WHERE kind = 'simple') AS s,
      count(*) FILTER (WHERE kind = 'rare' AND agg) AS ra FROM d),
    f AS (SELECT *, least(greatest(0, CAST(round_even(target * 0.4, 0) AS BIGINT) - ra), a, target - r) AS first FROM c),
    g AS (SELECT *, least(target - r - first, s) AS simple_n FROM f),
    k AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256('11|' || doc_id), doc_id) AS n FROM d),
    b AS (SELECT doc_id, CASE WHEN kind = 'rare' THEN 'rare_complexity' WHEN kind = 'aggregation' AND n <= first THEN 'aggregation_fill'
      WHEN kind = 'aggregation' AND n <= first + (target - r - first - simple_n) THEN 'extra_aggregation_fill' WHEN kind = 'simple' AND n <= simple_n THEN 'simple_fill' END AS selection_bucket FROM k, g)
    SELECT * FROM b WHERE selection_bucket IS NOT NULL""",
)
register(
    "win9_buckets_without_replacement",
    lambda spark, sf_dir: sampling.buckets_without_replacement(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id",
        [("long", F.col("n_chars") > 2000, F.col("n_chars"), 50), ("german", F.col("lang") == "de", F.col("n_chars"), 40), ("short", F.col("n_chars") < 800, -F.col("n_chars"), 30)], 150).select("doc_id", "selection_bucket"),
    "WITH a AS (SELECT doc_id, 'long' AS selection_bucket FROM documents WHERE n_chars > 2000 ORDER BY n_chars DESC, doc_id LIMIT 50), "
    "b AS (SELECT doc_id, 'german' AS selection_bucket FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n_chars DESC, doc_id LIMIT 40), "
    "c AS (SELECT doc_id, 'short' AS selection_bucket FROM documents WHERE n_chars < 800 AND doc_id NOT IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b) ORDER BY n_chars, doc_id LIMIT 30), "
    "u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), f AS (SELECT doc_id, 'fallback' AS selection_bucket FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u) ORDER BY doc_id LIMIT (150 - (SELECT count(*) FROM u))) SELECT * FROM u UNION ALL SELECT * FROM f",
)
register("win10_win13_stratified", lambda spark, sf_dir: sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 120, "strata"))


def win16(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return history.smoothed(e, ["user_id"], "event_id", "value", 0.1).withColumn("ema", F.round("ema", 6))


register(
    "win16_moving_average", win16,
    "WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), "
    "r AS (SELECT user_id, event_id, k, value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, 0.1 * o.value + 0.9 * r.ema FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, event_id, round(ema, 6) AS ema FROM r",
)
register(
    "win17_monotonic_steps",
    lambda spark, sf_dir: table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before")).groupBy("user_id").agg(
        F.bool_and(F.coalesce(F.col("ts") > F.col("before"), F.lit(True))).alias("increasing")),
    "SELECT user_id, bool_and(coalesce(ts > before, true)) AS increasing FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id",
)
register(
    "win18_summary_order",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.avg("quality").alias("ema")).select(
        "source", F.round("ema", 6).alias("ema"), F.row_number().over(Window.orderBy(F.col("ema").desc_nulls_first(), "source")).cast("long").alias("place")),
    "SELECT source, round(ema, 6) AS ema, row_number() OVER (ORDER BY ema DESC NULLS FIRST, source) AS place FROM (SELECT source, avg(quality) AS ema FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)",
)
register(
    "win19_best_of_group",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars")),
    "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1",
)


#: Rows of each transition that a review looks at first, and rows in all, by source.
REVIEW_QUOTAS, REVIEW_ROWS = {"01": 20, "10": 15, "00": 20, "11": 5}, 60


def win20(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = labelled(spark, sf_dir).select("doc_id", "source", F.concat(F.col("a").cast("string"), F.col("b").cast("string")).alias("transition"))
    return sampling.review_sample(pairs, "source", "transition", REVIEW_QUOTAS, "doc_id", REVIEW_ROWS, "review").withColumn("place", F.col("place").cast("long"))


register(
    "win20_review_sample", win20,
    f"""WITH {LAB}, q AS (SELECT * FROM (VALUES {', '.join(map(str, REVIEW_QUOTAS.items()))}) q(transition, quota)), k AS (SELECT doc_id, source, a::VARCHAR || b::VARCHAR AS transition, sha256('review|' || doc_id) AS k FROM lab),
    f AS (SELECT *, row_number() OVER (PARTITION BY source, transition ORDER BY k, doc_id) <= coalesce((SELECT quota FROM q WHERE q.transition = k.transition), 0) AS first FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first DESC, k, doc_id) AS place FROM f)
    SELECT doc_id, source, transition, place, CAST('0x' || substr(k, 64, 1) AS INTEGER) % 2 = 1 AS swapped FROM p WHERE place <= {REVIEW_ROWS}""",
)


def win15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source are preserved; a quarter as many others bring long documents to 40 %."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    held = d.where("source = 'src0'").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 3000).alias("long")).first()
    extra = held["n"] // 4
    found = sampling.extra_fill(d.where("source <> 'src0'"), F.col("n_chars") > 3000, "doc_id", extra, 0.4, held["n"] + extra, held["long"], "15")
    return found.select("doc_id", "selection_bucket")


register(
    "win15b_extra_fill", win15b,
    """WITH h AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 3000) AS long FROM documents WHERE source = 'src0'), c AS (SELECT doc_id, n_chars > 3000 AS agg FROM documents WHERE source <> 'src0'),
    t AS (SELECT n // 4 AS extra, least(greatest(0, CAST(round_even((n + n // 4) * 0.4::DOUBLE, 0) AS BIGINT) - long), n // 4, (SELECT count(*) FROM c WHERE agg)) AS first FROM h),
    s AS (SELECT *, least(extra - first, (SELECT count(*) FROM c WHERE NOT agg)) AS simple FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY agg ORDER BY sha256('15|' || doc_id), doc_id) AS k FROM c)
    SELECT doc_id, CASE WHEN agg AND k <= first THEN 'extra_aggregation_fill' ELSE 'extra_simple_fill' END AS selection_bucket FROM r, s WHERE CASE WHEN agg THEN k <= extra - simple ELSE k <= simple END""",
)

# History.
register(
    "his2_upsert",
    lambda spark, sf_dir: history.upsert(
        table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("loss"), F.when(F.col("event_type") != "click", F.col("value")).alias("reward")),
        ["user_id"], "event_id", ["loss", "reward"]),
    "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'click' AND value IS NOT NULL) AS loss, arg_max(value, event_id) FILTER (WHERE event_type <> 'click' AND value IS NOT NULL) AS reward FROM events GROUP BY user_id",
)
register(
    "his3_unpivot",
    lambda spark, sf_dir: history.long_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]),
    "SELECT l_orderkey, l_linenumber, metric, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value)",
)
NAN_ROWS = "log_value AS (SELECT event_type, CASE WHEN value > 0 THEN ln(value) WHEN value = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS v FROM events)"


def his45(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("value") > 0, F.log("value")).when(F.col("value") == 0, F.lit(float("-inf"))).when(F.col("value").isNotNull(), F.lit(float("nan"))).otherwise(F.lit(float("nan")))
    e = table(spark, sf_dir, "events").select("event_type", v.alias("v"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(history.finite(F.col("v")).isNull()).alias("non_finite"), F.round(F.avg(history.finite(F.col("v"))), 6).alias("mean"))


register(
    "his4_his5_non_finite", his45,
    f"WITH {NAN_ROWS} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE NOT isfinite(v)) AS non_finite, round(avg(v) FILTER (WHERE isfinite(v)), 6) AS mean FROM log_value GROUP BY 1",
)


def checkpoints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("user_id", "event_id"), e.where("event_type <> 'purchase'").select("user_id", "event_id", "value")


register(
    "jn11_as_of",
    lambda spark, sf_dir: history.last_at_or_before(checkpoints(spark, sf_dir)[1], checkpoints(spark, sf_dir)[0], "user_id", "event_id", "value"),
    "SELECT c.user_id, c.event_id, p.value FROM (SELECT * FROM events WHERE event_type = 'purchase') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase' AND value IS NOT NULL) p ON c.user_id = p.user_id AND c.event_id >= p.event_id",
)


def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps, updated by what their large items say: a new total, and how many there are."""
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"), "o_orderstatus")
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("step")).agg(F.round(F.sum("l_extendedprice"), 2).alias("loss"), F.count("*").alias("items"))
    return history.merge_by_step(steps, large, "step")


register(
    "jn12_merge_by_step", jn12,
    "SELECT o_orderkey AS step, coalesce(p, o_totalprice) AS loss, o_orderstatus, items FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS p, count(*) AS items FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON o_orderkey = l_orderkey",
)
register(
    "jn13_interval_assignment",
    lambda spark, sf_dir: history.intervals(checkpoints(spark, sf_dir)[1].select("user_id", "event_id"), checkpoints(spark, sf_dir)[0], "user_id", "event_id"),
    "SELECT p.user_id, p.event_id, c.event_id AS interval_end FROM (SELECT * FROM events WHERE event_type <> 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') c ON p.user_id = c.user_id AND p.event_id <= c.event_id",
)

# Validation.


def val1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.avg("a").alias("ema"), F.count_if(F.col("lang").isNull()).alias("nulls"))
    failures = F.array_compact(F.array(F.when(F.col("n") != F.col("ids"), "duplicate_id"), F.when(F.col("n") < 20, "too_few_rows"), F.when(F.col("ema") < 0.85, "low_ema"), F.when(F.col("nulls") > 0, "null_lang")))
    return s.select("source", F.array_join(failures, ",").alias("failures"), F.when(F.size(failures) == 0, "PASS").otherwise("FAIL").alias("status"))


register(
    "val1_run_validation", val1,
    f"WITH {LAB}, s AS (SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, avg(a) AS ema, count(*) FILTER (WHERE lang IS NULL) AS nulls FROM lab GROUP BY 1), "
    "f AS (SELECT source, concat_ws(',', CASE WHEN n <> ids THEN 'duplicate_id' END, CASE WHEN n < 20 THEN 'too_few_rows' END, CASE WHEN ema < 0.85 THEN 'low_ema' END, CASE WHEN nulls > 0 THEN 'null_lang' END) AS failures FROM s) SELECT source, failures, CASE WHEN failures = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM f",
)
register(
    "val4_metric_reproduction",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").agg(F.count_if(F.abs(F.col("n_chars") - F.char_length("text")) > 0).alias("mismatches"), F.count("*").alias("n")),
    "SELECT count(*) FILTER (WHERE abs(n_chars - length(text)) > 0) AS mismatches, count(*) AS n FROM documents",
)
CONFIGS = [("a", "k", "1"), ("a", "max_input", "2048"), ("a", "seed", "7"), ("b", "k", "3"), ("b", "max_input", "2048"), ("b", "gate", "0.7")]


def val6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(CONFIGS, "config string, k string, v string")
    a, b = c.where("config = 'a'").select("k", F.col("v").alias("left")), c.where("config = 'b'").select(F.col("k").alias("k2"), F.col("v").alias("right"))
    return a.join(b, F.col("k") == F.col("k2"), "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).select(F.coalesce("k", "k2").alias("key"), "left", "right")


register(
    "val6_sta10_config_diff", val6,
    f"WITH c AS (SELECT * FROM (VALUES {', '.join(map(str, CONFIGS))}) t(config, k, v)) SELECT coalesce(a.k, b.k) AS key, a.v AS \"left\", b.v AS \"right\" FROM (SELECT * FROM c WHERE config = 'a') a FULL JOIN (SELECT * FROM c WHERE config = 'b') b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v",
)
CONTROL_FLAGS = ("text", "lang", "source", "n_chars", "trimmed")


def val9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say the same but for white space and case, beside the first of them: five identities."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.trim("text").alias("trimmed"), F.md5(N.norm_q_lower(F.col("text"))).alias("k"))
    return validation.identities(dedup.first_wins(d, [F.col("k")], [F.col("doc_id")]), d, "k", "doc_id", CONTROL_FLAGS)


register(
    "val9_negative_control", val9,
    f"""WITH d AS (SELECT *, trim(text, ' ') AS trimmed, md5({sql_collapse('lower(text)')}) AS k FROM documents), o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1),
    p AS (SELECT {', '.join(f'd.{c} IS NOT DISTINCT FROM o.{c} AS {c}' for c in CONTROL_FLAGS)} FROM d JOIN o ON d.k = o.k AND d.doc_id <> o.doc_id)
    SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {c}) AS same_{c}' for c in CONTROL_FLAGS)}, coalesce(bool_and({' AND '.join(CONTROL_FLAGS)}), true) AS holds FROM p""",
)
register(
    "src13_filename_parse",
    lambda spark, sf_dir: table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("run_"), F.lower("r_name"), F.lit("_20260102_030405.csv")).alias("f")).select(
        "r_regionkey", F.regexp_extract("f", r"^run_(.+)_(\d{8}_\d{6})\.csv$", 1).alias("adapter"), F.regexp_extract("f", r"^run_(.+)_(\d{8}_\d{6})\.csv$", 2).alias("stamp")),
    "SELECT r_regionkey, lower(r_name) AS adapter, '20260102_030405' AS stamp FROM region",
)
