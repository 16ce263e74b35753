"""Queries over review rules, run comparisons and identities (TAX-6, TAX-7, VAL-10, STA-7, STA-9, AGG-23, FEA-17, 18, 24, 26, 30, EXE-9, WIN-14, WIN-17)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions import normalize as N
from quarrylane.functions import schematext as T
from quarrylane.functions import sqlfeatures as S
from quarrylane.functions import textscan
from quarrylane.operators import overlap, splits, statistics, strata
from quarrylane.operators.lineage import settled
from quarrylane.plans import text as P
from quarrylane.plans.aggregates import LAB, TAIL, labelled
from quarrylane.plans.cases import CTE, cases
from quarrylane.plans.registry import register
from quarrylane.plans.relational import table


def tax6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    left = rows.where("a = 0").select("doc_id", F.col("lang").alias("family"))
    right = rows.where("b = 1").select("doc_id", F.col("lang").alias("family"))
    removed = left.join(right, ["doc_id", "family"], "left_anti").groupBy("family").agg(F.count_distinct("doc_id").alias("removed"))
    new = right.join(left, ["doc_id", "family"], "left_anti").groupBy("family").agg(F.count_distinct("doc_id").alias("introduced"))
    return removed.join(new, "family", "full_outer").fillna(0, ["removed", "introduced"])


register(
    "tax6_family_delta", tax6,
    f"WITH {LAB} SELECT lang AS family, count(DISTINCT doc_id) FILTER (WHERE a = 0 AND b <> 1) AS removed, count(DISTINCT doc_id) FILTER (WHERE b = 1 AND a <> 0) AS introduced FROM lab WHERE (a = 0 AND b <> 1) OR (b = 1 AND a <> 0) GROUP BY lang",
)


def tax7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.col("a") == 0, "QUALITY"), F.when(F.col("b") == 1, "TOXIC"), F.when(F.col("n_chars") > 8000, "HEURISTIC_ONLY")))
    rows = labelled(spark, sf_dir).withColumn("labels", found)
    uncertain, direct = F.array_contains("labels", "HEURISTIC_ONLY"), F.array_contains("labels", "TOXIC")
    status = F.when(uncertain, "AMBIGUOUS").when(F.size("labels") == 0, "INSUFFICIENT_EVIDENCE").otherwise("REVIEWED")
    confidence = F.when(status != "REVIEWED", "LOW").when(direct, "HIGH").otherwise("MEDIUM")
    priority = F.when(status != "REVIEWED", "HIGH").when(direct & (F.size("labels") <= 5), "LOW").otherwise("MEDIUM")
    return rows.groupBy(status.alias("status"), confidence.alias("confidence"), priority.alias("priority")).agg(F.count("*").alias("n"))


register(
    "tax7_review_triage", tax7,
    f"WITH {LAB}, x AS (SELECT *, CASE WHEN n_chars > 8000 THEN 'AMBIGUOUS' WHEN a <> 0 AND b <> 1 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'REVIEWED' END AS status FROM lab) "
    "SELECT status, CASE WHEN status <> 'REVIEWED' THEN 'LOW' WHEN b = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN status <> 'REVIEWED' THEN 'HIGH' WHEN b = 1 THEN 'LOW' ELSE 'MEDIUM' END AS priority, count(*) AS n FROM x GROUP BY ALL",
)


def val10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    plain = c.select("conv_id", "turn", F.md5(N.norm_q_lower(F.col("text"))).alias("a"))
    chat = c.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.md5(N.norm_q_lower(F.concat(F.lit(" "), F.col("text"), F.lit("\n")))).alias("b"))
    j = plain.join(chat, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "full_outer")
    return j.agg(F.count_if(F.col("c").isNull()).alias("only_plain"), F.count_if(F.col("conv_id").isNull()).alias("only_chat"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))


register(
    "val10_variant_alignment", val10,
    "SELECT count(*) FILTER (WHERE b.conv_id IS NULL) AS only_plain, count(*) FILTER (WHERE a.conv_id IS NULL) AS only_chat, count(*) FILTER (WHERE a.text = b.text) AS equal FROM conversations a FULL JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn",
)


def sta7(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = statistics.paired(labelled(spark, sf_dir), ["lang", "source"]).select("lang", "source", F.round("mcnemar_p", 12).alias("p"))
    by_model = statistics.holm(p, "p", ["source"], ["lang"]).withColumnRenamed("holm_p", "within_source")
    both = statistics.holm(by_model.withColumn("all", F.lit(1)), "p", ["all"], ["lang", "source"]).withColumnRenamed("holm_p", "global_p")
    return both.select("lang", "source", F.round("within_source", 9).alias("within_source"), F.round("global_p", 9).alias("global_p"), (F.col("global_p") < 0.05).alias("significant"))


register(
    "sta7_holm_families", sta7,
    f"WITH {LAB}, s AS (SELECT lang, source, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10 FROM lab GROUP BY ALL), p AS (SELECT lang, source, round({TAIL.format(n='n01', m='n10', none='1.0')}, 12) AS p FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, lang) AS k, count(*) OVER (PARTITION BY source) AS c, row_number() OVER (ORDER BY p, lang, source) AS kk, count(*) OVER () AS cc FROM p), "
    "h AS (SELECT lang, source, max(least(1.0, (c - k + 1) * p)) OVER (PARTITION BY source ORDER BY k) AS w, max(least(1.0, (cc - kk + 1) * p)) OVER (ORDER BY kk) AS g FROM r) SELECT lang, source, round(w, 9) AS within_source, round(g, 9) AS global_p, g < 0.05 AS significant FROM h",
)


def sta9(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = labelled(spark, sf_dir).groupBy("source").agg(F.avg("a").alias("rate"), F.count("*").alias("n"))
    o = m.select(F.col("source").alias("other"), F.col("rate").alias("other_rate"))
    delta = F.round(F.col("other_rate") - F.col("rate"), 9)
    return m.join(o, F.col("source") < F.col("other")).select("source", "other", delta.alias("delta"), F.when(delta > 0, "better").when(delta < 0, "worse").otherwise("equal").alias("direction"))


register(
    "sta9_pairwise_comparison", sta9,
    f"WITH {LAB}, m AS (SELECT source, avg(a) AS rate FROM lab GROUP BY 1), d AS (SELECT x.source, y.source AS other, round(y.rate - x.rate, 9) AS delta FROM m x JOIN m y ON x.source < y.source) SELECT *, CASE WHEN delta > 0 THEN 'better' WHEN delta < 0 THEN 'worse' ELSE 'equal' END AS direction FROM d",
)
register(
    "agg23_completion_diagnostics",
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.sum(F.char_length("text")).alias("characters"), F.max(F.char_length("text")).cast("long").alias("longest"), F.round(F.avg(F.char_length("text")), 6).alias("mean"),
        F.count_if(F.col("text").rlike(r"```|<think")).alias("artefacts")),
    "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean, count(*) FILTER (WHERE regexp_matches(text, '```|<think')) AS artefacts FROM conversations GROUP BY role",
)


def fea17(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.transform(T.entities(F.col("schema_prompt")), lambda e: F.concat(e["table"], F.lit(":"), F.array_join(F.array_sort(e["columns"]), ","))))
    return cases(spark).where("schema_prompt IS NOT NULL").select("id", F.sha2(F.array_join(parts, ";"), 256).alias("signature"))


register(
    "fea17_schema_signature", fea17,
    f"""WITH {CTE}, raw AS (SELECT id, regexp_extract_all(schema_prompt, '(?m)^Table:\\s*(.+?)\\s*$', 1) AS ts, regexp_extract_all(schema_prompt, '(?m)^Columns:[ \\t]*(.*?)\\s*$', 1) AS cs FROM cases WHERE schema_prompt IS NOT NULL),
    p AS (SELECT id, list_transform(range(1, len(ts) + 1), lambda i: trim(regexp_replace(lower(ts[i]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ':' || array_to_string(list_sort(list_transform(string_split(cs[i], ','), lambda c: trim(regexp_replace(lower(c), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))), ',')) AS parts FROM raw)
    SELECT id, sha256(array_to_string(list_sort(parts), ';')) AS signature FROM p""",
)


def fea18(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = N.norm_q_lower(F.col("question")), N.norm_sql_nosemi(F.col("gold_sql"))
    return cases(spark).select(
        "id", F.concat(F.lit("cases#"), F.col("id")).alias("source_id"), F.trim("question").alias("question_exact"), q.alias("question_norm"), s.alias("sql_norm"),
        F.md5(F.concat_ws("|", q, s)).alias("pair_norm"), F.md5(F.concat_ws("|", F.coalesce("schema_prompt", F.lit("")), q)).alias("schema_question"))


register(
    "fea18_row_identity", fea18,
    f"WITH {CTE}, k AS (SELECT id, question, schema_prompt, {P.sql_collapse('lower(question)')} AS q, {P.sql_collapse(P.sql_nosemi('lower(gold_sql)'))} AS s FROM cases) "
    "SELECT id, 'cases#' || id AS source_id, trim(question) AS question_exact, q AS question_norm, s AS sql_norm, md5(q || '|' || s) AS pair_norm, md5(coalesce(schema_prompt, '') || '|' || q) AS schema_question FROM k",
)


def fea24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped outputs: the old and the new run of a case, ordered rules."""
    old, new = F.col("a") == 1, F.col("b") == 1
    late, repeated, limit = F.col("n_chars") > 4000, F.col("n_chars") % 7 == 0, F.col("n_chars") > 8000
    primary = (
        F.when(~old & new & late, "late_valid_completion").when(~old & new, "new_execution_match").when(limit & ~late, "still_truncated").when(repeated, "continued_repetition")
        .when(limit, "still_truncated").when(~new, "semantic_error_without_repetition").otherwise("other")
    )
    return labelled(spark, sf_dir).groupBy(primary.alias("primary_class")).agg(F.count("*").alias("n"))


register(
    "fea24_capped_outputs", fea24,
    f"WITH {LAB} SELECT CASE WHEN a <> 1 AND b = 1 AND n_chars > 4000 THEN 'late_valid_completion' WHEN a <> 1 AND b = 1 THEN 'new_execution_match' WHEN n_chars % 7 = 0 THEN 'continued_repetition' WHEN n_chars > 8000 THEN 'still_truncated' "
    "WHEN b <> 1 THEN 'semantic_error_without_repetition' ELSE 'other' END AS primary_class, count(*) AS n FROM lab GROUP BY 1",
)


def fea26(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    counted = d.groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    by = Window.partitionBy("lang")
    placed = counted.withColumn("upto", F.sum("c").over(by.orderBy("n_chars"))).withColumn("n", F.sum("c").over(by))
    at = lambda k: F.bround((F.col("n") - 1) * k / 4).cast("long")
    cut = lambda k: F.max(F.when((at(k) >= F.col("upto") - F.col("c")) & (at(k) < F.col("upto")), F.col("n_chars"))).alias(f"cut{k}")
    cuts = placed.groupBy(F.col("lang").alias("l")).agg(*map(cut, (1, 2, 3)))
    bins = sum(((F.col("n_chars") > F.col(f"cut{k}")).cast("int") for k in (1, 2, 3)), F.lit(0))
    return d.join(cuts, F.col("lang") == F.col("l")).groupBy("lang", bins.alias("bin")).agg(F.count("*").alias("n"))


register(
    "fea26_quantile_bins", fea26,
    "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), "
    "c AS (SELECT lang, list(n_chars ORDER BY i) FILTER (WHERE i IN (CAST(round_even((n - 1) * 1 / 4, 0) AS BIGINT), CAST(round_even((n - 1) * 2 / 4, 0) AS BIGINT), CAST(round_even((n - 1) * 3 / 4, 0) AS BIGINT))) AS cuts FROM r GROUP BY lang) "
    "SELECT lang, CAST(CAST(n_chars > cuts[1] AS INTEGER) + CAST(n_chars > cuts[2] AS INTEGER) + CAST(n_chars > cuts[3] AS INTEGER) AS INTEGER) AS bin, count(*) AS n FROM documents JOIN c USING (lang) GROUP BY ALL",
)


def fea30(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.structure(F.col("gold_sql"), F.col("schema_prompt"))
    rows = cases(spark).select("id", *[s[k].alias(k) for k in ("join_any", "join_count", "aggregation", "group_by", "order_by", "limit", "having", "subquery", "set_operation", "distinct", "sql_len_chars")])
    median = F.element_at(F.array_sort(F.collect_list("sql_len_chars").over(Window.partitionBy())), F.floor(F.count("*").over(Window.partitionBy()) / 2).cast("int") + 1)
    costs = {"order_by": 0.5, "limit": 0.5, "having": 2.0, "subquery": 2.0, "set_operation": 2.0, "distinct": 1.5}
    score = F.abs(F.col("join_count") - 1) * 3.0 + F.when(F.col("group_by"), 0.0).otherwise(1.5) + F.abs(F.col("sql_len_chars") - F.col("m")) / 100.0
    for name, cost in costs.items():
        score = score + F.when(F.col(name), cost).otherwise(0.0)
    return rows.withColumn("m", median).where("join_any AND aggregation").select("id", F.round(score, 6).alias("score")).orderBy("score", "id").limit(1)


V = P.STRUCT
register(
    "fea30_static_demonstration", fea30,
    f"WITH {CTE}, s AS (SELECT id, {', '.join(f'{V[k]} AS {chr(34)}{k}{chr(34)}' for k in ('join_any', 'join_count', 'aggregation', 'group_by', 'order_by', 'limit', 'having', 'subquery', 'set_operation', 'distinct', 'sql_len_chars'))} FROM cases), "
    "m AS (SELECT list_sort(list(sql_len_chars))[count(*) // 2 + 1] AS m FROM s) SELECT id, round(abs(join_count - 1) * 3.0::DOUBLE + CASE WHEN group_by THEN 0 ELSE 1.5::DOUBLE END + abs(sql_len_chars - m) / 100.0::DOUBLE + CASE WHEN order_by THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN \"limit\" THEN 0.5::DOUBLE ELSE 0 END "
    "+ CASE WHEN \"having\" THEN 2 ELSE 0 END + CASE WHEN subquery THEN 2 ELSE 0 END + CASE WHEN set_operation THEN 2 ELSE 0 END + CASE WHEN \"distinct\" THEN 1.5::DOUBLE ELSE 0 END, 6) AS score FROM s, m WHERE join_any AND aggregation ORDER BY score, id LIMIT 1",
)


def exe9(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").groupBy(F.least(F.ceil(F.col("n_chars") / 4), F.lit(2048)).cast("int").alias("length")).agg(F.count("*").alias("n"))
    found = splits.best_fit_packing({r["length"]: r["n"] for r in lengths.collect()}, 2048)
    return spark.createDataFrame([(found["packs"], found["examples"], found["boundaries"], found["fill"])], "packs long, examples long, boundaries long, fill double")


register("exe9_packing_statistics", exe9)


def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.md5(N.norm_q_lower(F.col("text"))).alias("question"), F.col("lang").alias("signature"))
    grouped = overlap.components(rows, ("question",))
    joined = rows.join(grouped.withColumnRenamed("id", "i"), F.col("id") == F.col("i"))
    forced = grouped.join(table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("p")), F.col("id") == F.col("p")).select("component")
    return splits.select_components(joined, "component", "signature", "id", 50, "split", forced).select("id", "component", "signature", "selected")


register("win14_component_split", win14)


def win15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty and forty documents as whole components, by language; those of low quality stay in training."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.md5(N.norm_q_lower(F.col("text"))).alias("question"), "lang", (F.col("n_chars") > 3000).alias("long"), (F.col("source") < "src4").alias("early"))
    grouped = settled(overlap.components(rows, ("question",)))
    joined = settled(rows.join(grouped.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i"))
    forced = grouped.join(table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("p")), F.col("id") == F.col("p")).select("component")
    features = {"long": F.col("long"), "early": F.col("early")}
    return strata.split_by_strata(joined, "component", "lang", features, {"retrieval": 60, "validation": 40}, "strata", forced).select("id", "component", "lang", "role")


register("win15_strata_split", win15)


def fea4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexer features of the gold statements."""
    names = {"join_count": "long", "join_bin": "string", "subquery": "boolean", "where_condition_count": "long", "literal_count": "long", "sql_token_length": "long",
             "selected_column_count": "long", "rare_complexity": "boolean", "complexity_class": "string"} | dict.fromkeys(FEA4_FLAGS, "boolean")

    def batch(sql: pd.Series, question: pd.Series) -> pd.DataFrame:
        # A null is empty; a statement with an open quote has no features.
        rows = [textscan.lexical_features(s or "", q or "", 0, 0) or {} for s, q in zip(sql, question)]
        return pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=list(names))

    found = F.pandas_udf(batch, ", ".join(f"`{n}` {t}" for n, t in names.items()))("gold_sql", "question")
    return cases(spark).select("id", found.alias("f")).select("id", "f.*")


#: Features that are flags, as conditions on an array ``t`` of lower-case tokens.
FEA4_FLAGS = {
    **{n: f"list_contains(t, '{n}')" for n in ("having", "limit", "distinct", "union", "intersect", "except", "like", "between", "where")},
    "in_operator": "list_contains(t, 'in')", "exists_operator": "list_contains(t, 'exists')", "group_by": "list_has_all(t, ['group', 'by'])", "order_by": "list_has_all(t, ['order', 'by'])",
    "null_check": "list_has_all(t, ['null', 'is'])", "comparison": "list_has_any(t, ['=', '==', '!=', '<>', '<', '>', '<=', '>='])", "set_operation": "list_has_any(t, ['union', 'intersect', 'except'])",
    "and_operator": "list_contains(w, 'and')", "or_operator": "list_contains(w, 'or')",
}


def _lexer_sql() -> str:
    pattern = textscan._TOKEN.pattern.replace("'", "''")
    n = lambda *words: f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in words)})))"
    joins, nested, sets = n("join"), f"{n('select')} > 1", f"{n('union', 'intersect', 'except')} > 0"
    rare = f"({joins} > 0 OR {nested} OR {sets} OR {n('group', 'having', 'order', 'limit', 'distinct')} > 0)"
    calls = "len(list_filter(range(1, len(t)), lambda i: t[i] IN ('count', 'sum', 'avg', 'min', 'max') AND t[i + 1] = '(')) > 0"
    listed = "t[list_position(t, 'select') + 1 : list_position(t, 'from') - 1]"
    return f"""WITH {CTE}, x AS (SELECT id, list_transform(regexp_extract_all(gold_sql, '{pattern}'), lambda x: lower(x)) AS t FROM cases),
    y AS (SELECT *, CASE WHEN list_contains(t, 'where') THEN t[list_position(t, 'where') + 1 :] ELSE [] END AS w FROM x)
    SELECT id, {joins} AS join_count, CASE WHEN {joins} > 1 THEN '2+' ELSE CAST({joins} AS VARCHAR) END AS join_bin, {nested} AS subquery, {', '.join(f'{c} AS "{n}"' for n, c in FEA4_FLAGS.items())},
    CASE WHEN len(w) > 0 THEN 1 + len(list_filter(w, lambda x: x IN ('and', 'or'))) ELSE 0 END AS where_condition_count, len(list_filter(t, lambda x: regexp_matches(x, '^[''"0-9]'))) AS literal_count,
    len(t) AS sql_token_length, CASE WHEN list_contains(t, 'select') AND list_contains(t, 'from') AND len({listed}) > 0 THEN 1 + len(list_filter({listed}, lambda x: x = ',')) ELSE 0 END AS selected_column_count,
    {rare} AS rare_complexity, CASE WHEN {joins} >= 2 OR {nested} OR {sets} OR {n('having')} > 0 THEN 'complex' WHEN {rare} OR {calls} THEN 'moderate' ELSE 'simple' END AS complexity_class FROM y"""


register("fea4_lexical_features", fea4, _lexer_sql())
