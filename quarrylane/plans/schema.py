"""Queries over schema texts, selection scores, reranking and taxonomy maps (FEA-8, 9, 13, 14, 16, 19; TAX-2, 4, 5; SRC-7, 14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions import normalize as N
from quarrylane.functions import schematext as T
from quarrylane.functions import selection
from quarrylane.functions import sqlfeatures as S
from quarrylane.operators import taxonomy
from quarrylane.plans import text as P
from quarrylane.plans.cases import CTE, cases
from quarrylane.plans.registry import register
from quarrylane.plans.relational import table
from quarrylane.sources import io

WORDS_OF = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
ENT = (
    "raw AS (SELECT id, question, gold_sql, schema_prompt, regexp_extract_all(schema_prompt, '(?m)^Table:\\s*(.+?)\\s*$', 1) AS ts, regexp_extract_all(schema_prompt, '(?m)^Columns:[ \\t]*(.*?)\\s*$', 1) AS cs FROM cases), "
    f"ent AS (SELECT id, {WORDS_OF.format('ts[i]')} AS t, list_filter(list_transform(string_split(cs[i], ','), lambda c: {WORDS_OF.format('c')}), lambda c: c <> '') AS cols FROM (SELECT id, ts, cs, unnest(range(1, len(ts) + 1)) AS i FROM raw))"
)
register(
    "fea13_schema_entities",
    lambda spark, sf_dir: cases(spark).select("id", F.explode(T.entities(F.col("schema_prompt"))).alias("e"), T.foreign_keys(F.col("schema_prompt")).cast("long").alias("foreign_keys")).select(
        "id", F.col("e.table").alias("tbl"), F.array_join("e.columns", "|").alias("cols"), "foreign_keys"),
    f"WITH {CTE}, {ENT} SELECT id, t AS tbl, array_to_string(cols, '|') AS cols, CAST(len(regexp_extract_all(schema_prompt, '(?m)^\\s*-.*->')) AS BIGINT) AS foreign_keys FROM ent JOIN cases USING (id)",
)
QW = "' ' || " + WORDS_OF.format("c.question") + " || ' '"
MATCHED = (
    f"m AS (SELECT c.id, list_sort(list_distinct(list(e.t) FILTER (WHERE (length(e.t) >= 3 AND (contains({QW}, ' ' || e.t || ' ') OR (NOT contains(e.t, ' ') AND (contains({QW}, ' ' || e.t || 's ') OR (e.t LIKE '_%y' AND contains({QW}, ' ' || regexp_replace(e.t, 'y$', 'ies') || ' ')) "
    f"OR (regexp_matches(e.t, '(s|x|z|ch|sh)$') AND contains({QW}, ' ' || e.t || 'es ')))))) OR len(list_filter(e.cols, lambda k: length(k) >= 5 AND k NOT IN ('id', 'name', 'type', 'date', 'year') AND contains({QW}, ' ' || k || ' '))) > 0))) AS tabs FROM cases c JOIN ent e USING (id) GROUP BY c.id)"
)


def fea14(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.trim(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}]+", " "))
    found = T.matched_tables(q, F.col("schema_prompt"))
    rows = cases(spark).where(F.size(T.tables(F.col("schema_prompt"))) > 0)
    return rows.select("id", F.array_join(found, ",").alias("tables"), T.target_joins(q, F.col("schema_prompt")).alias("bucket"))


register(
    "fea14_target_joins", fea14,
    f"WITH {CTE}, {ENT}, {MATCHED} SELECT id, coalesce(array_to_string(tabs, ','), '') AS tables, CAST(CASE WHEN len(tabs) >= 3 THEN 2 WHEN len(tabs) = 2 THEN 1 END AS INTEGER) AS bucket FROM m",
)


def fea16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark).withColumn("words", N.norm_q_words(F.col("question")))
    features = S.candidate_features(F.col("gold_sql"))
    joins = S.count_of(F.lower(N.blank_literals(F.col("gold_sql"))), r"\bjoin\b")
    target = F.when(F.col("words").contains("nation"), 1)
    return rows.select("id", F.round(S.rerank_adjustment(S.question_hints_v2(F.col("words")), features, joins, target, F.lit(100)), 6).alias("adjustment"))


QN = f"trim(regexp_replace({P.sql_fold('question')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
H2 = lambda words: f"regexp_matches({QN}, '\\b(?:{words})\\b')"
HI2, LO2, NEG2 = H2("maximum|max|highest|largest|greatest"), H2("minimum|min|lowest|smallest"), H2("without|never|not|no |except")
HINTS2 = P.sql_labels(
    [
        ("count", H2("how many|number of|count|counts|total number")), ("avg", H2("average|avg|mean")), ("sum", f"{H2('sum|summed')} OR ({H2('total')} AND NOT {H2('total number')})"),
        ("max", HI2), ("min", LO2), ("order_extreme", f"{HI2} OR {LO2} OR {H2('most|least|fewest')}"), ("group_by", H2("for each|per|each|grouped by|by every")),
        ("distinct", H2("distinct|different|unique")), ("negation", NEG2), ("nested_select", f"{NEG2} OR {H2('more than the average|less than the average|above average|below average')}"),
    ]
)


def _adjust() -> str:
    ask, has = (lambda n: f"list_contains(h, '{n}')"), (lambda n: f"list_contains(f, '{n}')")
    parts = [f"CASE WHEN {ask(n)} THEN CASE WHEN {has(n)} THEN {up}::DOUBLE ELSE -{down}::DOUBLE END ELSE 0 END" for n, (up, down) in S.ADJUST.items()]
    parts.append(f"CASE WHEN {ask('order_extreme')} THEN CASE WHEN {has('order_by_limit')} THEN 0.014::DOUBLE ELSE -0.014::DOUBLE END ELSE 0 END")
    parts.append(f"CASE WHEN {ask('negation')} THEN CASE WHEN list_has_any(f, ['not_in', 'exists', 'except', 'nested_select']) THEN 0.012::DOUBLE ELSE -0.012::DOUBLE END ELSE 0 END")
    parts.append(f"CASE WHEN {ask('nested_select')} AND {has('nested_select')} THEN 0.010::DOUBLE ELSE 0 END")
    parts.append("CASE WHEN contains(w, 'nation') THEN CASE abs(least(j, 2) - 1) WHEN 0 THEN 0.026::DOUBLE WHEN 1 THEN -0.014::DOUBLE ELSE -0.026::DOUBLE END ELSE 0 END")
    return " + ".join(parts)


register(
    "fea16_rerank_adjustment", fea16,
    f"WITH {CTE}, x AS (SELECT id, {QN} AS w, {HINTS2} AS h, {P.FEATS} AS f, {P.N_OF(P.B, chr(92) + 'bjoin' + chr(92) + 'b')} AS j FROM cases) SELECT id, round(greatest(-0.04, least({_adjust()}, 0.08)), 6) AS adjustment FROM x",
)
register(
    "fea11_question_hints_v2",
    lambda spark, sf_dir: cases(spark).select("id", S.question_hints_v2(N.norm_q_words(F.col("question"))).alias("hints")),
    f"WITH {CTE} SELECT id, {HINTS2} AS hints FROM cases",
)


def fea19(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.reduction(F.col("schema_prompt"), S.table_references(F.col("gold_sql")))
    return cases(spark).where("schema_prompt IS NOT NULL").select("id", r["reason"].alias("reason"), F.array_join(r["kept"], ",").alias("kept"))


register(
    "fea19_schema_reduction", fea19,
    f"WITH {CTE}, x AS (SELECT id, list_transform(regexp_extract_all(schema_prompt, '(?m)^Table:\\s*(.+?)\\s*$', 1), lambda t: lower(t)) AS have, {P.REFS} AS used FROM cases WHERE schema_prompt IS NOT NULL), "
    "y AS (SELECT *, CASE WHEN len(have) = 0 THEN 'no_schema_table_blocks' WHEN len(used) = 0 THEN 'no_sql_table_refs' WHEN len(list_filter(used, lambda u: NOT list_contains(have, u))) > 0 THEN 'unknown_sql_table_refs' ELSE '' END AS reason FROM x) "
    "SELECT id, reason, array_to_string(CASE WHEN reason = '' THEN list_filter(have, lambda t: list_contains(used, t)) ELSE have END, ',') AS kept FROM y",
)


def fea89(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = selection.selection_features(F.col("gold_sql"), F.length("id") + 1)
    flags = [c.alias(f"is_{n}") for n, c in selection.categories(f).items()]
    return cases(spark).select("id", *flags, *[selection.bucket_score(f, b).cast("long").alias(b) for b in selection.SCORES])


JC, W = P.V1["join_count"], P.WHERE
NT = f"len({P.REFS})"
COND = f"(CASE WHEN {W} = '' THEN 0 ELSE 1 + len(regexp_extract_all({W}, '\\b(?:and|or)\\b')) END)"
NC = "(length(id) + 1)"
WH = lambda p: f"regexp_matches({W}, '{p}')"
G = f"({JC} = 0 AND {NT} <= 1 AND NOT {P.V1['compound']} AND NOT {P.V1['nested_select']} AND {NC} >= 3 AND ({W} <> '' OR {P.PROJ} NOT IN ('', '*')))"
SEL = {
    "join_count": JC, "condition_count": COND, "column_count": NC, **{n: P.V1[n] for n in ("group_by", "having", "nested_select", "distinct")}, "set_operation": P.V1["compound"],
    "order_by_limit": f"({P.V1['order_by']} AND {P.V1['limit']})", "several_tables": f"{NT} > 1", "several_conditions": f"{COND} >= 2", "where": f"{W} <> ''", "join_positive": f"{JC} > 0",
    "joined_aggregation": f"({JC} > 0 AND {P.V1['any_aggregation']})", "joined_group": f"({JC} > 0 AND {P.V1['group_by']})", "joined_having": f"({JC} > 0 AND {P.V1['having']})",
    "has_and": WH(r"\band\b"), "has_or": WH(r"\bor\b"), "has_range": WH(r"<=|>=|<>|!=|<|>|\bbetween\b"), "has_like": WH(r"\blike\b"), "has_in": WH(r"\bin\b"),
    "filtered_min_max": f"({W} <> '' AND ({P.V1['min_agg']} > 0 OR {P.V1['max_agg']} > 0))", "filtered_count": f"({W} <> '' AND {P.V1['count_agg']} > 0)",
    "aggregation_no_group": f"({P.V1['any_aggregation']} AND NOT {P.V1['group_by']})", "order_without_limit": f"({P.V1['order_by']} AND NOT {P.V1['limit']})",
    "projection": f"{P.PROJ} NOT IN ('', '*')",
    "count_only_simple": f"({P.V1['count_agg']} > 0 AND NOT ({' OR '.join(P.V1[n] for n in ('group_by', 'having', 'nested_select', 'compound', 'order_by', 'limit'))}) AND {W} = '')",
    "schema_grounding": G, "no_join_negative": f"({G} AND ({W} <> '' OR {NC} >= 4))",
}
OR = lambda *names: "(" + " OR ".join(names) + ")"
CATS = {
    "hard_cases": OR("join_positive", "several_tables", "group_by", '"having"', "nested_select", "set_operation", "order_by_limit", '"distinct"'),
    "join_decision": OR("join_positive", "no_join_negative"),
    "difficult_filters": '"where" AND ' + OR("several_conditions", "has_and", "has_or", "has_range", "has_like", "has_in"),
    "schema_grounding": "schema_grounding",
    "other_relevant": OR("order_without_limit", "aggregation_no_group", "order_by_limit", '"distinct"', "filtered_min_max", "filtered_count"),
}


def _points(bucket: str) -> str:
    parts = [f'{w[0]} * least("{n}", {w[1]})' if isinstance(w, tuple) else f'{w} * CAST("{n}" AS INTEGER)' for n, w in selection.SCORES[bucket].items()]
    return f"CAST({' + '.join(parts)} AS BIGINT)"


register(
    "fea8_fea9_selection_scores", fea89,
    f"WITH {CTE}, s AS (SELECT id, {', '.join(f'{e} AS {chr(34)}{n}{chr(34)}' for n, e in SEL.items())} FROM cases) SELECT id, {', '.join(f'{e} AS is_{n}' for n, e in CATS.items())}, {', '.join(f'{_points(b)} AS {b}' for b in selection.SCORES)} FROM s",
)
register(
    "tax2_family_map",
    lambda spark, sf_dir: spark.createDataFrame([(k, f, taxonomy.COARSE.get(f)) for k, f in taxonomy.FAMILY_OF.items()], "label string, family string, coarse string").groupBy("family", "coarse").agg(F.count("*").alias("labels")),
    "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {repr(taxonomy.COARSE[f]) if f in taxonomy.COARSE else 'NULL'}, CAST({len(labels.split())} AS BIGINT))" for f, labels in taxonomy.FAMILIES.items()) + ") t(family, coarse, labels)",
)
register(
    "tax1_error_labels",
    lambda spark, sf_dir: taxonomy.long_labels(
        cases(spark).withColumn("labels", taxonomy.labels(F.col("gold_sql"), F.col("pred_sql"), F.col("raw_output"), F.lit(""))), "id", "labels"),
)
register(
    "tax4_copied_literals",
    lambda spark, sf_dir: cases(spark).select("id", F.array_join(taxonomy.copied_literals(F.col("pred_sql"), F.col("gold_sql"), F.lit("SELECT 1 WHERE a = 'o' OR b = 'O' AND c = 2 LIMIT 10")), ",").alias("copied")),
    f"WITH {CTE}, l AS (SELECT id, list_distinct(regexp_extract_all(lower(pred_sql), '''(?:''''|[^''])*''|\\b\\d+(?:\\.\\d+)?\\b')) AS p, list_distinct(regexp_extract_all(lower(gold_sql), '''(?:''''|[^''])*''|\\b\\d+(?:\\.\\d+)?\\b')) AS g FROM cases) "
    "SELECT id, array_to_string(list_sort(list_filter(p, lambda x: list_contains(['1', '''o''', '2', '10'], x) AND NOT list_contains(g, x))), ',') AS copied FROM l",
)
register(
    "tax5_alternative_formulations",
    lambda spark, sf_dir: cases(spark).select(
        "id", (N.norm_sql_taxonomy(F.col("gold_sql")) != N.norm_sql_taxonomy(F.col("pred_sql"))).alias("differs"),
        F.when(N.norm_sql_taxonomy(F.col("gold_sql")) == N.norm_sql_taxonomy(F.col("pred_sql")), "identical").otherwise("ALTERNATIVE_VALID_FORMULATION").alias("kind")),
    f"WITH {CTE}, n AS (SELECT id, lower(array_to_string(list_filter({P.TAXO_SQL('gold_sql')}, lambda t: t <> ';'), ' ')) AS g, lower(array_to_string(list_filter({P.TAXO_SQL('pred_sql')}, lambda t: t <> ';'), ' ')) AS p FROM cases) "
    "SELECT id, g <> p AS differs, CASE WHEN g = p THEN 'identical' ELSE 'ALTERNATIVE_VALID_FORMULATION' END AS kind FROM n",
)
register(
    "src7_retrieval_pool",
    lambda spark, sf_dir: io.retrieval_pool(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.col("text").alias("question"), F.col("source").alias("query"), F.col("lang").alias("context")), "i").select(
        "id", F.md5("question").alias("question_md5"), "gold_sql", "schema_prompt"),
    "SELECT printf('RET_%06d', doc_id) AS id, md5(trim(text)) AS question_md5, source AS gold_sql, lang AS schema_prompt FROM documents WHERE trim(text) <> ''",
)
register(
    "src14_chat_parts",
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<|im_start|>user\nQuestion: "), F.lower("role"), F.lit("<|im_end|>\n<|im_start|>assistant\n"), F.md5("text"), F.lit("<|im_end|>")).alias("t")).select(
        "conv_id", "turn", io.chat_parts(F.col("t"))[0].alias("question"), io.chat_parts(F.col("t"))[1].alias("answer")),
    "SELECT conv_id, turn, lower(role) AS question, md5(text) AS answer FROM conversations",
)
