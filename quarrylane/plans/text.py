"""Queries over text and SQL functions (STR-*, FEA-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions import normalize as N
from quarrylane.functions import sqlfeatures as S
from quarrylane.plans.cases import CTE, cases
from quarrylane.plans.registry import register

SP = N.SPACE
DOCS = "{}/documents.parquet"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def over_cases(name: str, columns, oracle: str) -> None:
    """Registers a query of columns over the cases; the oracle is a SELECT list over ``cases``."""
    register(name, lambda spark, sf_dir: cases(spark).select("id", *columns()), f"WITH {CTE} SELECT id, {oracle} FROM cases")


def named(columns: dict) -> list:
    """Aliased columns; whole numbers as longs."""
    return [c.alias(n) for n, c in columns.items()]


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SP}+', ''), '{SP}+$', '')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def sql_semi(x: str) -> str:
    s = sql_strip(x)
    return f"(CASE WHEN {s} = '' OR {s} LIKE '%;' THEN {s} ELSE {s} || ';' END)"


def sql_nosemi(x: str) -> str:
    return f"regexp_replace({sql_strip(x)}, ';+{SP}*$', '')"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


over_cases("str1_ensure_semicolon", lambda: [N.ensure_semicolon(F.col("gold_sql")).alias("out")], f"{sql_semi('gold_sql')} AS out")

register(
    "str2_norm_questions",
    lambda spark, sf_dir: docs(spark, sf_dir).select(
        "doc_id",
        F.md5(N.norm_q_lower(F.col("text"))).alias("lower_md5"),
        F.md5(N.norm_q_casefold(F.col("text"))).alias("casefold_md5"),
    ),
    f"SELECT doc_id, md5({sql_collapse('lower(text)')}) AS lower_md5, md5({sql_collapse(sql_fold('text'))}) AS casefold_md5 FROM documents",
)
register(
    "str2_norm_questions_nfkc",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", N.norm_q_nfkc(F.col("text")).alias("nfkc"), N.norm_q_words(F.col("text")).alias("words")
    ),
    f"SELECT item_id, {sql_collapse(f'''regexp_replace({sql_fold('text')}, '[\\p{{P}}\\p{{S}}\\p{{Z}}]', ' ', 'g')''')} AS nfkc, "
    f"{sql_collapse(f'''regexp_replace({sql_fold('text')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')''')} AS words FROM benchmark",
)
over_cases(
    "str2_norm_sql",
    lambda: named(
        {
            "semi": N.norm_sql_semi(F.col("gold_sql")),
            "semi_cf": N.norm_sql_semi_cf(F.col("gold_sql")),
            "nosemi": N.norm_sql_nosemi(F.col("gold_sql")),
            "nosemi_cf": N.norm_sql_nosemi_cf(F.col("gold_sql")),
            "rstrip_semi": N.norm_sql_rstrip_semi(F.col("gold_sql")),
        }
    ),
    f"{sql_collapse(f'lower({sql_semi("gold_sql")})')} AS semi, {sql_collapse(sql_fold(sql_semi('gold_sql')))} AS semi_cf, "
    f"{sql_collapse(sql_nosemi('lower(gold_sql)'))} AS nosemi, {sql_collapse(sql_nosemi(sql_fold('gold_sql')))} AS nosemi_cf, "
    f"{sql_collapse("lower(regexp_replace(gold_sql, ';+$', '') || ';')")} AS rstrip_semi",
)
EVAL = N.EVAL_TOKEN.replace("'", "''")
TAXO = N.TAXONOMY_TOKEN.replace("'", "''")
EVAL_SQL = lambda x: f"list_transform(regexp_extract_all({x}, '{EVAL}'), lambda t: lower(t))"
TAXO_SQL = lambda x: f"list_filter(regexp_extract_all({x}, '{TAXO}'), lambda t: NOT (t LIKE '--%' OR t LIKE '/*%'))"
over_cases(
    "str3_eval_tokens",
    lambda: [F.array_join(N.eval_tokens(F.col("gold_sql")), "\n").alias("tokens"), N.norm_sql_tokens_eval(F.col("pred_sql")).alias("normalized")],
    f"array_to_string({EVAL_SQL('gold_sql')}, chr(10)) AS tokens, array_to_string({EVAL_SQL('pred_sql')}, ' ') AS normalized",
)
over_cases(
    "str4_taxonomy_tokens",
    lambda: [F.array_join(N.taxonomy_tokens(F.col("pred_sql")), "\n").alias("tokens"), N.norm_sql_taxonomy(F.col("gold_sql")).alias("normalized")],
    f"array_to_string({TAXO_SQL('pred_sql')}, chr(10)) AS tokens, "
    f"lower(array_to_string(list_filter({TAXO_SQL('gold_sql')}, lambda t: t <> ';'), ' ')) AS normalized",
)
LIT = N.LITERAL.replace("'", "''")
BLANK = lambda x: f"regexp_replace({x}, '{LIT}', ' ', 'g')"
EMPTY = lambda x: f"regexp_replace({x}, '{LIT}', '''''', 'g')"
over_cases(
    "str7_strip_literals",
    lambda: [N.blank_literals(F.col("gold_sql")).alias("blank"), N.empty_literals(F.col("gold_sql")).alias("empty")],
    f"{BLANK('gold_sql')} AS blank, {EMPTY('gold_sql')} AS empty",
)


def cleaned_output(text, cut: bool):
    """Model output without reasoning blocks, tags, chat tokens, fences and label lead-ins; ``cut`` keeps what follows a stray closing tag."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?</think>", "\n")
    if cut:
        text = F.when(text.rlike(r"(?i)</think\b[^>]*>"), F.regexp_extract(text, r"(?is)</think\b[^>]*>(.*)", 1)).otherwise(text)
    for pattern in (r"(?i)</?think\b[^>]*>", r"(?i)<\|(?:user|assistant|system)\|>|\|(?:user|assistant|system)\|>", r"(?i)<\|(?:im_start|im_end)\|>", r"(?i)```(?:sql)?"):
        text = F.regexp_replace(text, pattern, "\n")
    text = F.regexp_replace(text, r"(?im)^\s*(?:answer|response)\s*:\s*", "")
    text = F.regexp_replace(text, r"(?im)^\s*sql(?:\s+query)?\s*:\s*", "")
    return N.strip(text)


def sql_cleaned(x: str, cut: bool) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?is)<think\\b[^>]*>.*?</think>', chr(10), 'g')"
    if cut:
        x = f"CASE WHEN regexp_matches({x}, '(?i)</think\\b[^>]*>') THEN regexp_extract({x}, '(?is)</think\\b[^>]*>(.*)', 1) ELSE {x} END"
    for p in ("(?i)</?think\\b[^>]*>", "(?i)<\\|(?:user|assistant|system)\\|>|\\|(?:user|assistant|system)\\|>", "(?i)<\\|(?:im_start|im_end)\\|>", "(?i)```(?:sql)?"):
        x = f"regexp_replace({x}, '{p}', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?im)^\\s*(?:answer|response)\\s*:\\s*', '', 'g')"
    x = f"regexp_replace({x}, '(?im)^\\s*sql(?:\\s+query)?\\s*:\\s*', '', 'g')"
    return sql_strip(x)


over_cases(
    "str8_clean_output",
    lambda: [cleaned_output(F.col("raw_output"), True).alias("legacy"), cleaned_output(F.col("raw_output"), False).alias("robust")],
    f"{sql_cleaned('raw_output', True)} AS legacy, {sql_cleaned('raw_output', False)} AS robust",
)
over_cases(
    "str9_sanitize_answer",
    lambda: [
        N.strip(
            F.regexp_extract(F.regexp_replace(F.regexp_replace("raw_output", r"(?is)<think\b[^>]*>.*?</think>", " "), r"(?i)</?think\b[^>]*>", " "), r"(?is)\b(?:select|with)\b.*", 0)
        ).alias("out")
    ],
    sql_strip("regexp_extract(regexp_replace(regexp_replace(raw_output, '(?is)<think\\b[^>]*>.*?</think>', ' ', 'g'), '(?i)</?think\\b[^>]*>', ' ', 'g'), '(?is)\\b(?:select|with)\\b.*')") + " AS out",
)
over_cases(
    "str15_restart_marker",
    lambda: [F.regexp_replace(F.concat(F.lit("SELECT 1"), F.lit("\nQuestion: "), F.col("question")), r"(?is)(?<=.)\s*\n\s*(?:question|sql|example)\s*:.*$", "").alias("cut")],
    "'SELECT 1' AS cut",
)
over_cases(
    "str16_readonly",
    lambda: [
        F.coalesce(F.ltrim(F.col("raw_output")).rlike(r"(?i)^select") | F.ltrim(F.col("raw_output")).rlike(r"(?is)^with\s+(?:recursive\s+)?[a-z_][a-z0-9_]*\s+as\s*\(.*\bselect\b"), F.lit(False)).alias("readonly"),
        F.col("pred_sql").rlike(r"(?i)^\s*select").alias("pred_readonly"),
    ],
    "coalesce(starts_with(lower(ltrim(raw_output)), 'select') OR regexp_matches(ltrim(raw_output), '(?is)^with\\s+(?:recursive\\s+)?[a-z_][a-z0-9_]*\\s+as\\s*\\(.*\\bselect\\b'), false) AS readonly, "
    "starts_with(lower(ltrim(pred_sql)), 'select') AS pred_readonly",
)
DENY = ", ".join(f"'{d}'" for d in S.DENIED)
over_cases(
    "str17_statement_safety",
    lambda: [S.statement_safety(F.col("pred_sql")).alias("reason"), S.statement_safety(F.col("gold_sql")).isNull().alias("gold_safe")],
    """(SELECT CASE WHEN len(t) = 0 THEN 'empty_sql'
         WHEN len(list_filter(t, lambda x: x = ';')) > 1 OR (len(list_filter(t, lambda x: x = ';')) = 1 AND t[-1] <> ';') THEN 'multiple_statements'
         WHEN coalesce(list_filter(t, lambda x: regexp_matches(x, '^[a-z_]'))[1] NOT IN ('select', 'with'), true) THEN 'not_select_or_with'
         WHEN list_has_any(t, [DENY]) THEN 'denied_keyword:' || array_to_string(list_sort(list_intersect(list_distinct(t), [DENY])), ',') END
       FROM (SELECT list_transform(regexp_extract_all(pred_sql, TOK), lambda x: lower(x)) AS t)) AS reason,
       (SELECT len(t) > 0 AND coalesce(t[1] IN ('select', 'with'), false) AND NOT list_has_any(t, [DENY])
         AND (len(list_filter(t, lambda x: x = ';')) = 0 OR (len(list_filter(t, lambda x: x = ';')) = 1 AND t[-1] = ';'))
       FROM (SELECT list_transform(regexp_extract_all(gold_sql, TOK), lambda x: lower(x)) AS t)) AS gold_safe""".replace("DENY", DENY).replace("TOK", r"'''[^'']*''|[A-Za-z_][A-Za-z0-9_]*|[^\s]'"),
)
over_cases(
    "str18_reject_flags",
    lambda: [
        F.col("pred_sql").rlike(r"(?is)(?:=|\band\b|\bor\b|,|\+|\-|\*|/)\s*;?\s*$").alias("ends_with_operator"),
        F.col("raw_output").rlike(r"(?is)\b(?:but note|however|then|let's|we need|the query|the question)\b").alias("soft_contamination"),
    ],
    "regexp_matches(pred_sql, '(?is)(?:=|\\band\\b|\\bor\\b|,|\\+|\\-|\\*|/)\\s*;?\\s*$') AS ends_with_operator, "
    "regexp_matches(raw_output, '(?is)\\b(?:but note|however|then|let''s|we need|the query|the question)\\b') AS soft_contamination",
)
over_cases(
    "str22_identifiers",
    lambda: [
        F.regexp_replace(F.trim(F.col("id")), r'^["`\[]|["`\]]$', "").alias("cleaned"),
        F.element_at(F.split(F.concat(F.lit("db."), F.col("id")), r"\."), -1).alias("column_name"),
    ],
    "trim(id) AS cleaned, string_split('db.' || id, '.')[-1] AS column_name",
)
WHERE = (
    "trim(regexp_replace(regexp_extract(lower(EMPTY), '(?s)\\bwhere\\b(.+)', 1), '(?s)\\b(group\\s+by|having|order\\s+by|limit|union|intersect|except)\\b.*', ''))"
).replace("EMPTY", EMPTY("gold_sql"))
over_cases(
    "str24_where_clause",
    lambda: [S.where_clause(F.col("gold_sql")).alias("where_text"), S.condition_count(S.where_clause(F.col("gold_sql"))).cast("long").alias("conditions")],
    f"{WHERE} AS where_text, CAST(CASE WHEN {WHERE} = '' THEN 0 ELSE 1 + len(regexp_extract_all({WHERE}, '\\b(?:and|or)\\b')) END AS BIGINT) AS conditions",
)
REFS = f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower({EMPTY('gold_sql')}), '\\b(?:from|join)\\s+([a-z_][a-z0-9_.$]*)', 1), lambda t: string_split(t, '.')[-1]), lambda t: t NOT IN ('', 'select'))))"
over_cases(
    "str25_table_references",
    lambda: [F.array_join(S.table_references(F.col("gold_sql")), ",").alias("tables"), F.size(S.table_references(F.col("gold_sql"))).cast("long").alias("n_tables")],
    f"array_to_string({REFS}, ',') AS tables, CAST(len({REFS}) AS BIGINT) AS n_tables",
)
register(
    "str26_shorten",
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", S.shorten(N.collapse(F.col("text")), 240).alias("cell")),
    f"SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 237) || '...' END AS cell FROM (SELECT doc_id, {sql_collapse('text')} AS t FROM documents)",
)
register(
    "str27_duration",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.hms(F.abs("value") * 100).alias("hms")),
    "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS hms FROM (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) AS s FROM events)",
)
register(
    "str28_sha256",
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest")),
    "SELECT doc_id, sha256(text) AS digest FROM documents",
)
register(
    "str29_stable_integer",
    lambda spark, sf_dir: docs(spark, sf_dir).select(
        "doc_id", S.stable_integer(F.col("text")).alias("hash12"), S.stable_integer(F.col("text"), 8).alias("hash8")
    ),
    "SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 12) AS BIGINT) AS hash12, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) AS hash8 FROM documents",
)
register(
    "str30_stable_key",
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", S.stable_key(F.lit("42"), F.col("source"), F.col("doc_id").cast("string")).alias("k")),
    "SELECT doc_id, sha256('42|' || source || '|' || CAST(doc_id AS VARCHAR)) AS k FROM documents",
)

N_OF = lambda x, p: f"CAST(len(regexp_extract_all({x}, '{p}')) AS INTEGER)"
HAS = lambda x, p: f"regexp_matches({x}, '{p}')"
V1 = {
    "join_count": N_OF("lower(gold_sql)", r"\bjoin\b"),
    "group_by": HAS("lower(gold_sql)", r"\bgroup\s+by\b"),
    "having": HAS("lower(gold_sql)", r"\bhaving\b"),
    "nested_select": N_OF("lower(gold_sql)", r"\bselect\b") + " > 1",
    "order_by": HAS("lower(gold_sql)", r"\border\s+by\b"),
    "limit": HAS("lower(gold_sql)", r"\blimit\b"),
    "distinct": HAS("lower(gold_sql)", r"\bdistinct\b"),
    "union": HAS("lower(gold_sql)", r"\bunion\b"),
    "intersect": HAS("lower(gold_sql)", r"\bintersect\b"),
    "except": HAS("lower(gold_sql)", r"\bexcept\b"),
    "compound": HAS("lower(gold_sql)", r"\b(?:union|intersect|except)\b"),
    "any_aggregation": HAS("lower(gold_sql)", r"\b(?:count|avg|sum|min|max)\s*\("),
} | {f"{a}_agg": N_OF("lower(gold_sql)", rf"\b{a}\s*\(") for a in S.AGGREGATES}
over_cases("fea1_sql_features", lambda: named(S.features_v1(F.col("gold_sql"))), ", ".join(f'{e} AS "{n}"' for n, e in V1.items()))
V2 = {
    "join_count": V1["join_count"],
    "join_bucket": f"CASE {V1['join_count']} WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2+' END",
    "aggregation": V1["any_aggregation"],
    "group_by": "contains(lower(gold_sql), 'group by')",
    "having": "contains(lower(gold_sql), 'having')",
    "order_by": "contains(lower(gold_sql), 'order by')",
    "limit": V1["limit"],
    "distinct": V1["distinct"],
    "nested_select": HAS("lower(gold_sql)", r"\(\s*select\b"),
    "set_operation": V1["compound"],
}
LABEL = "array_to_string(list_filter(['joins=' || (" + V2["join_bucket"] + "), " + ", ".join(f"CASE WHEN {V2[n]} THEN '{n}' END" for n in S.LABEL_FLAGS) + "], lambda x: x IS NOT NULL), ', ')"
over_cases(
    "fea2_sql_features_label",
    lambda: [*named(S.features_v2(F.col("gold_sql"))), S.structure_label(S.features_v2(F.col("gold_sql"))).alias("label")],
    ", ".join(f'{e} AS "{n}"' for n, e in V2.items()) + f", {LABEL} AS label",
)
STRUCT = {
    "sql_len_chars": "CAST(length(gold_sql) AS INTEGER)", "sql_len_tokens": f"CAST(len(regexp_extract_all(gold_sql, '{EVAL}')) AS INTEGER)",
    "sql_table_count": f"CAST(len({REFS}) AS INTEGER)", "schema_table_count": N_OF("schema_prompt", r"(?m)^Table:\s+"), "join_count": V1["join_count"],
    "join_any": f"{V1['join_count']} > 0", "subquery": V1["nested_select"], "where_any": HAS("lower(gold_sql)", r"\bwhere\b"), "aggregation": V1["any_aggregation"],
    "group_by": V1["group_by"], "having": V1["having"], "order_by": V1["order_by"], "limit": V1["limit"], "distinct": V1["distinct"], "set_operation": V1["compound"],
} | {f"{a}_agg": V1[f"{a}_agg"] for a in S.AGGREGATES}
over_cases("fea6_structure", lambda: named(S.structure(F.col("gold_sql"), F.col("schema_prompt"))), ", ".join(f'{e} AS "{n}"' for n, e in STRUCT.items()))
RARE = "(" + " OR ".join([f"{V1['join_count']} > 0", *(V1[n] for n in ("group_by", "having", "nested_select", "order_by", "limit", "distinct", "compound"))]) + ")"
over_cases(
    "fea7_bucket",
    lambda: [S.rare_complexity(S.features_v1(F.col("gold_sql"))).alias("rare"), S.bucket(S.features_v1(F.col("gold_sql"))).alias("bucket")],
    f"{RARE} AS rare, CASE WHEN {RARE} THEN 'rare_complexity' WHEN {V1['any_aggregation']} THEN 'aggregation_only' ELSE 'simple' END AS bucket",
)
PROJ = f"trim(regexp_extract(lower({EMPTY('gold_sql')}), '(?s)\\bselect\\b(.+?)\\bfrom\\b', 1))"
over_cases(
    "fea10_projection_and_count",
    lambda: [S.is_projection(F.col("gold_sql")).alias("projection"), S.count_only_simple(F.col("gold_sql")).alias("count_only")],
    f"{PROJ} NOT IN ('', '*') AS projection, ({V1['count_agg']} > 0 AND NOT ({' OR '.join(V1[n] for n in ('group_by', 'having', 'nested_select', 'compound', 'order_by', 'limit'))}) AND {WHERE} = '') AS count_only",
)


def sql_labels(pairs: list[tuple[str, str]]) -> str:
    return "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)))"


Q1 = sql_collapse("lower(question)")
HINT = lambda words: f"regexp_matches({Q1}, '\\b(?:{words})\\b')"
HIGH, LOWEST = HINT("maximum|max|highest|largest|most"), HINT("minimum|min|lowest|smallest|least|fewest")
HINTS1 = sql_labels(
    [
        ("count", HINT("how many|number of|count|counts|total number")), ("avg", HINT("average|avg|mean")),
        ("sum", f"{HINT('sum|summed')} OR ({HINT('total')} AND NOT {HINT('total number')})"), ("max", HIGH), ("min", LOWEST),
        ("order_extreme", f"{HIGH} OR {LOWEST}"), ("group_by", HINT("for each|per|each")), ("distinct", HINT("distinct|different|unique")), ("negation", HINT("not|without|except")),
    ]
)
B = f"lower({BLANK('gold_sql')})"
FEATS = sql_labels(
    [
        *[(a, HAS(B, rf"\b{a}\s*\(")) for a in S.AGGREGATES], ("group_by", HAS(B, r"\bgroup\s+by\b")), ("having", HAS(B, r"\bhaving\b")), ("order_by", HAS(B, r"\border\s+by\b")),
        ("limit", HAS(B, r"\blimit\b")), ("order_by_limit", HAS(B, r"\border\s+by\b") + " AND " + HAS(B, r"\blimit\b")), ("distinct", HAS(B, r"\bdistinct\b")),
        ("join", N_OF(B, r"\bjoin\b") + " >= 1"), ("multi_join", N_OF(B, r"\bjoin\b") + " >= 2"), ("nested_select", N_OF(B, r"\bselect\b") + " >= 2"),
        ("exists", HAS(B, r"\bexists\s*\(")), ("not_in", HAS(B, r"\bnot\s+in\s*\(")), ("in", HAS(B, r"\bin\s*\(")), *[(s, HAS(B, rf"\b{s}\b")) for s in ("union", "intersect", "except")],
    ]
)
over_cases("fea11_question_hints", lambda: [S.question_hints_v1(F.col("question")).alias("hints")], f"{HINTS1} AS hints")
over_cases("fea12_candidate_features", lambda: [S.candidate_features(F.col("gold_sql")).alias("features")], f"{FEATS} AS features")
BOTH = lambda n: f"(list_contains(h, '{n}') AND list_contains(f, '{n}'))"
register(
    "fea15_sqlaware_bonus",
    lambda spark, sf_dir: cases(spark).select("id", F.round(S.sqlaware_bonus(S.question_hints_v1(F.col("question")), S.candidate_features(F.col("gold_sql"))), 6).alias("bonus")),
    f"WITH {CTE}, x AS (SELECT id, {HINTS1} AS h, {FEATS} AS f FROM cases) SELECT id, round(least(0.08, "
    + " + ".join(f"CASE WHEN {BOTH(n)} THEN {w}::DOUBLE ELSE 0 END" for n, w in S.BONUS.items())
    + " + CASE WHEN list_contains(h, 'order_extreme') AND list_contains(f, 'order_by_limit') THEN 0.012::DOUBLE ELSE 0 END"
    + " + CASE WHEN list_contains(h, 'negation') AND list_has_any(f, ['not_in', 'except', 'exists']) THEN 0.012::DOUBLE ELSE 0 END), 6) AS bonus FROM x",
)
register(
    "fea20_error_class",
    lambda spark, sf_dir: spark.createDataFrame([(i, e) for i, e in enumerate(ERRORS)], "i long, error string").select("i", S.error_class(F.col("error")).alias("class")),
    "SELECT CAST(i AS BIGINT) AS i, c AS class FROM (VALUES (0, 'no_error_text'), (1, 'no such column'), (2, 'no such table'), (3, 'syntax error'), (4, 'ambiguous column'), (5, 'other')) t(i, c)",
)
ERRORS = ["  ", "no such COLUMN: x (syntax error)", "No such table: t", 'near "FROM": syntax error', "ambiguous column name: id", "misuse of aggregate"]
register(
    "fea21_artifact_flags",
    lambda spark, sf_dir: cases(spark).select(
        "id",
        F.lower("raw_output").contains("</think>").alias("has_think_close"),
        F.lower("raw_output").contains("<|assistant|>").alias("has_assistant_tag"),
        F.col("raw_output").rlike(r"(?i)</think>|<think\b[^>]*>|<\|assistant\|>|<\|im_start\|>|<\|im_end\|>|```").alias("has_artifact"),
    ),
    f"WITH {CTE} SELECT id, contains(lower(raw_output), '</think>') AS has_think_close, contains(lower(raw_output), '<|assistant|>') AS has_assistant_tag, "
    "regexp_matches(raw_output, '(?i)</think>|<think\\b[^>]*>|<\\|assistant\\|>|<\\|im_start\\|>|<\\|im_end\\|>|```') AS has_artifact FROM cases",
)
WORDS = r"regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')"
register(
    "fea22_ngram_repetition",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/conversations.parquet")
    .withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    .select("conv_id", "turn", *[S.ngram_excess(F.col("w"), n)["excess"].cast("long").alias(f"excess{n}") for n in (1, 3, 5)], F.round(S.ngram_excess(F.col("w"), 3)["fraction"], 9).alias("fraction3")),
    f"""WITH w AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations),
    g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], chr(1))) AS g3, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], chr(1))) AS g5 FROM w)
    SELECT conv_id, turn, CAST(len(w) - len(list_distinct(w)) AS BIGINT) AS excess1, CAST(len(g3) - len(list_distinct(g3)) AS BIGINT) AS excess3,
    CAST(len(g5) - len(list_distinct(g5)) AS BIGINT) AS excess5, round(CASE WHEN len(g3) > 0 THEN (len(g3) - len(list_distinct(g3))) / len(g3) ELSE 0.0 END, 9) AS fraction3 FROM g""",
)
over_cases(
    "fea27_char_accuracy",
    lambda: [F.round(S.positional_accuracy(S.characters(F.col("pred_sql")), S.characters(F.col("gold_sql"))), 6).alias("char_accuracy")],
    "round(CASE WHEN greatest(length(pred_sql), length(gold_sql)) = 0 THEN 1.0 ELSE len(list_filter(range(1, least(length(pred_sql), length(gold_sql)) + 1), "
    "lambda i: substr(pred_sql, i, 1) = substr(gold_sql, i, 1))) / greatest(length(pred_sql), length(gold_sql)) END, 6) AS char_accuracy",
)
register(
    "fea28_token_accuracy",
    lambda spark, sf_dir: cases(spark).select("id", F.round(S.positional_accuracy(N.eval_tokens(F.col("pred_sql")), N.eval_tokens(F.col("gold_sql"))), 6).alias("token_accuracy")),
    f"WITH {CTE}, t AS (SELECT id, {EVAL_SQL('pred_sql')} AS p, {EVAL_SQL('gold_sql')} AS g FROM cases) SELECT id, round(CASE WHEN greatest(len(p), len(g)) = 0 THEN 1.0 "
    "ELSE len(list_filter(range(1, least(len(p), len(g)) + 1), lambda i: p[i] = g[i])) / greatest(len(p), len(g)) END, 6) AS token_accuracy FROM t",
)
over_cases(
    "fea29_exact_match",
    lambda: [
        (F.col("pred_sql") == F.col("gold_sql")).cast("int").alias("string_exact"),
        (N.norm_sql_tokens_eval(F.col("pred_sql")) == N.norm_sql_tokens_eval(F.col("gold_sql"))).cast("int").alias("normalized_exact"),
    ],
    f"CAST(pred_sql = gold_sql AS INTEGER) AS string_exact, CAST(array_to_string({EVAL_SQL('pred_sql')}, ' ') = array_to_string({EVAL_SQL('gold_sql')}, ' ') AS INTEGER) AS normalized_exact",
)
register(
    "fea25_similarity_bin",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.similarity_bin(F.abs(F.col("value")) % 1).alias("bin")),
    "SELECT event_id, CASE WHEN s < 0.6 THEN '<0.60' WHEN s < 0.7 THEN '0.60-<0.70' WHEN s < 0.85 THEN '0.70-<0.85' ELSE '>=0.85' END AS bin FROM (SELECT event_id, abs(value) % 1 AS s FROM events)",
)
register(
    "fea31_chat_rendering",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))), "")).alias("chat_md5")
    ),
    "SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text)) AS chat_md5 FROM conversations GROUP BY conv_id",
)
over_cases(
    "fea32_prompt_leak",
    lambda: [
        F.contains(N.norm_q_lower(F.concat_ws(" ", "question", "pred_sql")), N.norm_sql_nosemi(F.col("gold_sql"))).alias("leaks")
    ],
    f"contains({sql_collapse("lower(question || ' ' || pred_sql)")}, {sql_collapse(sql_nosemi('lower(gold_sql)'))}) AS leaks",
)
