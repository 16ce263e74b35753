"""Queries over validation, catalogs and executed statements (SRC-5, SRC-9, VAL-2, FLT-7, FLT-8, EXE-1 to EXE-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import execution, validation
from quarrylane.plans.execution import SUITE, SUITE_SQL, TABLES, register_views
from quarrylane.plans.registry import register
from quarrylane.plans.relational import table
from quarrylane.sources import catalog

PRIMARY = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
FOREIGN = {"nation": [("n_regionkey", "region.r_regionkey")], "customer": [("c_nationkey", "nation.n_nationkey")], "orders": [("o_custkey", "customer.c_custkey")]}


def schema_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, block) of the star schema, read from the session's catalog."""
    register_views(spark, sf_dir)
    tables = catalog.catalog_tables(spark, list(TABLES), PRIMARY, FOREIGN)
    return spark.createDataFrame([(t.name, catalog.schema_block(t, True)) for t in tables], "table_name string, block string")


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


register(
    "src5_src6_catalog_schema_text", schema_texts,
    f"""WITH p AS (SELECT * FROM {_values([(t, ', '.join(k)) for t, k in PRIMARY.items()])} p(t, k)),
    f AS (SELECT * FROM {_values([(t, chr(10) + chr(10).join(f'- {t}.{a} -> {b}' for a, b in k)) for t, k in FOREIGN.items()])} f(t, k)),
    c AS (SELECT table_name, string_agg(column_name, ', ' ORDER BY ordinal_position) AS cols FROM information_schema.columns
      WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}) GROUP BY table_name)
    SELECT c.table_name, 'Table: ' || c.table_name || chr(10) || 'Columns: ' || cols || chr(10) || rtrim('Primary key: ' || coalesce(p.k, '')) || chr(10) || 'Foreign keys:' || coalesce(f.k, '') AS block
    FROM c LEFT JOIN p ON p.t = c.table_name LEFT JOIN f ON f.t = c.table_name""",
)


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vectors and the documents, as an index and its metadata, have equally many rows."""
    n, m = (table(spark, sf_dir, name).agg(F.count("*").alias(name)) for name in ("embeddings", "documents"))
    return n.crossJoin(m).select(F.col("embeddings").alias("n_index"), F.col("documents").alias("n_metadata"), (F.col("embeddings") == F.col("documents")).alias("equal"))


register(
    "src9_index_row_counts", index_rows,
    "SELECT n AS n_index, m AS n_metadata, n = m AS equal FROM (SELECT count(*) AS n FROM embeddings), (SELECT count(*) AS m FROM documents)",
)
register(
    "val2_split_report",
    lambda spark, sf_dir: validation.split_report(
        table(spark, sf_dir, "conversations"), ["conv_id", "role", "text"], "conv_id", F.col("role").isin("user", "assistant"), "1"
    ),
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE conv_id IS NULL) AS blank_conv_id, count(*) FILTER (WHERE coalesce(trim(role, ' '), '') = '') AS blank_role,
    count(*) FILTER (WHERE coalesce(trim(text, ' '), '') = '') AS blank_text, count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant')) AS other_split,
    count(*) FILTER (WHERE conv_id IS NULL OR NOT starts_with(CAST(conv_id AS VARCHAR), '1')) AS other_prefix,
    CAST(count(*) - count(DISTINCT conv_id) - max(CASE WHEN conv_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS repeated_ids FROM conversations""",
)
register("flt7_first_cases", lambda spark, sf_dir: validation.first_cases(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25),
         "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")

#: Settings and the number of rules that each breaks, counted by hand.
SETTINGS = [
    ("plain", {}, 0),
    ("no paths", {"testcases_path": "", "traincases_path": ""}, 2),
    ("static without a pool", {"prompt_tuning": "static_fewshot"}, 1),
    ("dynamic without files", {"prompt_tuning": "dynamic_fewshot"}, 2),
    ("reranked zero shot", {"retrieval_rerank_method": "sqlaware_topk"}, 1),
    ("gate without a threshold", {"prompt_tuning": "dynamic_fewshot", "retrieval_pool_path": "p", "retrieval_index_path": "i", "fewshot_gate_enabled": True}, 1),
    ("gate out of range", {"fewshot_gate_threshold": 2.5}, 1),
    ("three for a top two", {"prompt_tuning": "dynamic_fewshot", "retrieval_pool_path": "p", "retrieval_index_path": "i", "k": 3, "retrieval_rerank_method": "structure_topk_v2", "retrieval_rerank_top_n": 2}, 1),
    ("extractor", {"extractor_mode": "best"}, 1),
]


def settings_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, failures) of the settings."""
    checked = [(name, len(validation.setting_failures(validation.RunSettings(**{"testcases_path": "t", "traincases_path": "u"} | given)))) for name, given, _ in SETTINGS]
    return spark.createDataFrame(checked, "name string, failures int")


register("flt8_settings", settings_failures, f"SELECT name, CAST(failures AS INTEGER) AS failures FROM {_values([(n, f) for n, _, f in SETTINGS])} s(name, failures)")

#: (id, gold, pred, rows that may come) whose predictions fail in different ways, or differ by dialect only.
HARD = [
    ("h1", "SELECT sum(o_totalprice) FROM orders", "SELECT sum(o_total) FROM orders"),
    ("h2", "SELECT count(*) FROM region", ""),
    ("h3", "SELECT r_name FROM region", "DROP TABLE region"),
    ("h4", "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'", "SELECT count(*) FROM orders WHERE o_orderstatus == 'F';"),
    ("h5", "SELECT r_name FROM region", "SELECT r_name FRM region"),
    ("h6", "SELECT r_regionkey FROM region", "SELECT CAST(r_regionkey AS STRING) FROM region"),
    ("h7", "SELECT r_regionkey, r_name FROM region", "SELECT r_regionkey FROM region"),
]


def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of the suite and of the hard cases run once; bags of kept results compared."""
    register_views(spark, sf_dir)
    found = execution.rescore(spark, [*SUITE, *HARD], seconds=600)
    return spark.createDataFrame([(r["id"], r["gold_ok"], r["pred_ok"], r["strict"]) for r in found], "case_id string, gold_ok boolean, pred_ok boolean, strict boolean")


register(
    "exe2_exe6_rescored", rescored,
    f"""SELECT case_id, true AS gold_ok, true AS pred_ok, exec_match AS strict FROM ({SUITE_SQL})
    UNION ALL SELECT * FROM {_values([('h1', True, False, False), ('h2', True, False, False), ('h3', True, False, False), ('h4', True, True, True), ('h5', True, False, False),
                                      ('h6', True, True, False), ('h7', True, True, False)])} h(case_id, gold_ok, pred_ok, strict)""",
)


def row_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables a diagnostic execution reads within 100 rows."""
    register_views(spark, sf_dir)
    found = [(name, execution.execute(spark, f"SELECT * FROM {name}", most=100).ok) for name in TABLES]
    return spark.createDataFrame(found, "table_name string, within boolean")


register("exe3_row_cap", row_caps, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) <= 100 AS within FROM {t}" for t in TABLES))

DDL = "CREATE TABLE singer (id INT, name TEXT, age INT, PRIMARY KEY (id)); CREATE TABLE song (sid INT, singer_id INT, title TEXT, FOREIGN KEY (singer_id) REFERENCES singer (id))"
#: Statements over that schema and whether they compile.
COMPILED = [
    ("SELECT name FROM singer WHERE age > 30", True), ("SELECT count(*) FROM singer JOIN song ON singer.id = song.singer_id", True), ("SELECT title FROM album", False),
    ("SELECT title FROM singer", False), ("SELECT id FROM singer, song WHERE sid = 1 GROUP BY name", False), ("SELECT FROM WHERE", False),
]

register(
    "exe5_compile_only",
    lambda spark, sf_dir: spark.createDataFrame([(s, validation.compile_only(spark, DDL, s) is None) for s, _ in COMPILED], "statement string, compiles boolean"),
    f"SELECT statement, compiles FROM {_values(COMPILED)} c(statement, compiles)",
)
