"""Invented question and SQL cases, the same rows for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("id", "question", "gold_sql", "pred_sql", "schema_prompt", "raw_output")
SCHEMA = (
    "Database schema:\n\nTable: customer\nColumns: c_custkey, c_name, c_nationkey, c_acctbal\nPrimary key: c_custkey\n\nTable: nation\n"
    "Columns: n_nationkey, n_name\nPrimary key: n_nationkey\n\nForeign keys:\n- customer.c_nationkey -> nation.n_nationkey"
)
SHORT_SCHEMA = "Database schema:\n\nTable: part\nColumns: p_partkey, p_name, p_size"

ROWS = [
    ("s01", "How many customers are there per nation?", "SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY n_name;",
     "SELECT n_name, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY 2 DESC", SCHEMA, "Answer: SELECT 1;"),
    ("s02", "How many finished orders exist?", "SELECT count(*) FROM orders WHERE o_orderstatus='F';", "SELECT count(*) FROM orders WHERE o_orderstatus='O';", SHORT_SCHEMA,
     "<think>count them</think>\nSELECT count(*) FROM orders"),
    ("s03", "List the different market segments.", "SELECT DISTINCT c_mktsegment FROM customer", "SELECT c_mktsegment FROM customer", SCHEMA, "```sql\nSELECT c_mktsegment FROM customer;\n```"),
    ("s04", "Which parts were never ordered?", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem;", "SELECT p_partkey FROM part;", SHORT_SCHEMA, "<|assistant|>SELECT p_partkey FROM part"),
    ("s05", "Show the total price.", "SELECT sum(o_totalprice) FROM orders;", "SELECT sum(o_total) FROM orders;", None, None),
    ("s06", "What is the largest part, by size and name?", "SELECT p_name FROM part ORDER BY p_size DESC, p_name LIMIT 1 ;; ",
     "SELECT p_name FROM part WHERE p_size = (SELECT max(p_size) FROM part)", SHORT_SCHEMA, "plain text without a query"),
    ("s07", "Average balance of customers without orders, for each nation", "SELECT n.n_name, avg(c_acctbal) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
     "WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY n.n_name HAVING count(*) > 2", "SELECT avg(c_acctbal) FROM customer", SCHEMA, "</think> done"),
    ("s08", "Names like O'Brien;  or \"x\"", "select c_name from customer where c_name = 'O''Brien; Jr' and c_acctbal >= 10.5 or c_custkey <> 3", "SELECT c_name FROM customer -- all of them",
     SCHEMA, "Note that the query is SELECT"),
    ("s09", "", "", "", "", ""),
    ("s10", "Total number of rows in either table", "SELECT a FROM t1 UNION SELECT b FROM t2 UNION ALL SELECT c FROM db.t3", "DELETE FROM t1", "", "DROP TABLE t1;"),
    ("s11", "lowest  \t and highest price\nper order", "SELECT min(l_extendedprice), max(l_extendedprice), l_orderkey FROM lineitem GROUP BY l_orderkey",
     "SELECT l_orderkey, min(l_extendedprice) FROM lineitem GROUP BY l_orderkey; SELECT 2", None, "SELECT 1 FROM a; SELECT 2 FROM b"),
    ("s12", "Orders placed by customers of the nation Fráncé", "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE' LIMIT 10",
     "SELECT * FROM orders, customer WHERE o_custkey = c_custkey", SCHEMA, "sql: SELECT *\nFROM orders <|im_end|>"),
]


def _literal(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + value.replace("'", "''") + "'"


#: A CTE named ``cases`` for oracle texts.
CTE = f"cases({', '.join(COLUMNS)}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in ROWS) + ")"


def cases(spark: SparkSession) -> DataFrame:
    """The cases as a frame."""
    return spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLUMNS))
