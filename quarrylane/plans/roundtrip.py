"""Queries that write tables, read them back and compare (SRC-1 to SRC-4, SRC-10, SNK-1, SNK-2, SNK-4, SNK-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators.lineage import scratch, settled
from quarrylane.plans.registry import register
from quarrylane.plans.relational import table
from quarrylane.sources import io

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _kept(read: DataFrame, folder: str) -> DataFrame:
    """The rows that were read, on their own; the folder goes."""
    rows = settled(read)
    spark = read.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return rows


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines."""
    rows, folder = table(spark, sf_dir, "orders").select(*ORDERS), scratch(spark)
    io.write_new(rows, folder)
    return _kept(io.read_json_lines(spark, folder, ", ".join(f"{c} {t}" for c, t in rows.dtypes)), folder)


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one JSON array."""
    rows, folder = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), scratch(spark)
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(folder)
    return _kept(io.read_json_array(spark, folder, ", ".join(f"{c} {t}" for c, t in rows.dtypes)), folder)


def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as CSV: line ends and quotes in cells, all columns text."""
    rows, folder = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text"), scratch(spark)
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    return _kept(io.read_csv_text(spark, folder, rows.columns), folder).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in three parts to one history, as CSV and JSON lines; both read back by suffix and counted."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("double").alias("step"), "value", "event_type")
    for kind in ("click", "purchase", "error"):
        io.append_history(rows.where(F.col("event_type") == kind).select("step", F.col("value").alias("loss")), folder)
    found = [io.load_history(spark, f"{folder}/training_history.{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum("loss"), 4).alias("loss"), F.max("step").alias("last")) for kind in ("csv", "jsonl")]
    return _kept(found[0].unionByName(found[1]), folder)


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals written with others in one go, read back and held against the same totals computed another way."""
    folder = scratch(spark)
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    totals = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_order"))
    io.write_all({f"{folder}/totals": totals, f"{folder}/items": items.groupBy("l_orderkey").agg(F.count("*").alias("n_items"))})
    written = io.read_json_lines(spark, f"{folder}/totals", ", ".join(f"{c} {t}" for c, t in totals.dtypes))
    ranked = orders.join(items.select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    again = ranked.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.max("o_orderkey").alias("last_order"))
    both = written.exceptAll(again).agg(F.count("*").alias("only_written")).crossJoin(again.exceptAll(written).agg(F.count("*").alias("only_recomputed")))
    return _kept(both.withColumn("identical", (F.col("only_written") == 0) & (F.col("only_recomputed") == 0)), folder)


def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables have an id in every row, and none twice; a keyed read of the others raises."""
    keys = {"nation": "n_nationkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "labels": "doc_id", "conversations": "conv_id", "benchmark": "item_id"}

    def holds(name: str, key: str) -> bool:
        try:
            io.keyed(table(spark, sf_dir, name).select(F.col(key).cast("string").alias("id")))
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(name, holds(name, key)) for name, key in keys.items()], "table_name string, keyed boolean")


register("src1_snk1_json_lines", json_lines, f"SELECT {', '.join(ORDERS)} FROM orders")
register("src2_json_array", json_array, "SELECT n_nationkey, n_name FROM nation")
register("src3_csv_text", csv_text, "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text) AS text_md5 FROM conversations")
register(
    "src15_snk2_snk7_appended_history", appended,
    "SELECT kind, count(*) AS n, round(sum(value), 4) AS loss, CAST(max(event_id) AS DOUBLE) AS last FROM events, (VALUES ('csv'), ('jsonl')) k(kind) WHERE event_type IN ('click', 'purchase', 'error') GROUP BY kind",
)
register(
    "snk4_snk8_verify_recomputed", recomputed,
    """WITH w AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1), r AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1),
    c AS (SELECT (SELECT count(*) FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM r)) AS only_written, (SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM w)) AS only_recomputed)
    SELECT *, only_written = 0 AND only_recomputed = 0 AS identical FROM c""",
)
register(
    "src4_unique_ids", unique_ids,
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) = count(DISTINCT {k}) AS keyed FROM {t}" for t, k in
                       (("nation", "n_nationkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("labels", "doc_id"), ("conversations", "conv_id"), ("benchmark", "item_id"))),
)
