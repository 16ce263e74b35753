"""Scans and sinks: JSON lines, JSON arrays, CSV as text, histories, logs, manifests, atomic and create-only writes."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarrylane.operators.lineage import settled

#: Fields of a training history.
HISTORY_FIELDS = (
    "step", "epoch", "loss", "eval_loss", "grad_norm", "learning_rate", "entropy", "num_tokens", "mean_token_accuracy", "train_runtime", "timestamp", "elapsed_seconds"
)
#: Aliases under which fields of a retrieval row may stand.
SQL_ALIASES, SCHEMA_ALIASES = ("gold_sql", "sql", "query"), ("schema_prompt", "context", "db_schema", "schema", "database_schema")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, all columns text, cells with line ends kept whole, blanks as empty texts."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(path).na.fill("")


def keyed(rows: DataFrame, id_: str = "id") -> DataFrame:
    """The same rows; a missing or repeated id is an error when they are read."""
    bad = rows.groupBy(id_).agg(F.count("*").alias("n")).where(F.col(id_).isNull() | (F.col(id_) == "") | (F.col("n") > 1))
    if not bad.isEmpty():
        raise ValueError(f"missing or repeated {id_}")
    return rows


def alias(columns: list[str], names: tuple[str, ...]) -> Column:
    """The first of the named columns that is not blank."""
    present = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in columns]
    return F.coalesce(*present, F.lit(None).cast("string"))


def retrieval_pool(rows: DataFrame, index: str) -> DataFrame:
    """Canonical retrieval rows: fields by alias, missing ids numbered, a row hash; rows without question or SQL are left out."""
    have = rows.columns
    question, sql, schema = alias(have, ("question",)), alias(have, SQL_ALIASES), alias(have, SCHEMA_ALIASES)
    key = F.coalesce(alias(have, ("id",)), F.format_string("RET_%06d", F.col(index)))
    out = rows.select(key.alias("id"), question.alias("question"), sql.alias("gold_sql"), schema.alias("schema_prompt"))
    return out.where("question IS NOT NULL AND gold_sql IS NOT NULL").withColumn("row_hash", F.sha2(F.to_json(F.struct("question", "gold_sql", "schema_prompt")), 256))


def run_files(spark: SparkSession, directory: str) -> DataFrame:
    """All run CSVs of a directory with adapter and time stamp from their names; broken files are skipped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreCorruptFiles", True).csv(directory)
    name = F.col("_metadata.file_name")
    return rows.select("*", F.regexp_extract(name, r"^run_(.+)_(\d{8}_\d{6})\.csv$", 1).alias("adapter"), F.regexp_extract(name, r"^run_(.+)_(\d{8}_\d{6})\.csv$", 2).alias("stamp"))


def chat_parts(text: Column) -> tuple[Column, Column]:
    """(question, SQL) of a serialised chat: the last user turn after ``Question:`` if it has one, and the last assistant turn."""
    user = F.regexp_extract(text, r"(?s).*<\|im_start\|>user\n(.*?)<\|im_end\|>", 1)
    answer = F.regexp_extract(text, r"(?s).*<\|im_start\|>assistant\n(.*?)(?:<\|im_end\|>|$)", 1)
    asked = F.regexp_extract(user, r"(?s)Question:\s*(.*)", 1)
    return F.trim(F.when(asked != "", asked).otherwise(user)), F.trim(answer)


def number(value: Column) -> Column:
    """A finite number, or null for blank or junk."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed) & (F.abs(parsed) != float("inf")), parsed)


def history_rows(rows: DataFrame) -> DataFrame:
    """History rows with exactly the known fields, numbers or null."""
    text = [F.col(f).cast("string") if f in rows.columns else F.lit(None).cast("string") for f in HISTORY_FIELDS]
    return rows.select(*[(c if f == "timestamp" else number(c)).alias(f) for f, c in zip(HISTORY_FIELDS, text)])


def trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """The exploded log history of a trainer state file."""
    entry = ", ".join(f"{f}: {'string' if f == 'timestamp' else 'double'}" for f in HISTORY_FIELDS)
    state = spark.read.schema(f"log_history array<struct<{entry}>>").option("multiLine", True).json(path)
    return history_rows(state.select(F.explode("log_history").alias("e")).select("e.*"))


def log_history(spark: SparkSession, path: str, steps_per_epoch: int | None = None) -> DataFrame:
    """History rows from the ``{...}`` literals of a log; without a step it comes from the epoch, else every tenth."""

    def parse(lines: pd.Series) -> pd.Series:
        def one(literal: str) -> str | None:
            try:
                found = ast.literal_eval(literal)
            except (ValueError, SyntaxError):
                return None
            return json.dumps({k: str(v) for k, v in found.items()}) if isinstance(found, dict) else None

        return lines.map(one)

    text = spark.read.text(path, wholetext=True)
    literals = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("place", "literal"))
    parsed = literals.select("place", F.from_json(F.pandas_udf(parse, StringType())("literal"), "map<string,string>").alias("m")).where("m IS NOT NULL")
    wide = parsed.select("place", *[F.col("m")[f].alias(f) for f in HISTORY_FIELDS])
    by_epoch = F.round(number(F.col("epoch")) * steps_per_epoch) if steps_per_epoch else F.lit(None).cast("double")
    step = F.coalesce(number(F.col("step")), by_epoch, (F.col("place") + 1) * 10.0)
    return history_rows(wide.withColumn("step", step))


def _files(spark: SparkSession, directory: str) -> list:
    """Hadoop statuses of what a directory holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(system.listStatus(path))


def _history_of_directory(spark: SparkSession, directory: str) -> DataFrame:
    """What a run's directory has: its CSV, else its JSON lines, else its latest log, else its latest trainer state; else no rows."""
    found = {f.getPath().getName(): f for f in _files(spark, directory)}
    for name in ("training_history.csv", "training_history.jsonl"):
        if name in found:
            return load_history(spark, f"{directory}/{name}")
    logs = sorted((f.getModificationTime(), name) for name, f in found.items() if name.endswith(".log"))
    if logs:
        return log_history(spark, f"{directory}/{logs[-1][1]}")
    places = [directory, *(f"{directory}/{name}" for name, f in found.items() if f.isDirectory())]
    states = sorted((f.getModificationTime(), f.getPath().toString()) for place in places for f in _files(spark, place) if f.getPath().getName() == "trainer_state.json")
    if states:
        return trainer_state(spark, states[-1][1])
    return history_rows(spark.createDataFrame([], "step double"))


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """A history by its suffix (of a file, or of a folder that Spark wrote), or what a run's directory has."""
    suffix = re.search(r"\.(\w+)$", path)
    kind = suffix.group(1).lower() if suffix else ""
    if kind == "csv":
        return history_rows(read_csv_text(spark, path))
    if kind == "jsonl":
        return history_rows(spark.read.json(path))
    if kind == "json":
        return trainer_state(spark, path)
    if kind in ("log", "txt", "out"):
        return log_history(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target) and system.getFileStatus(target).isDirectory():
        return _history_of_directory(spark, path.rstrip("/"))
    raise ValueError(f"no history reader for {path}")


def write_new(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Writes rows; an existing target is an error, and the commit protocol makes the write whole or nothing."""
    rows.write.mode("errorifexists").option("header", True).format(kind).save(path)


def write_all(frames: dict[str, DataFrame], kind: str = "json") -> None:
    """Writes several targets, none of which becomes visible before all are written.

    Each is written beside its target and then renamed, an older target being removed;
    if a write fails, what was written is removed and the targets stay as they were.
    """
    import uuid

    tag, done = uuid.uuid4().hex, []
    spark = next(iter(frames.values())).sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = lambda path: place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        for target, rows in frames.items():
            done.append(f"{target}.{tag}")
            rows.write.option("header", True).format(kind).save(done[-1])
        for target in frames:
            system(target).delete(place(target), True)
            if not system(target).rename(place(f"{target}.{tag}"), place(target)):
                raise OSError(f"cannot rename to {target}")
    finally:
        for path in done:
            system(path).delete(place(path), True)


def append_history(rows: DataFrame, directory: str) -> None:
    """Appends history rows as CSV and as JSON lines; they are computed once."""
    known = settled(history_rows(rows))
    append(known, f"{directory}/training_history.csv", "csv")
    append(known, f"{directory}/training_history.jsonl", "json")


def append(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Appends rows."""
    rows.write.mode("append").option("header", True).format(kind).save(path)


def union_of_columns(parts: list[DataFrame]) -> DataFrame:
    """All rows with the union of columns in the order in which they first appear."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def manifest(spark: SparkSession, paths: list[str], counts: dict[str, int]) -> DataFrame:
    """One row: counts, and path, size and SHA-256 of every file."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", "length", "sha256"))).alias("files"))
    return listed.select(F.lit(json.dumps(counts, sort_keys=True)).alias("counts"), "files")


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A small frame as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = [f"| {' | '.join(rows.columns)} |", f"|{' --- |' * len(rows.columns)}"]
    return "\n".join(head + [f"| {' | '.join(map(cell, r))} |" for r in rows.limit(most).collect()])
