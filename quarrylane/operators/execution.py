"""Executing SQL texts and comparing results as bags."""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators.lineage import settled

#: Rows beyond which a diagnostic execution is an error.
MAX_ROWS = 10_000


@dataclass(frozen=True)
class Execution:
    """Outcome of one statement: its rows as a frame, or the error text."""

    ok: bool
    rows: DataFrame | None
    error: str | None


def to_spark_sql(text: str) -> str:
    """The statement with the embedded engine's dialect rewritten outside quoted parts: ``==``, ``total``, ``group_concat``."""
    parts = re.split(r"('(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`)", text.strip().rstrip(";"))
    for i in range(0, len(parts), 2):
        parts[i] = parts[i].replace("==", "=")
        parts[i] = re.sub(r"(?i)\btotal\s*\(\s*([^()]*?)\s*\)", r"coalesce(sum(cast(\1 AS double)), 0.0D)", parts[i])
        parts[i] = re.sub(r"(?i)\bgroup_concat\s*\(\s*([^(),]*?)\s*\)", r"listagg(\1, ',')", parts[i])
    return "".join(parts)


#: Quoted parts and comments, and a column that is not in a subquery's rows.
_OPAQUE = re.compile(r"'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_NOT_IN = re.compile(r"(?i)(?:\b(?:where|and|or|not|on|having|when|then|else|select)\s+|[(,]\s*)((?:[a-z_]\w*\s*\.\s*)*[a-z_]\w*)\s+not\s+in\s*\((?=\s*(?:select|with)\b)")
#: Subqueries with these may give other rows when they run again.
_UNSTEADY = re.compile(r"(?i)\b(limit|fetch|tablesample|rand|randn|random|uuid|shuffle)\b")


def without_null_aware_joins(text: str) -> str:
    """The statement with ``column NOT IN (subquery)`` written as a search for the value and one count of the subquery's nulls.

    Spark sends a subquery under NOT IN to all tasks whole, however large it is; this
    form joins by a shuffle.  The result is that of NOT IN: true of no rows, unknown
    without a match if the column or one of the rows is null.
    """
    bare = _OPAQUE.sub(lambda m: " " * len(m[0]), text)
    found = _NOT_IN.search(bare)
    if not found:
        return text
    depth, end = 1, found.end()
    while depth and end < len(bare):
        depth += {"(": 1, ")": -1}.get(bare[end], 0)
        end += 1
    inner = text[found.end() : end - 1]
    rest = without_null_aware_joins(text[end:])
    if depth or _UNSTEADY.search(bare[found.end() : end]):
        return text[: found.end()] + inner + text[end - 1 : end] + rest
    column, rows = text[slice(*found.span(1))], f"({without_null_aware_joins(inner)}\n) AS _in_rows(_in_value)"
    state = f"SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(_in_value) = count(*) THEN 1 END FROM {rows}"
    search = f"SELECT 1 FROM (SELECT DISTINCT _in_value FROM {rows}) AS _in_values WHERE _in_value = {column}"
    return f"{text[: found.start(1)]}CASE WHEN EXISTS ({search}) THEN FALSE ELSE CASE ({state}) WHEN 0 THEN TRUE WHEN 1 THEN nullif({column} IS NOT NULL, FALSE) END END{rest}"


def statement(spark: SparkSession, text: str) -> DataFrame:
    """The statement's rows, without null-aware joins where its subqueries read no outer columns."""
    other = without_null_aware_joins(text)
    if other != text:
        try:
            return spark.sql(other)
        except AnalysisException:
            pass  # a subquery that reads outer columns, or the statement's own error
    return spark.sql(text)


def execute(spark: SparkSession, text: str | None, seconds: float | None = None, most: int | None = None) -> Execution:
    """Runs one statement over the session's views; errors, timeouts and too many rows become the error text.

    The statement runs as a job of its own tag, which a timer interrupts.  An empty
    text is not executable.
    """
    if not text or not text.strip().strip(";"):
        return Execution(False, None, "empty statement")
    if not re.match(r"(?is)\s*(select|with)\b", text):
        return Execution(False, None, "not a query")
    tag = f"statement-{id(text)}-{threading.get_ident()}"
    late = threading.Event()
    timer = threading.Timer(seconds, lambda: (late.set(), spark.sparkContext.cancelJobsWithTag(tag))) if seconds else None
    spark.sparkContext.addJobTag(tag)
    try:
        if timer:
            timer.start()
        rows = statement(spark, to_spark_sql(text))
        # Columns may repeat or clash in a result; bags only know their order.
        rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        if most is not None and rows.limit(most + 1).count() > most:
            return Execution(False, None, f"more than {most} rows")
        # Errors of evaluation come up here; what was computed is kept, so that a comparison runs nothing again.
        return Execution(True, settled(rows), None)
    except Exception as error:  # a statement's failure is a result here, whatever its kind
        return Execution(False, None, f"timeout (limit_seconds={seconds})" if late.is_set() else str(error).splitlines()[0])
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def match_strict(gold: DataFrame, pred: DataFrame) -> bool:
    """Equal bags with equal types: order does not count, repeats and nulls do."""
    kinds = [[t for _, t in d.dtypes] for d in (gold, pred)]
    return kinds[0] == kinds[1] and gold.exceptAll(pred).isEmpty() and pred.exceptAll(gold).isEmpty()


def match_loose(gold: DataFrame, pred: DataFrame) -> bool:
    """Equal bags after numbers are made doubles and everything else strings."""
    if len(gold.columns) != len(pred.columns):
        return False
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
    plain = lambda d: d.select(*[F.col(c).cast("double" if t.startswith(numeric) else "string").alias(c) for c, t in d.dtypes])
    return match_strict(plain(gold), plain(pred))


def rescore(spark: SparkSession, cases: list[tuple[str, str, str]], seconds: float | None = None) -> list[dict]:
    """For (id, gold, pred) cases: executability and both matches; each statement runs once."""
    done: dict[str, Execution] = {}
    out = []
    for key, gold, pred in cases:
        for text in (gold, pred):
            if text not in done:
                done[text] = execute(spark, text, seconds)
        g, p = done[gold], done[pred]
        both = g.ok and p.ok
        out.append(
            {
                "id": key, "gold_ok": g.ok, "pred_ok": p.ok, "pred_error": p.error,
                "strict": both and match_strict(g.rows, p.rows), "loose": both and match_loose(g.rows, p.rows),
            }
        )
    return out
