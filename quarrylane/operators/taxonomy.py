"""Rule-based error labels of predicted statements, as a table of rules.

A rule is a label, its evidence level and a condition on the context of one case.
Rules of a component compare the gold and the predicted statement's components; they
only apply if both are parsed.  The strongest evidence of a label is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quarrylane.functions.sqlparse import Components, components, repeated_generation, split_tokens, tokens

#: Labels by family, and families by coarse group.
FAMILIES = {
    "OUTPUT_CONTROL": "EMPTY_RAW_OUTPUT EMPTY_SQL_EXTRACTION NO_TERMINATING_SEMICOLON MULTIPLE_STATEMENTS MARKDOWN_OR_EXPLANATION THINK_MARKER REPETITIVE_GENERATION "
    "COMPLETION_LIMIT_REACHED TRUNCATED_SQL EXTRACTOR_FAILURE CHAT_TEMPLATE_ARTIFACT LONGER_OR_UNSTABLE_OUTPUT",
    "EXECUTION_SYNTAX": "SQL_PARSE_ERROR SQL_SYNTAX_ERROR SQLITE_EXECUTION_ERROR UNKNOWN_TABLE UNKNOWN_COLUMN AMBIGUOUS_COLUMN TYPE_OR_FUNCTION_ERROR OTHER_EXECUTION_ERROR",
    "SCHEMA_LINKING": "WRONG_TABLE MISSING_TABLE EXTRA_TABLE WRONG_COLUMN MISSING_COLUMN EXTRA_COLUMN WRONG_SCHEMA_LINK",
    "PROJECTION": "WRONG_SELECT_EXPRESSION MISSING_SELECT_EXPRESSION EXTRA_SELECT_EXPRESSION WRONG_SELECT_CARDINALITY WRONG_DISTINCT MISSING_DISTINCT EXTRA_DISTINCT",
    "AGGREGATION": "WRONG_AGGREGATION MISSING_AGGREGATION EXTRA_AGGREGATION WRONG_COUNT_TARGET WRONG_MIN_MAX WRONG_SUM_AVG",
    "JOIN": "MISSING_JOIN EXTRA_JOIN WRONG_JOIN_TABLE WRONG_JOIN_PATH WRONG_JOIN_CONDITION CARTESIAN_PRODUCT OVER_JOIN",
    "FILTER": "MISSING_WHERE_CONDITION EXTRA_WHERE_CONDITION WRONG_WHERE_COLUMN WRONG_OPERATOR WRONG_LITERAL_VALUE WRONG_LOGICAL_CONNECTOR WRONG_NEGATION "
    "WRONG_NULL_HANDLING WRONG_BETWEEN_OR_RANGE WRONG_LIKE_PATTERN DEMO_LITERAL_COPY",
    "GROUPING": "MISSING_GROUP_BY EXTRA_GROUP_BY WRONG_GROUP_BY MISSING_HAVING EXTRA_HAVING WRONG_HAVING",
    "ORDER_LIMIT": "MISSING_ORDER_BY EXTRA_ORDER_BY WRONG_ORDER_COLUMN WRONG_SORT_DIRECTION MISSING_LIMIT EXTRA_LIMIT WRONG_LIMIT_VALUE WRONG_ORDER_BY",
    "SUBQUERY_SET": "MISSING_SUBQUERY EXTRA_SUBQUERY WRONG_SUBQUERY WRONG_NESTING_LEVEL WRONG_CORRELATION MISSING_SET_OPERATION EXTRA_SET_OPERATION WRONG_SET_OPERATION "
    "WRONG_UNION WRONG_INTERSECT WRONG_EXCEPT DEMO_STRUCTURE_COPY",
    "RESULT_CARDINALITY": "WRONG_RESULT_CARDINALITY DUPLICATE_ROWS MISSING_ROWS EXTRA_ROWS WRONG_SCALAR_VS_LIST ORDER_ONLY_MISMATCH",
    "UNCLASSIFIED_REVIEW": "COMPLEX_MULTI_COMPONENT_ERROR PARSER_UNAVAILABLE PARSER_DISAGREEMENT HEURISTIC_ONLY MANUAL_REVIEW_REQUIRED UNCLASSIFIED",
    "ALTERNATIVE_VALID": "ALTERNATIVE_VALID_FORMULATION",
}
FAMILY_OF = {label: family for family, labels in FAMILIES.items() for label in labels.split()}
COARSE = {
    "OUTPUT_CONTROL": "Output/Control", "EXECUTION_SYNTAX": "Syntax/Execution", "SCHEMA_LINKING": "Schema/Structure", "JOIN": "Schema/Structure",
    "PROJECTION": "Semantic Query Logic", "AGGREGATION": "Semantic Query Logic", "FILTER": "Semantic Query Logic", "GROUPING": "Semantic Query Logic",
    "ORDER_LIMIT": "Semantic Query Logic", "SUBQUERY_SET": "Semantic Query Logic", "RESULT_CARDINALITY": "Semantic Query Logic", "UNCLASSIFIED_REVIEW": "Unclassified/Review",
}


@dataclass
class Case:
    """One case as the rules see it."""

    raw: str
    pred: str
    error: str
    tokens_used: int
    token_limit: int
    gold: Components
    found: Components


Rule = tuple[str, str, Callable[[Case], bool]]
_ERRORS = (
    ("SQL_SYNTAX_ERROR", r"syntax error|incomplete input|unrecognized token"),
    ("UNKNOWN_TABLE", "no such table"),
    ("UNKNOWN_COLUMN", "no such column"),
    ("AMBIGUOUS_COLUMN", "ambiguous column"),
    ("TYPE_OR_FUNCTION_ERROR", "function|datatype|type|misuse of aggregate"),
    ("OTHER_EXECUTION_ERROR", r"(?s)^(?!.*no sql extracted)"),
)


def _raw(pattern: str) -> Callable[[Case], bool]:
    return lambda c: re.search(pattern, c.raw, re.IGNORECASE) is not None


def _at_limit(c: Case) -> bool:
    return c.tokens_used == c.token_limit


OUTPUT_RULES: list[Rule] = [
    ("EMPTY_RAW_OUTPUT", "E1", lambda c: not c.raw.strip()),
    ("EMPTY_SQL_EXTRACTION", "E1", lambda c: not c.pred.strip()),
    ("EXTRACTOR_FAILURE", "E1", lambda c: not c.pred.strip() and bool(c.raw.strip())),
    ("NO_TERMINATING_SEMICOLON", "E1", lambda c: bool(c.pred.strip()) and not c.pred.rstrip().endswith(";")),
    ("MULTIPLE_STATEMENTS", "E1", lambda c: len(split_tokens(tokens(c.pred), ";")) > 1),
    ("MARKDOWN_OR_EXPLANATION", "E1", _raw(r"```|\bhere is\b|\bexplanation:(?!\w)")),
    ("THINK_MARKER", "E1", _raw("</?think>")),
    ("CHAT_TEMPLATE_ARTIFACT", "E1", _raw(r"<\|im_|<\|start_header_id\|>")),
    ("REPETITIVE_GENERATION", "E2", lambda c: repeated_generation(c.raw)),
    ("COMPLETION_LIMIT_REACHED", "E1", _at_limit),
    ("TRUNCATED_SQL", "E2", lambda c: _at_limit(c) and not (c.found.balanced and c.pred.strip())),
    ("SQL_PARSE_ERROR", "E1", lambda c: not c.found.parsed),
    ("MANUAL_REVIEW_REQUIRED", "E4", lambda c: not c.found.parsed),
    ("SQLITE_EXECUTION_ERROR", "E1", lambda c: bool(c.error)),
]


def _substitution(kind: str, name: str) -> Iterator[Rule]:
    """Rules on two sets: what is missing, what is extra, and both together."""
    gone = lambda c: getattr(c.gold, name) - getattr(c.found, name)
    new = lambda c: getattr(c.found, name) - getattr(c.gold, name)
    yield f"MISSING_{kind}", "E1", lambda c: bool(gone(c))
    yield f"EXTRA_{kind}", "E1", lambda c: bool(new(c))
    yield f"WRONG_{kind}", "E1", lambda c: bool(gone(c) and new(c))
    yield "WRONG_SCHEMA_LINK", "E2", lambda c: bool(gone(c) and new(c))


def _presence(kind: str, get: Callable[[Components], object], wrong: str | None = None, level: str = "E1") -> Iterator[Rule]:
    """Rules on a part that one statement has and the other lacks, or that differs."""
    yield f"MISSING_{kind}", "E1", lambda c: bool(get(c.gold)) and not get(c.found)
    yield f"EXTRA_{kind}", "E1", lambda c: bool(get(c.found)) and not get(c.gold)
    if wrong:
        yield wrong, level, lambda c: bool(get(c.gold)) and bool(get(c.found)) and get(c.gold) != get(c.found)


def _amount(kind: str, get: Callable[[Components], int]) -> Iterator[Rule]:
    """Rules on fewer and more of something."""
    yield f"MISSING_{kind}", "E1", lambda c: get(c.gold) > get(c.found)
    yield f"EXTRA_{kind}", "E1", lambda c: get(c.gold) < get(c.found)


def _differs(label: str, level: str, get: Callable[[Components], object]) -> Rule:
    return label, level, lambda c: get(c.gold) != get(c.found)


def _in_filter(label: str, level: str, get: Callable[[Components], object]) -> Rule:
    """Differences that count where both statements filter, but not alike."""
    return label, level, lambda c: bool(c.gold.texts["where"]) and bool(c.found.texts["where"]) and c.gold.texts["where"] != c.found.texts["where"] and get(c.gold) != get(c.found)


def _joins(c: Components) -> int:
    return c.words["join"]


COMPONENT_RULES: list[Rule] = [
    *_substitution("TABLE", "tables"),
    *_substitution("COLUMN", "columns"),
    _differs("WRONG_SELECT_CARDINALITY", "E1", lambda s: len(s.select)),
    *_amount("SELECT_EXPRESSION", lambda s: len(s.select)),
    _differs("WRONG_SELECT_EXPRESSION", "E2", lambda s: set(s.select)),
    _differs("WRONG_DISTINCT", "E1", lambda s: s.words["distinct"] > 0),
    *_presence("DISTINCT", lambda s: s.words["distinct"] > 0),
    _differs("WRONG_AGGREGATION", "E1", lambda s: s.aggregates),
    *_amount("AGGREGATION", lambda s: s.aggregates.total()),
    _differs("WRONG_COUNT_TARGET", "E2", lambda s: s.aggregates["count"]),
    _differs("WRONG_MIN_MAX", "E1", lambda s: (s.aggregates["min"], s.aggregates["max"])),
    _differs("WRONG_SUM_AVG", "E1", lambda s: (s.aggregates["sum"], s.aggregates["avg"])),
    *_amount("JOIN", _joins),
    ("OVER_JOIN", "E2", lambda c: _joins(c.found) > _joins(c.gold) and bool(c.found.tables - c.gold.tables)),
    ("WRONG_JOIN_CONDITION", "E2", lambda c: bool(_joins(c.gold) and _joins(c.found)) and c.gold.texts["on"] != c.found.texts["on"]),
    ("WRONG_JOIN_PATH", "E2", lambda c: bool(_joins(c.gold) and _joins(c.found)) and c.gold.tables != c.found.tables),
    *_presence("WHERE_CONDITION", lambda s: s.texts["where"]),
    _in_filter("WRONG_OPERATOR", "E1", lambda s: s.operators),
    _in_filter("WRONG_LITERAL_VALUE", "E1", lambda s: Counter(s.literals)),
    _in_filter("WRONG_LOGICAL_CONNECTOR", "E1", lambda s: (s.words["and"], s.words["or"])),
    _in_filter("WRONG_NEGATION", "E1", lambda s: s.words["not"]),
    _in_filter("WRONG_NULL_HANDLING", "E1", lambda s: s.words["null"] > 0),
    _in_filter("WRONG_BETWEEN_OR_RANGE", "E1", lambda s: s.words["between"] > 0),
    _in_filter("WRONG_LIKE_PATTERN", "E1", lambda s: s.words["like"] > 0),
    _in_filter("WRONG_WHERE_COLUMN", "E2", lambda s: s.columns),
    *_presence("GROUP_BY", lambda s: s.lists["group"], "WRONG_GROUP_BY"),
    *_presence("HAVING", lambda s: s.texts["having"], "WRONG_HAVING", "E2"),
    *_presence("ORDER_BY", lambda s: s.lists["order"], "WRONG_ORDER_COLUMN"),
    _differs("WRONG_SORT_DIRECTION", "E1", lambda s: s.directions),
    *_presence("LIMIT", lambda s: s.texts["limit"], "WRONG_LIMIT_VALUE"),
    *_amount("SUBQUERY", lambda s: s.subqueries),
    _differs("WRONG_NESTING_LEVEL", "E1", lambda s: s.subqueries),
    _differs("WRONG_SET_OPERATION", "E1", lambda s: s.set_operations),
    *_amount("SET_OPERATION", lambda s: s.set_operations.total()),
    *[_differs(f"WRONG_{op.upper()}", "E1", lambda s, op=op: s.set_operations[op]) for op in ("union", "intersect", "except")],
]
#: Families that do not speak of a component of the statement.
_NO_COMPONENT = ("OUTPUT_CONTROL", "EXECUTION_SYNTAX", "RESULT_CARDINALITY", "UNCLASSIFIED_REVIEW")


def label_case(gold: str, pred: str, raw: str, error: str, tokens_used: int = 0, token_limit: int = 256, result_labels: list[str] = ()) -> dict[str, str]:
    """Evidence level by label of one failed case; result labels come from comparing executions."""
    case = Case(raw, pred, error, tokens_used, token_limit, components(gold), components(pred))
    fired = [(label, level) for label, level, holds in OUTPUT_RULES if holds(case)]
    if error:
        fired += [(label, "E1") for label, pattern in _ERRORS if re.search(pattern, error.lower())][:1]
    if case.gold.parsed and case.found.parsed:
        fired += [(label, level) for label, level, holds in COMPONENT_RULES if holds(case)]
    fired += [(label, "E1") for label in result_labels]
    labels: dict[str, str] = {}
    for label, level in fired:
        labels[label] = min(labels.get(label, level), level)
    if not labels:
        return {"UNCLASSIFIED": "E4", "MANUAL_REVIEW_REQUIRED": "E4"}
    if sum(FAMILY_OF[label] not in _NO_COMPONENT for label in labels) >= 4:
        labels |= {"COMPLEX_MULTI_COMPONENT_ERROR": "E3", "HEURISTIC_ONLY": "E3"}
    return labels


def result_labels(gold: list[tuple], pred: list[tuple]) -> list[str]:
    """Labels from two executed results, compared as typed bags and in order."""
    typed = lambda rows: [tuple((type(v).__name__, repr(v)) for v in row) for row in rows]
    g, p = typed(gold), typed(pred)
    bags = Counter(g), Counter(p)
    checks = {
        "WRONG_RESULT_CARDINALITY": len(g) != len(p),
        "WRONG_SCALAR_VS_LIST": (len(g) == 1) != (len(p) == 1),
        "MISSING_ROWS": bool(bags[0] - bags[1]),
        "EXTRA_ROWS": bool(bags[1] - bags[0]),
        "DUPLICATE_ROWS": len(bags[1]) < len(p),
        "ORDER_ONLY_MISMATCH": bags[0] == bags[1] and g != p,
    }
    return [label for label, holds in checks.items() if holds]


_LABELS = ArrayType(StructType([StructField("label", StringType()), StructField("level", StringType())]))


def labels(gold: Column, pred: Column, raw: Column, error: Column) -> Column:
    """Array of (label, level) structs of each failed case, sorted by label."""

    def batch(g: pd.Series, p: pd.Series, r: pd.Series, e: pd.Series) -> pd.Series:
        found = [label_case(*(v or "" for v in row)) for row in zip(g, p, r, e)]
        return pd.Series([[{"label": k, "level": v} for k, v in sorted(f.items())] for f in found])

    return F.pandas_udf(batch, _LABELS)(gold, pred, raw, error)


def long_labels(cases: DataFrame, id_: str, label_column: str) -> DataFrame:
    """(id, label, level, family, coarse): one row a label."""
    spark = cases.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, f, COARSE.get(f, "Alternative")) for k, f in FAMILY_OF.items()], "label string, family string, coarse string"))
    exploded = cases.select(id_, F.explode(label_column).alias("l")).select(id_, F.col("l.label").alias("label"), F.col("l.level").alias("level"))
    return exploded.join(table, "label", "left")


def transition(base_match: Column, tuned_match: Column, base_ok: Column, tuned_ok: Column) -> Column:
    """Subgroup of a paired case: repaired (T1), broken (T2), wrong twice (T3) or right twice (T4)."""
    both_fail = ~base_ok & ~tuned_ok
    return (
        F.when(tuned_match & ~base_match, F.when(base_ok, "T1b").otherwise("T1a")).when(base_match & ~tuned_match, F.when(tuned_ok, "T2b").otherwise("T2a"))
        .when(~base_match, F.when(both_fail, "T3a").otherwise("T3b")).otherwise("T4")
    )


def copied_literals(pred: Column, gold: Column, demos: Column) -> Column:
    """Literals of a prediction that are a demonstration's and not the gold statement's."""
    of = lambda sql: F.array_distinct(F.regexp_extract_all(F.lower(sql), F.lit(r"'(?:''|[^'])*'|\b\d+(?:\.\d+)?\b"), F.lit(0)))
    return F.array_sort(F.array_except(F.array_intersect(of(pred), of(demos)), of(gold)))
