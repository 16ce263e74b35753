"""Selection features of training rows and weighted bucket scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylane.functions.sqlfeatures import condition_count, count_only_simple, features_v1, is_projection, table_references, where_clause

#: Points of each bucket.  A number of a count has a cap, a flag has none.
SCORES = {
    "hard_cases": {
        "join_count": (12, 2), "several_tables": 8, "group_by": 8, "having": 10, "nested_select": 8, "set_operation": 8, "order_by_limit": 6, "distinct": 4,
        "joined_aggregation": 5, "several_conditions": 3, "column_count": (1, 8),
    },
    "join_decision": {
        "join_positive": 14, "no_join_negative": 8, "join_count": (5, 2), "joined_aggregation": 4, "joined_group": 4, "joined_having": 5, "where": 3, "column_count": (1, 10),
    },
    "difficult_filters": {"condition_count": (6, 4), "has_range": 5, "has_or": 5, "has_and": 3, "filtered_min_max": 3, "filtered_count": 3, "column_count": (1, 8)},
    "schema_grounding": {"where": 5, "column_count": (4, 8), "several_conditions": 2, "projection": 2},
    "other_relevant": {
        "order_without_limit": 6, "aggregation_no_group": 5, "filtered_min_max": 4, "filtered_count": 4, "distinct": 4, "order_by_limit": 3, "column_count": (1, 6),
    },
    "robustness_fill": {"where": 3, "column_count": (2, 8), "several_conditions": 2, "count_only_simple": -10},
}


def selection_features(sql: Column, schema_columns: Column) -> dict[str, Column]:
    """Counts and flags from which categories and scores are made."""
    f, where = features_v1(sql), where_clause(sql)
    joins, tables, conditions = f["join_count"], F.size(table_references(sql)), condition_count(where)
    filters, joined = where != "", joins > 0
    order_limit = f["order_by"] & f["limit"]
    grounded = ~joined & (tables <= 1) & ~f["compound"] & ~f["nested_select"] & (schema_columns >= 3) & (filters | is_projection(sql))
    return {
        "join_count": joins, "condition_count": conditions, "column_count": schema_columns, "group_by": f["group_by"], "having": f["having"],
        "nested_select": f["nested_select"], "distinct": f["distinct"], "set_operation": f["compound"], "order_by_limit": order_limit,
        "several_tables": tables > 1, "several_conditions": conditions >= 2, "where": filters, "join_positive": joined,
        "joined_aggregation": joined & f["any_aggregation"], "joined_group": joined & f["group_by"], "joined_having": joined & f["having"],
        "has_and": where.rlike(r"\band\b"), "has_or": where.rlike(r"\bor\b"), "has_range": where.rlike(r"<=|>=|<>|!=|<|>|\bbetween\b"),
        "has_like": where.rlike(r"\blike\b"), "has_in": where.rlike(r"\bin\b"), "filtered_min_max": filters & ((f["min_agg"] > 0) | (f["max_agg"] > 0)),
        "filtered_count": filters & (f["count_agg"] > 0), "aggregation_no_group": f["any_aggregation"] & ~f["group_by"], "order_without_limit": f["order_by"] & ~f["limit"],
        "projection": is_projection(sql), "count_only_simple": count_only_simple(sql), "schema_grounding": grounded,
        "no_join_negative": grounded & (filters | (schema_columns >= 4)),
    }


def categories(f: dict[str, Column]) -> dict[str, Column]:
    """Category flags."""
    any_of = lambda *names: F.greatest(*[f[n] for n in names])
    return {
        "hard_cases": any_of("join_positive", "several_tables", "group_by", "having", "nested_select", "set_operation", "order_by_limit", "distinct"),
        "join_decision": any_of("join_positive", "no_join_negative"),
        "difficult_filters": f["where"] & any_of("several_conditions", "has_and", "has_or", "has_range", "has_like", "has_in"),
        "schema_grounding": f["schema_grounding"],
        "other_relevant": any_of("order_without_limit", "aggregation_no_group", "order_by_limit", "distinct", "filtered_min_max", "filtered_count"),
    }


def bucket_score(f: dict[str, Column], bucket: str) -> Column:
    """Points of a bucket; an unknown bucket is an error."""
    if bucket not in SCORES:
        raise ValueError(f"unknown bucket {bucket}")
    points = F.lit(0)
    for name, weight in SCORES[bucket].items():
        if isinstance(weight, tuple):
            points = points + weight[0] * F.least(f[name], F.lit(weight[1]))
        else:
            points = points + weight * f[name].cast("int")
    return points
