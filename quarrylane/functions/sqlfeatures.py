"""Features of SQL texts and questions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylane.functions.normalize import blank_literals, empty_literals, eval_tokens, norm_q_lower

AGGREGATES = ("count", "avg", "sum", "min", "max")
#: Structure flags in the order of a structure label.
LABEL_FLAGS = ("aggregation", "group_by", "having", "order_by", "limit", "distinct", "nested_select", "set_operation")
#: Statements that may not run.
DENIED = (
    "insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach", "vacuum", "pragma", "begin", "commit", "rollback",
    "savepoint", "release", "reindex", "analyze",
)
#: Weights of matches between a question's hints and a candidate's features.
BONUS = {"count": 0.018, "sum": 0.018, "avg": 0.018, "min": 0.018, "max": 0.018, "group_by": 0.016, "distinct": 0.012}
BONUS_EXTREME, BONUS_NEGATION, BONUS_CAP = 0.012, 0.012, 0.08
#: Adjustments for hints met and missed.
ADJUST = {"count": (0.016, 0.018), "sum": (0.016, 0.018), "avg": (0.016, 0.018), "min": (0.016, 0.018), "max": (0.016, 0.018), "group_by": (0.014, 0.014), "distinct": (0.010, 0.010)}
ADJUST_EXTREME, ADJUST_NEGATION, ADJUST_NESTED = 0.014, 0.012, 0.010
ADJUST_JOIN = (0.026, -0.014, -0.026)
ADJUST_LONG_SCHEMA, LONG_SCHEMA, ADJUST_LOW = -0.008, 6000, -0.04


def count_of(text: Column, pattern: str) -> Column:
    """Matches of a pattern."""
    return F.regexp_count(text, F.lit(pattern))


def features_v1(sql: Column) -> dict[str, Column]:
    """Counts and flags on the lower-case text with its literals; a second SELECT anywhere counts as nested."""
    low = F.lower(sql)
    flag = lambda p: low.rlike(p)
    out = {
        "join_count": count_of(low, r"\bjoin\b"),
        "group_by": flag(r"\bgroup\s+by\b"),
        "having": flag(r"\bhaving\b"),
        "nested_select": count_of(low, r"\bselect\b") > 1,
        "order_by": flag(r"\border\s+by\b"),
        "limit": flag(r"\blimit\b"),
        "distinct": flag(r"\bdistinct\b"),
        "union": flag(r"\bunion\b"),
        "intersect": flag(r"\bintersect\b"),
        "except": flag(r"\bexcept\b"),
        "compound": flag(r"\b(union|intersect|except)\b"),
        "any_aggregation": flag(r"\b(count|avg|sum|min|max)\s*\("),
    }
    return out | {f"{a}_agg": count_of(low, rf"\b{a}\s*\(") for a in AGGREGATES}


def rare_complexity(f: dict[str, Column]) -> Column:
    """Any join, grouping, nesting, ordering, limit, distinct or set operation."""
    found = f["join_count"] > 0
    for name in ("group_by", "having", "nested_select", "order_by", "limit", "distinct", "compound"):
        found = found | f[name]
    return found


def bucket(f: dict[str, Column]) -> Column:
    """Three-way bucket of a statement."""
    return F.when(rare_complexity(f), "rare_complexity").when(f["any_aggregation"], "aggregation_only").otherwise("simple")


def features_v2(sql: Column) -> dict[str, Column]:
    """Flags with nesting as an opening parenthesis before SELECT, and exactly one space in two-word clauses."""
    low = F.lower(sql)
    joins = count_of(low, r"\bjoin\b")
    return {
        "join_count": joins,
        "join_bucket": F.when(joins == 0, "0").when(joins == 1, "1").otherwise("2+"),
        "aggregation": low.rlike(r"\b(count|avg|sum|min|max)\s*\("),
        "group_by": low.contains("group by"),
        "having": low.contains("having"),
        "order_by": low.contains("order by"),
        "limit": low.rlike(r"\blimit\b"),
        "distinct": low.rlike(r"\bdistinct\b"),
        "nested_select": low.rlike(r"\(\s*select\b"),
        "set_operation": low.rlike(r"\b(union|intersect|except)\b"),
    }


def structure_label(f: dict[str, Column]) -> Column:
    """``joins=`` bucket and the flags that are set, by commas."""
    flags = F.array(F.concat(F.lit("joins="), f["join_bucket"]), *[F.when(f[n], F.lit(n)) for n in LABEL_FLAGS])
    return F.array_join(F.array_compact(flags), ", ")


def structure(sql: Column, schema: Column) -> dict[str, Column]:
    """The structure record: lengths, tables, clauses and aggregates."""
    low = F.lower(sql)
    joins = count_of(low, r"\bjoin\b")
    flags = {
        "where_any": r"\bwhere\b", "aggregation": r"\b(count|avg|sum|min|max)\s*\(", "group_by": r"\bgroup\s+by\b", "having": r"\bhaving\b",
        "order_by": r"\border\s+by\b", "limit": r"\blimit\b", "distinct": r"\bdistinct\b", "set_operation": r"\b(union|intersect|except)\b",
    }
    return (
        {
            "sql_len_chars": F.char_length(sql),
            "sql_len_tokens": F.size(eval_tokens(sql)),
            "sql_table_count": F.size(table_references(sql)),
            "schema_table_count": count_of(schema, r"(?m)^Table:\s+"),
            "join_count": joins,
            "join_any": joins > 0,
            "subquery": count_of(low, r"\bselect\b") > 1,
        }
        | {name: low.rlike(p) for name, p in flags.items()}
        | {f"{a}_agg": count_of(low, rf"\b{a}\s*\(") for a in AGGREGATES}
    )


def table_references(sql: Column) -> Column:
    """Distinct lower-case names after FROM and JOIN, the last part of a dotted one, sorted."""
    found = F.regexp_extract_all(F.lower(empty_literals(sql)), F.lit(r"\b(?:from|join)\s+([a-z_][a-z0-9_.$]*)"), F.lit(1))
    last = F.transform(found, lambda t: F.element_at(F.split(t, r"\."), -1))
    return F.array_sort(F.array_distinct(F.filter(last, lambda t: ~t.isin("", "select"))))


def where_clause(sql: Column) -> Column:
    """Text after the first WHERE up to the next clause, literals emptied, lower case."""
    low = F.lower(empty_literals(sql))
    tail = F.regexp_extract(low, r"(?s)\bwhere\b(.+)", 1)
    return F.trim(F.regexp_replace(tail, r"(?s)\b(group\s+by|having|order\s+by|limit|union|intersect|except)\b.*", ""))


def condition_count(where: Column) -> Column:
    """One and the ANDs and ORs of a WHERE text, none of an empty one."""
    return F.when(where == "", 0).otherwise(1 + count_of(where, r"\b(and|or)\b"))


def is_projection(sql: Column) -> Column:
    """Something other than a star between SELECT and FROM."""
    picked = F.trim(F.regexp_extract(F.lower(empty_literals(sql)), r"(?s)\bselect\b(.+?)\bfrom\b", 1))
    return (picked != "") & (picked != "*")


def count_only_simple(sql: Column) -> Column:
    """A count with no grouping, nesting, compound, ordering, limit or WHERE."""
    f = features_v1(sql)
    plain = ~(f["group_by"] | f["having"] | f["nested_select"] | f["compound"] | f["order_by"] | f["limit"])
    return (f["count_agg"] > 0) & plain & (where_clause(sql) == "")


def statement_safety(sql: Column) -> Column:
    """Reason why a statement may not run, null if it may."""
    tokens = F.transform(F.filter(F.regexp_extract_all(sql, F.lit(r"'[^']*'|[A-Za-z_][A-Za-z0-9_]*|[^\s]"), F.lit(0)), lambda t: t != ""), F.lower)
    n = F.size(tokens)
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(t == ";", i)), lambda i: i.isNotNull())
    words = F.filter(tokens, lambda t: t.rlike("^[a-z_]"))
    denied = F.array_sort(F.array_intersect(words, F.array(*map(F.lit, DENIED))))
    return (
        F.when(n == 0, "empty_sql")
        .when((F.size(ends) > 1) | ((F.size(ends) == 1) & (F.get(ends, F.lit(0)) != n - 1)), "multiple_statements")
        .when(F.coalesce(~F.get(words, F.lit(0)).isin("select", "with"), F.lit(True)), "not_select_or_with")
        .when(F.size(denied) > 0, F.concat(F.lit("denied_keyword:"), F.array_join(denied, ",")))
    )


def _labels(*pairs: tuple[str, Column]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))))


def question_hints_v1(question: Column) -> Column:
    """Hints of a question; ``most`` asks for a maximum."""
    q = norm_q_lower(question)
    has = lambda words: q.rlike(rf"\b({words})\b")
    high, low = has("maximum|max|highest|largest|most"), has("minimum|min|lowest|smallest|least|fewest")
    return _labels(
        ("count", has("how many|number of|count|counts|total number")),
        ("avg", has("average|avg|mean")),
        ("sum", has("sum|summed") | (has("total") & ~has("total number"))),
        ("max", high), ("min", low), ("order_extreme", high | low),
        ("group_by", has("for each|per|each")), ("distinct", has("distinct|different|unique")), ("negation", has("not|without|except")),
    )


def question_hints_v2(question: Column) -> Column:
    """Hints of a normalised question; ``most`` only asks for an extreme, and negation implies nesting."""
    q = question
    has = lambda words: q.rlike(rf"\b({words})\b")
    high, low = has("maximum|max|highest|largest|greatest"), has("minimum|min|lowest|smallest")
    negation = has("without|never|not|no |except")
    return _labels(
        ("count", has("how many|number of|count|counts|total number")),
        ("avg", has("average|avg|mean")),
        ("sum", has("sum|summed") | (has("total") & ~has("total number"))),
        ("max", high), ("min", low), ("order_extreme", high | low | has("most|least|fewest")),
        ("group_by", has("for each|per|each|grouped by|by every")), ("distinct", has("distinct|different|unique")), ("negation", negation),
        ("nested_select", negation | has("more than the average|less than the average|above average|below average")),
    )


def candidate_features(sql: Column) -> Column:
    """Sorted feature names of a candidate statement, literals blanked."""
    low = F.lower(blank_literals(sql))
    has = lambda p: low.rlike(p)
    order, limit, joins = has(r"\border\s+by\b"), has(r"\blimit\b"), count_of(low, r"\bjoin\b")
    return _labels(
        *[(a, has(rf"\b{a}\s*\(")) for a in AGGREGATES],
        ("group_by", has(r"\bgroup\s+by\b")), ("having", has(r"\bhaving\b")), ("order_by", order), ("limit", limit), ("order_by_limit", order & limit),
        ("distinct", has(r"\bdistinct\b")), ("join", joins >= 1), ("multi_join", joins >= 2), ("nested_select", count_of(low, r"\bselect\b") >= 2),
        ("exists", has(r"\bexists\s*\(")), ("not_in", has(r"\bnot\s+in\s*\(")), ("in", has(r"\bin\s*\(")),
        *[(s, has(rf"\b{s}\b")) for s in ("union", "intersect", "except")],
    )


def sqlaware_bonus(hints: Column, features: Column) -> Column:
    """Sum of the weights of matches, capped."""
    both = lambda n: F.array_contains(hints, n) & F.array_contains(features, n)
    total = sum((F.when(both(n), w).otherwise(0.0) for n, w in BONUS.items()), F.lit(0.0))
    extreme = F.array_contains(hints, "order_extreme") & F.array_contains(features, "order_by_limit")
    negation = F.array_contains(hints, "negation") & F.arrays_overlap(features, F.array(*map(F.lit, ("not_in", "except", "exists"))))
    total = total + F.when(extreme, BONUS_EXTREME).otherwise(0.0) + F.when(negation, BONUS_NEGATION).otherwise(0.0)
    return F.least(total, F.lit(BONUS_CAP))


def rerank_adjustment(hints: Column, features: Column, joins: Column, target_joins: Column, schema_chars: Column, cap: float = BONUS_CAP) -> Column:
    """Sum of met and missed hints, join distance and schema length, held between the lower bound and the cap."""
    asked, has = (lambda n: F.array_contains(hints, n)), (lambda n: F.array_contains(features, n))
    part = lambda wanted, met, up, down: F.when(wanted & met, up).when(wanted, -down).otherwise(0.0)
    total = F.lit(0.0)
    for name, (up, down) in ADJUST.items():
        total = total + part(asked(name), has(name), up, down)
    total = total + part(asked("order_extreme"), has("order_by_limit"), ADJUST_EXTREME, ADJUST_EXTREME)
    refused = F.arrays_overlap(features, F.array(*map(F.lit, ("not_in", "exists", "except", "nested_select"))))
    total = total + part(asked("negation"), refused, ADJUST_NEGATION, ADJUST_NEGATION)
    total = total + F.when(asked("nested_select") & has("nested_select"), ADJUST_NESTED).otherwise(0.0)
    distance = F.abs(F.least(joins, F.lit(2)) - target_joins)
    total = total + F.when(target_joins.isNull(), 0.0).when(distance == 0, ADJUST_JOIN[0]).when(distance == 1, ADJUST_JOIN[1]).otherwise(ADJUST_JOIN[2])
    total = total + F.when(schema_chars > LONG_SCHEMA, ADJUST_LONG_SCHEMA).otherwise(0.0)
    return F.greatest(F.lit(ADJUST_LOW), F.least(total, F.lit(max(0.0, min(cap, BONUS_CAP)))))


def error_class(error: Column) -> Column:
    """Class of an engine's error text; the first match wins."""
    text = F.lower(F.trim(error))
    return (
        F.when(text == "", "no_error_text").when(text.contains("no such column"), "no such column").when(text.contains("no such table"), "no such table")
        .when(text.contains("syntax error"), "syntax error").when(text.contains("ambiguous column"), "ambiguous column").otherwise("other")
    )


def positional_accuracy(left: Column, right: Column) -> Column:
    """Share of equal places of two arrays, over the longer one; 1.0 for two empty ones."""
    most = F.greatest(F.size(left), F.size(right))
    same = F.size(F.filter(F.zip_with(left, right, lambda a, b: a.isNotNull() & b.isNotNull() & (a == b)), lambda x: x))
    return F.when(most == 0, 1.0).otherwise(same / most)


def characters(text: Column) -> Column:
    """Characters of a text as an array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def ngram_excess(tokens: Column, n: int) -> Column:
    """Struct (excess, fraction) of repeated n-grams."""
    total = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), total), lambda i: F.array_join(F.slice(tokens, i, n), "\x01"))
    excess = F.when(total > 0, total - F.size(F.array_distinct(grams))).otherwise(0)
    return F.struct(excess.alias("excess"), F.when(total > 0, excess / total).otherwise(0.0).alias("fraction"))


def similarity_bin(score: Column) -> Column:
    """Four bins with their lower bounds inclusive."""
    return F.when(score < 0.60, "<0.60").when(score < 0.70, "0.60-<0.70").when(score < 0.85, "0.70-<0.85").otherwise(">=0.85")


def shorten(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of a longer text as dots."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def hms(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def stable_integer(text: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the SHA-256 of a text as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")


def stable_key(*parts: Column) -> Column:
    """Ordering key: SHA-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *parts), 256)
