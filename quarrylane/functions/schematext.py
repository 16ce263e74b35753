"""Canonical schema texts as columns: entities, join estimates, reduction to the tables of a statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Single-word columns that say nothing about their table.
VAGUE_COLUMNS = ("id", "name", "type", "date", "year")


def tables(schema: Column) -> Column:
    """Table names in order."""
    return F.regexp_extract_all(schema, F.lit(r"(?m)^Table:\s*(.+?)\s*$"), F.lit(1))


def entities(schema: Column) -> Column:
    """Array of (table, columns) with names in words: lower case, underscores as spaces."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    lists = F.regexp_extract_all(schema, F.lit(r"(?m)^Columns:[ \t]*(.*?)\s*$"), F.lit(1))
    return F.zip_with(
        tables(schema), lists, lambda t, c: F.struct(plain(t).alias("table"), F.filter(F.transform(F.split(c, ","), plain), lambda x: x != "").alias("columns"))
    )


def foreign_keys(schema: Column) -> Column:
    """Number of foreign-key lines."""
    return F.regexp_count(schema, F.lit(r"(?m)^\s*-.*->"))


def _variants(table: Column) -> Column:
    """A table's name with the plural forms of a single word."""
    single = ~table.contains(" ")
    return F.array_compact(
        F.array(
            table,
            F.when(single, F.concat(table, F.lit("s"))),
            F.when(single & table.rlike(r".y$"), F.concat(F.regexp_replace(table, "y$", ""), F.lit("ies"))),
            F.when(single & table.rlike(r"(s|x|z|ch|sh)$"), F.concat(table, F.lit("es"))),
        )
    )


def matched_tables(question_words: Column, schema: Column) -> Column:
    """Tables that a question names: by name or plural, or by a telling column."""
    q = F.concat(F.lit(" "), question_words, F.lit(" "))
    says = lambda x: F.contains(q, F.concat(F.lit(" "), x, F.lit(" ")))
    telling = lambda c: (F.char_length(c) >= 5) & ~c.isin(*VAGUE_COLUMNS)
    named = lambda e: (F.char_length(e["table"]) >= 3) & F.exists(_variants(e["table"]), says)
    by_column = lambda e: F.exists(e["columns"], lambda c: telling(c) & says(c))
    hit = F.filter(entities(schema), lambda e: named(e) | by_column(e))
    return F.array_sort(F.array_distinct(F.transform(hit, lambda e: e["table"])))


def target_joins(question_words: Column, schema: Column) -> Column:
    """Join bucket that a question asks for: two for three tables or more, one for two, else unknown."""
    n = F.size(matched_tables(question_words, schema))
    return F.when(n >= 3, 2).when(n == 2, 1)


def reduction(schema: Column, used: Column) -> Column:
    """Struct (reason, kept): the schema's tables among those a statement uses, or why all are kept."""
    have = F.transform(tables(schema), F.lower)
    unknown = F.array_except(used, have)
    reason = (
        F.when(F.size(have) == 0, "no_schema_table_blocks").when(F.size(used) == 0, "no_sql_table_refs")
        .when(F.size(unknown) > 0, "unknown_sql_table_refs").when(~F.arrays_overlap(used, have), "no_matching_sql_table_refs").otherwise("")
    )
    kept = F.when(reason == "", F.filter(have, lambda t: F.array_contains(used, t))).otherwise(have)
    return F.struct(reason.alias("reason"), kept.alias("kept"))


def reduced_schema(schema: Column, used: Column) -> Column:
    """Blocks of the used tables with foreign keys among them only; the whole text if the reduction does not apply."""
    found = reduction(schema, used)
    blocks = F.filter(F.split(schema, r"\n\s*\n"), lambda b: b.rlike(r"(?m)^Table:"))
    name = lambda b: F.lower(F.regexp_extract(b, r"(?m)^Table:\s*(.+?)\s*$", 1))
    kept = F.filter(blocks, lambda b: F.array_contains(found["kept"], name(b)))
    names = lambda line: F.transform(F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\."), F.lit(1)), F.lower)
    stays = lambda line: ~line.rlike(r"^\s*-.*->") | (F.size(F.array_except(names(line), found["kept"])) == 0)
    trimmed = F.transform(kept, lambda b: F.array_join(F.filter(F.split(b, "\n"), stays), "\n"))
    return F.when(found["reason"] == "", F.array_join(trimmed, "\n\n")).otherwise(schema)
