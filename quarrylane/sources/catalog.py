"""Schema text of a catalog's tables (SRC-5, SRC-6)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarrylane.functions.sqlparse import Table


def catalog_tables(spark: SparkSession, names: list[str], primary: dict[str, list[str]], foreign: dict[str, list[tuple[str, str]]]) -> list[Table]:
    """The tables or views of the session's catalog by name; keys come from the caller, as Spark has none."""
    return [Table(name, [c.name for c in spark.catalog.listColumns(name)], primary.get(name, []), foreign.get(name, [])) for name in sorted(names)]


def schema_block(table: Table, always_foreign: bool) -> str:
    """One table's block; without foreign keys their header is optional."""
    lines = table.text.split("\n")
    return "\n".join(lines if table.foreign or always_foreign else lines[:-1])


def catalog_schema_text(tables: list[Table], always_foreign: bool = True) -> str:
    """The prompt's schema text."""
    return "Database schema:\n" + "\n\n".join(schema_block(t, always_foreign) for t in tables)
