"""Overlap between relations: keys, semi and anti joins, leakage reasons, components."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.operators import tokensets
from quarrylane.operators.lineage import settled

#: Tokens that index nothing.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "to", "for", "and", "or", "is", "are", "was", "were", "what", "which", "who", "how", "many", "much", "show", "list",
    "find", "give", "me", "there", "does", "do", "with", "that", "have", "has",
)

KINDS = ("id", "question", "sql", "pair")


def keyed(df: DataFrame, id_: Column, question: Column, sql: Column) -> DataFrame:
    """(id, question, sql, pair) keys of a relation; long texts are keyed by digest, so joins move little."""
    q, s = F.md5(question), F.md5(sql)
    return df.select(id_.alias("id"), q.alias("question"), s.alias("sql"), F.concat_ws("|", q, s).alias("pair"))


def flags(rows: DataFrame, reference: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``rows`` with a flag ``in_<kind>`` for each key that the reference has too.

    One outer join a kind with the reference's distinct keys, never ``NOT IN``: a
    null key is in nothing.
    """
    for kind in kinds:
        keys = reference.select(F.col(kind).alias(f"_{kind}")).distinct().withColumn(f"in_{kind}", F.lit(True))
        rows = rows.join(keys, F.col(kind) == F.col(f"_{kind}"), "left").drop(f"_{kind}")
        rows = rows.withColumn(f"in_{kind}", F.coalesce(f"in_{kind}", F.lit(False)))
    return rows


def overlap_counts(rows: DataFrame, reference: DataFrame, pairwise: bool = True) -> DataFrame:
    """One row of inclusive counters; ``both`` is the pair, or both memberships on their own."""
    flagged = flags(rows, reference, ("question", "sql", "pair"))
    both = F.col("in_pair") if pairwise else F.col("in_question") & F.col("in_sql")
    return flagged.agg(
        F.count("*").alias("n"), F.count_if("in_question").alias("question_overlap"), F.count_if("in_sql").alias("sql_overlap"), F.count_if(both).alias("both_overlap")
    )


def remove_overlap(rows: DataFrame, reference: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows none of whose keys of these kinds the reference has."""
    for kind in kinds:
        rows = rows.join(reference.select(F.col(kind).alias(f"_{kind}")).distinct(), F.col(kind) == F.col(f"_{kind}"), "left_anti")
    return rows


def leakage_reasons(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """(id, reasons): the kinds of keys shared with protected rows, joined by plus signs; empty without any."""
    found = F.array_compact(F.array(*[F.when(F.col(f"in_{k}"), F.lit(k)) for k in KINDS]))
    return flags(rows, protected).select("id", F.array_join(found, "+").alias("reasons"))


def aligned(runs: dict[str, DataFrame], id_: str, place: str) -> DataFrame:
    """One row a case of any run: its place in each run (``place_<run>``), and whether every run has it at the same one."""
    out = None
    for name, run in runs.items():
        own = run.select(F.col(id_), F.col(place).alias(f"place_{name}"))
        out = own if out is None else out.join(own, id_, "full_outer")
    places = [F.col(f"place_{name}") for name in runs]
    same = F.lit(True)
    for p in places:
        same = same & F.coalesce(p == places[0], F.lit(False))
    return out.withColumn("same_place", same)


def token_jaccard(rows: DataFrame, others: DataFrame, stop: tuple[str, ...], percent: int = 45, least: int = 3, most: int = 5) -> DataFrame:
    """(id, other, jaccard, rank): the ``most`` other rows whose token sets are the most alike, at least ``percent``.

    Both sides are (id, words) with distinct words.  A pair needs a shared token of
    ``least`` letters that is no stop word; all tokens count in the ratio.  Every pair
    is covered, by cells of two blocks of sets (``tokensets``).  A row is no neighbour
    of its own id; rows without an id or without words have none.  Ties go to the larger id.
    """
    indexes = lambda w: (F.length(w) >= least) & ~w.isin(*stop)

    def sets(df: DataFrame, side: int) -> DataFrame:
        whole = df.where(F.col("id").isNotNull() & (F.size("words") > 0))
        return whole.select("id", F.lit(side).alias("side"), tokensets.hashed(F.col("words"), indexes).alias("hashes"))

    both = sets(rows, 3) if rows is others else sets(rows, 1).unionByName(sets(others, 2))
    scored = tokensets.neighbours(both, percent, most)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("jaccard"), F.desc("other")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "other", "jaccard", F.col("rank").cast("long").alias("rank"))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts; null if either is."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def long_keys(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(id, kind, value) of every key."""
    columns = rows.select(F.col("id").alias("_row"), *[F.col(k).cast("string") for k in kinds])
    return columns.unpivot(["_row"], list(kinds), "kind", "value").withColumnRenamed("_row", "id")


def intersections(left: DataFrame, right: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, n): distinct key values in both relations, for every kind that has one."""
    a, b = (long_keys(d, kinds).select("kind", "value").distinct() for d in (left, right))
    return a.join(b, ["kind", "value"]).groupBy("kind").agg(F.count("*").alias("n"))


def components(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, component): rows that share a key, directly or through others; the component is its smallest id.

    Labels spread over the two-sided graph of rows and keys and jump to the label of
    their label, so long chains take a logarithmic number of rounds; every round is
    checkpointed.  Minima are aggregated before the shuffle, so a key that many rows
    share is no hot spot.
    """
    edges = long_keys(rows, kinds).where("value IS NOT NULL").select("id", F.xxhash64("kind", "value").alias("key")).distinct()
    edges = settled(edges)
    labels = settled(rows.select("id", F.col("id").alias("label")).distinct())
    while True:
        by_key = edges.join(labels, "id").groupBy("key").agg(F.min("label").alias("least"))
        reached = edges.join(by_key, "key").groupBy("id").agg(F.min("least").alias("least"))
        nearer = labels.join(reached, "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("least", "label")).alias("label"))
        jump = nearer.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = settled(nearer.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        if after.where("label <> was").isEmpty():
            return after.select("id", F.col("label").alias("component"))
        labels = after.select("id", "label")
