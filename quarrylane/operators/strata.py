"""Splits of whole components by database, with floors, coverage and a score of deficits (WIN-15).

Components that hold equally many rows of each database and feature are of one kind.
The greedy choice runs on the driver over kinds and their numbers, so it does not grow
with the components; which components of a kind are meant goes by hash rank.  Its work grows with the rows that the roles want, sets of a chosen size.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions.sqlfeatures import stable_key
from quarrylane.operators.sampling import apportion_with_minimums

#: Rows from which on a database has to be in every role.
FREQUENT = 10
#: What a row, a deficit and a surplus of a database or a feature weigh.
DB_ROW, DB_DEFICIT, DB_SURPLUS, FEATURE_ROW, FEATURE_SURPLUS = 100.0, 10.0, 15.0, 0.5, 0.05

#: Rows by database and by feature, as sorted pairs.
Kind = tuple[tuple[tuple[str, int], ...], tuple[tuple[str, int], ...]]


@dataclass
class Role:
    """One side of the split: how many rows it wants in all, of each database and at least, and what it has."""

    total: int
    targets: dict[str, int]
    floors: dict[str, int]
    chosen: Counter = field(default_factory=Counter)
    databases: Counter = field(default_factory=Counter)
    features: Counter = field(default_factory=Counter)

    @property
    def room(self) -> int:
        return self.total - self.databases.total()

    def take(self, kind: Kind) -> None:
        self.chosen[kind] += 1
        self.databases.update(dict(kind[0]))
        self.features.update(dict(kind[1]))

    def deficit_score(self, kind: Kind, rates: dict[str, float]) -> float:
        """High for kinds of databases and features that are short."""
        score = 0.0
        for db, n in kind[0]:
            short = self.targets.get(db, 0) - self.databases[db]
            score += DB_ROW * min(n, short) + DB_DEFICIT * short * n if short > 0 else DB_SURPLUS * n * short
        for name, n in kind[1]:
            short = rates[name] * self.total - self.features[name]
            score += FEATURE_ROW * min(n, short) if short > 0 else -FEATURE_SURPLUS * n
        return score


def rows_of(kind: Kind) -> int:
    """Rows of one component of a kind."""
    return sum(n for _, n in kind[0])


def choose(kinds: dict[Kind, int], pool: dict[str, int], rates: dict[str, float], totals: dict[str, int]) -> dict[str, Role]:
    """How many components of each kind every role takes, for exactly its total of rows.

    Every role first gets a component of each frequent database, then its floors (just
    over half of a database's share), then what its deficits score highest.  What cannot
    be met is an error; floors that no component fits any more are left.
    """
    left, whole = dict(kinds), sum(pool.values())
    eligible: Counter = Counter()
    for kind, n in kinds.items():
        eligible.update({db: n * rows for db, rows in kind[0]})
    frequent = {db for db, n in pool.items() if n >= FREQUENT}
    if few := sorted(db for db in frequent if eligible[db] < len(totals)):
        raise ValueError(f"frequent databases without a row for every role: {few}")
    roles = {}
    for name, total in totals.items():
        floors = {db: max(1, math.floor(0.5 * pool[db] / whole * total) + 1) for db in frequent}
        minimums = {db: min(n, eligible[db]) for db, n in floors.items()}
        roles[name] = Role(total, apportion_with_minimums(total, pool, minimums, dict(eligible)), floors)

    def best_of(role: Role, db: str, spared: int) -> Kind | None:
        """The kind that overshoots a database least; ``spared`` of its components are not taken."""
        holding = [k for k, n in left.items() if n and db in dict(k[0])]
        if sum(left[k] for k in holding) <= spared:
            return None
        over = lambda k: max(0, role.databases[db] + dict(k[0])[db] - role.targets.get(db, 0))
        new = lambda k: sum(d in frequent and not role.databases[d] for d, _ in k[0])
        return min((k for k in holding if rows_of(k) <= role.room), key=lambda k: (over(k), rows_of(k), -new(k), k), default=None)

    def take(role: Role, kind: Kind) -> None:
        role.take(kind)
        left[kind] -= 1

    rare_first = sorted(frequent, key=lambda db: (eligible[db], pool[db], db))
    waiting = len(roles)
    for name, role in roles.items():
        waiting -= 1
        for db in rare_first:
            if not role.databases[db]:
                if (kind := best_of(role, db, waiting)) is None:
                    raise ValueError(f"{name} cannot cover {db}")
                take(role, kind)
    for role in roles.values():
        for db in rare_first:
            while role.databases[db] < role.floors[db] and (kind := best_of(role, db, 0)) is not None:
                take(role, kind)
    for name, role in roles.items():
        while role.room:
            fitting = [k for k, n in left.items() if n and rows_of(k) <= role.room]
            if not fitting:
                raise ValueError(f"{name} misses {role.room} rows that no whole component has")
            take(role, max(fitting, key=lambda k: (role.deficit_score(k, rates), -rows_of(k), k)))
    return roles


def split_by_strata(rows: DataFrame, component: str, database: str, features: dict[str, Column], totals: dict[str, int], seed: str, forced: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``role``: whole components for each role's total of rows, all others ``train``.

    Components in ``forced`` (a column ``component``) are always in ``train``.
    """
    spark = rows.sparkSession
    if taken := {c for c in rows.columns} & {"role", "_kind", "_of", "_component"}:
        raise ValueError(f"columns {sorted(taken)} are in the way")
    whole = rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"f{i}") for i, c in enumerate(features.values())]).first()
    rates = {name: whole[f"f{i}"] / max(whole["n"], 1) for i, name in enumerate(features)}
    pool = {r["db"]: r["n"] for r in rows.groupBy(F.col(database).alias("db")).agg(F.count("*").alias("n")).collect()}
    parts = rows.groupBy(F.col(component).alias("_component"), F.col(database).alias("db")).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"f{i}") for i, c in enumerate(features.values())])
    sums = parts.groupBy("_component").agg(F.array_sort(F.collect_list(F.struct("db", "n"))).alias("dbs"), *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(features))])
    counts = F.array(*[F.col(f"f{i}").cast("long") for i in range(len(features))]).alias("features") if features else F.array().cast("array<long>").alias("features")
    if forced is not None:
        sums = sums.join(forced.select(F.col("component").alias("_of")).distinct(), F.col("_component") == F.col("_of"), "left_anti")
    kinds = sums.select("_component", F.struct("dbs", counts).alias("_kind"))
    number = {(tuple((x["db"], x["n"]) for x in r["_kind"]["dbs"]), tuple(zip(features, r["_kind"]["features"]))): r["n"] for r in kinds.groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    roles, table, upto = choose(number, pool, rates, totals), [], Counter()
    for name, role in roles.items():
        for kind, n in role.chosen.items():
            table.append((([(d, m) for d, m in kind[0]], [m for _, m in kind[1]]), name, upto[kind], upto[kind] + n))
            upto[kind] += n
    chosen = spark.createDataFrame(table, f"_of {kinds.schema['_kind'].dataType.simpleString()}, role string, after long, upto long")
    rank = F.row_number().over(Window.partitionBy("_kind").orderBy(stable_key(F.lit(seed), F.col("_component").cast("string")), "_component"))
    placed = kinds.withColumn("rank", rank).join(chosen, (F.col("_kind") == F.col("_of")) & (F.col("rank") > F.col("after")) & (F.col("rank") <= F.col("upto"))).select("_component", "role")
    return rows.join(placed, F.col(component) == F.col("_component"), "left").withColumn("role", F.coalesce("role", F.lit("train"))).drop("_component")
