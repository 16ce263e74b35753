"""Splits by whole components, and statistics of best-fit packing.

The greedy parts run on the driver over one row a component *signature and size*, a
table of counts that does not grow with the rows; which components are meant is
decided by hash rank, in parallel.
"""

from __future__ import annotations

import bisect
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions.sqlfeatures import stable_key
from quarrylane.operators.sampling import apportion


def component_quotas(counts: dict[tuple[str, int], int], target: int) -> dict[tuple[str, int], int]:
    """How many components of each (signature, size) to take for exactly ``target`` rows.

    Signatures get proportional shares and fill them with their components, large
    ones first; small components of any signature fill what is left.  A target that
    cannot be met is an error.
    """
    rows = Counter()
    for (signature, size), n in counts.items():
        rows[signature] += size * n
    taken = dict.fromkeys(counts, 0)
    for signature, share in apportion(target, dict(sorted(rows.items()))).items():
        for key in sorted((k for k in counts if k[0] == signature), key=lambda k: -k[1]):
            taken[key] = min(counts[key], share // key[1])
            share -= taken[key] * key[1]
    left = target - sum(size * n for (_, size), n in taken.items())
    for key in sorted(counts, key=lambda k: (k[1], k[0])):
        more = min(counts[key] - taken[key], left // key[1])
        taken[key] += more
        left -= more * key[1]
    if left:
        raise ValueError(f"{left} of {target} rows cannot be selected by whole components")
    return taken


def select_components(rows: DataFrame, component: str, signature: str, id_: str, target: int, seed: str, forced: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``selected``: whole components with ``target`` rows in all, spread over signatures.

    A component's signature is that of its smallest id.  Components in ``forced``
    (a column ``component``) are never selected.
    """
    spark = rows.sparkSession
    groups = rows.groupBy(component).agg(F.min_by(signature, id_).alias("_signature"), F.count("*").cast("long").alias("_size"))
    if forced is not None:
        groups = groups.join(forced.select(F.col("component").alias("_forced")).distinct(), F.col(component) == F.col("_forced"), "left_anti")
    counts = {(r["_signature"], r["_size"]): r["n"] for r in groups.groupBy("_signature", "_size").agg(F.count("*").alias("n")).collect()}
    quotas = [(s, n, q) for (s, n), q in component_quotas(counts, target).items()]
    table = spark.createDataFrame(quotas, "_s string, _n long, _quota long")
    rank = F.row_number().over(Window.partitionBy("_signature", "_size").orderBy(stable_key(F.lit(seed), F.col(component).cast("string")), component))
    ranked = groups.withColumn("_rank", rank).join(table, (F.col("_signature") == F.col("_s")) & (F.col("_size") == F.col("_n")))
    chosen = ranked.where("_rank <= _quota").select(F.col(component).alias("_chosen"))
    return rows.join(chosen, F.col(component) == F.col("_chosen"), "left").withColumn("selected", F.col("_chosen").isNotNull()).drop("_chosen")


def best_fit_packing(histogram: dict[int, int], capacity: int) -> dict[str, float]:
    """Statistics of best-fit decreasing packing of a length histogram: packs, their fill, boundaries inside packs.

    Lengths over the capacity are cut to it.  Packs are counted by their room, so the
    work depends on the number of lengths and not on that of examples.
    """
    lengths: Counter = Counter()
    for length, n in histogram.items():
        lengths[min(length, capacity)] += n
    rooms: list[int] = []
    packs: Counter = Counter()
    total = 0

    def put(room: int, n: int) -> None:
        if not packs[room]:
            bisect.insort(rooms, room)
        packs[room] += n

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms) or length == 0:
                fresh = min(left, left // max(capacity // length, 1) or 1) if length else left
                put(capacity - length, fresh)
                left -= fresh
                total += fresh
                continue
            room = rooms[at]
            used = min(packs[room], left)
            packs[room] -= used
            if not packs[room]:
                rooms.pop(at)
            put(room - length, used)
            left -= used
    examples, tokens = sum(lengths.values()), sum(k * n for k, n in lengths.items())
    return {"packs": total, "examples": examples, "boundaries": examples - total, "fill": tokens / (total * capacity) if total else 0.0}
