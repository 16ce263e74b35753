"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to.  Token capacity
flows from patterns to source quotas; the r-th repetition of a pattern costs r a
token, so costs are convex and repetitions are used last.  The flow says how many
words each pattern gives; seeded documents are then taken in hash order.

The flow network has a row a pattern and a source and is solved on the driver while
its size allows.  Of more patterns than that, none with two sources, the flow needs no
paths: quotas and words are then columns of a table that stays distributed, with the
same results.  Prefix sums over documents go through two levels of hash buckets, so no
source is ever ordered in one task.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.llm.shared import WORD_PATTERN, settle

MAX_REPEATS = 3
SEED = 9
#: Membership patterns that the driver takes; more are planned in a table, which overlapping sources cannot be.
MAX_PATTERNS = 20_000
#: Sources that one task numbers when weights go by their order.
RANGE_SOURCES = 50_000
BUCKETS = 4096


def default_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted(s for s in sources if s is not None) + [s for s in sources if s is None][:1]
    return {s: float(i % 3 + 1) for i, s in enumerate(ordered)}


def quotas(sizes: dict[str | None, int], weights: dict[str | None, float], budget: float, most: float = MAX_REPEATS) -> dict[str | None, float]:
    """Shares of ``budget`` by weight, none over ``most`` times its source's size; what is over is shared again by weight."""
    left, targets, open_sources = float(budget), {}, list(sizes)
    while open_sources:
        weight = sum(weights[s] for s in open_sources)
        share = {s: left * weights[s] / weight if weight else 0.0 for s in open_sources}
        full = [s for s in open_sources if share[s] > most * sizes[s]]
        if not full:
            return targets | share
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_sources = [s for s in open_sources if s not in targets]
    return targets


def min_cost_flow(capacity: list[int], members: list[list[int]], demand: list[int], repeats: int = MAX_REPEATS) -> list[list[int]]:
    """Words that each pattern gives to each of its sources: the largest flow, and the cheapest of those.

    Pattern p can give its capacity ``repeats`` times, the r-th time at cost r a
    word; source s takes ``demand[s]`` at most.  Only a pattern's repetitions cost,
    so cheapest paths first means repetition by repetition: each pattern in turn is
    augmented along residual paths, in which a source may pass on words of a pattern
    that another source can give up.  A pattern without a path never gets one again.
    """
    flow = [[0] * len(m) for m in members]
    given: list[list[tuple[int, int]]] = [[] for _ in demand]
    for p, m in enumerate(members):
        for k, s in enumerate(m):
            given[s].append((p, k))
    used, left, closed = [0] * len(capacity), list(demand), [False] * len(capacity)

    def path_from(pattern: int) -> list[tuple[int, int, int]] | None:
        """Arcs (pattern, source that gives up or -1, source that gets), up to one that takes more."""
        queue, came = deque([(pattern, -1)]), {}
        while queue:
            p, loses = queue.popleft()
            for k, s in enumerate(members[p]):
                if s in came:
                    continue
                came[s] = (p, loses, k)
                if left[s] > 0:
                    arcs = []
                    while True:
                        p, loses, k = came[s]
                        arcs.append((p, loses, k))
                        if loses < 0:
                            return arcs
                        s = members[p][loses]
                queue.extend((q, j) for q, j in given[s] if flow[q][j] > 0)
        return None

    for level in range(1, repeats + 1):
        for pattern, most in enumerate(capacity):
            while not closed[pattern] and used[pattern] < level * most:
                arcs = path_from(pattern)
                if arcs is None:
                    closed[pattern] = True
                    break
                end = members[arcs[0][0]][arcs[0][2]]
                amount = min([left[end], level * most - used[pattern], *(flow[p][loses] for p, loses, _ in arcs if loses >= 0)])
                for p, loses, k in arcs:
                    flow[p][k] += amount
                    if loses >= 0:
                        flow[p][loses] -= amount
                used[pattern] += amount
                left[end] -= amount
    return flow


@dataclass(frozen=True)
class MixPlan:
    """Sizes and targets by source, and the words that the flow takes from each pattern."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    patterns: list[tuple[tuple[str | None, ...], int, int]]


@dataclass(frozen=True)
class WidePlan:
    """The plan of more sources than the driver takes: a row (of, size, target, words, hot) a source.

    ``of`` is the source as an array, ``words`` what the mix takes from it; ``hot``
    marks sources with so large a part of the rows that at most ``MAX_PATTERNS`` are.
    """

    table: DataFrame


def plan_mix(patterns: list[tuple[tuple[str | None, ...], int]], weights: dict[str | None, float] | None, budget: float | None, repeats: int) -> MixPlan:
    """The plan for (sources, words) patterns; a source's size is the words of all patterns that it is in."""
    names: list[str | None] = sorted({s for m, _ in patterns for s in m if s is not None})
    if any(None in m for m, _ in patterns):
        names.append(None)
    sizes = {s: sum(n for m, n in patterns if s in m) for s in names}
    targets = quotas(sizes, weights or default_weights(names), sum(n for _, n in patterns) if budget is None else budget, repeats)
    at = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([n for _, n in patterns], [[at[s] for s in m] for m, _ in patterns], [round(targets[s]) for s in names], repeats)
    return MixPlan(sizes, targets, [(m, n, sum(f)) for (m, n), f in zip(patterns, flow)])


def _in_order(sources: DataFrame) -> DataFrame:
    """``sources`` with ``weight`` 1, 2, 3, repeating by code point, null last; ranges are numbered apart and then shifted."""
    n = sources.count() // RANGE_SOURCES + 2
    ranges = sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranges = settle(ranges)
    shift, shifts = 0, []
    for r in sorted(ranges.groupBy("range").agg(F.count("*").alias("n")).collect()):
        shifts.append((r["range"], shift))
        shift += r["n"]
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    shifted = F.broadcast(sources.sparkSession.createDataFrame(shifts, "range int, shift long"))
    return ranges.withColumn("place", place).join(shifted, "range").withColumn("weight", ((F.col("place") + F.col("shift")) % 3 + 1).cast("double"))


def _wide_plan(totals: DataFrame, weights: dict[str | None, float] | None, budget: float | None, repeats: int) -> WidePlan:
    """The plan for (pattern, n, n_rows) totals, all of one source; the same as the driver's.

    A round of sharing looks at the sources once: those over their limit keep it, the
    rest share what is left.  Sources over their limit stay so, as shares only grow.
    """
    spark = totals.sparkSession
    sources = totals.withColumn("source", F.col("pattern")[0])
    if weights is None:
        sources = _in_order(sources)
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_of string, weight double")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_of")), "left")
    sources = settle(sources.select("pattern", "source", "n", "n_rows", "weight"))
    if not sources.where("weight IS NULL").isEmpty():
        raise ValueError("a source has no weight")
    all_rows, all_words = sources.agg(F.sum("n_rows"), F.sum("n")).first()
    most = (F.col("n") * repeats).cast("double")
    full, seen = F.lit(False), -1
    while True:
        open_weight = F.sum(F.when(~full, F.col("weight")).otherwise(0.0))
        n_full, kept, weight = sources.agg(F.count_if(full), F.sum(F.when(full, most).otherwise(0.0)), open_weight).first()
        if n_full == seen:
            break
        seen, left = n_full, float(all_words if budget is None else budget) - kept
        share = F.lit(left) * F.col("weight") / F.lit(weight) if weight else F.lit(0.0)
        over, full = full, full | (share > most)
    target = F.when(over, most).otherwise(share)
    taken = F.least(F.bround(target).cast("long"), F.col("n") * repeats)
    hot = F.col("n_rows") * MAX_PATTERNS >= F.lit(all_rows)
    return WidePlan(settle(sources.select(F.col("pattern").alias("of"), F.col("n").alias("size"), target.alias("target"), taken.alias("words"), hot.alias("hot"))))


def with_source(rows: DataFrame, plan: MixPlan | WidePlan, source: str) -> DataFrame:
    """``rows`` with ``source_size`` and ``target`` of their one source."""
    if isinstance(plan, WidePlan):
        named = plan.table.select(F.col("of").alias("_of"), F.col("hot").alias("_hot"), F.col("size").alias("source_size"), "target")
    else:
        table = [([s], plan.sizes[s], plan.targets[s]) for s in plan.sizes]
        named = rows.sparkSession.createDataFrame(table, "_of array<string>, source_size long, target double")
    return _looked_up(rows.drop("source_size", "target"), F.array(F.col(f"`{source}`")), named, isinstance(plan, WidePlan)).drop("_of", "_hot")


def _looked_up(rows: DataFrame, key: Column, table: DataFrame, wide: bool) -> DataFrame:
    """``rows`` with the row of ``table`` whose ``_of`` is their key.

    A table of the driver's size is broadcast.  Of a wide one only the hot keys are;
    no other key has enough rows to be too much for the task it is shuffled to.
    """
    same = key.eqNullSafe(F.col("_of"))
    if not wide:
        return rows.join(F.broadcast(table), same)
    hot = F.broadcast(table.where("_hot"))
    cold = rows.join(hot, same, "left_anti").join(table.where("NOT _hot"), same)
    return rows.join(hot, same).unionByName(cold)


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix(
    documents: DataFrame,
    sources: Column,
    weights: dict[str | None, float] | None = None,
    budget: float | None = None,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, MixPlan | WidePlan]:
    """``documents`` with ``size``, ``repeats`` and ``taken`` (words) added, and the plan.

    ``sources`` is an array of the sources of a row; null members count as one
    source, and a null or empty array is that source alone.  Every row stays, also
    one that the mix takes zero times.  Which rows are repeated once more is a
    threshold on a seeded hash of id and size, so reruns agree, and repeated rows
    are decided alike.  Documents without words are repeated as their pattern is.
    Columns named like the added ones are replaced; an empty table gives an empty mix.
    A very long text is counted whole.  More than ``MAX_PATTERNS`` patterns are an error
    if a document has two sources.
    """
    spark = documents.sparkSession
    given = documents.drop("size", "repeats", "taken")
    own = F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))
    words = word_count(F.col(f"`{text_column}`"))
    work = given.withColumns({"size": words, "_pattern": F.array_sort(F.array_distinct(own))})
    work = work.withColumn("_order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col("size")), 1))
    sized = settle(work.select(F.col("_pattern").alias("pattern"), "size", F.col("_order").alias("order")))
    totals = settle(sized.groupBy("pattern").agg(F.sum("size").alias("n"), F.count("*").alias("n_rows")))
    wide = totals.count() > MAX_PATTERNS
    if wide:
        if not totals.where(F.size("pattern") > 1).isEmpty():
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns of overlapping sources")
        plan = _wide_plan(totals, weights, budget, max_repeats)
        taken = plan.table.select("of", F.col("size").alias("n"), "words", "hot")
    else:
        plan = plan_mix(sorted(((tuple(r["pattern"]), r["n"]) for r in totals.collect()), key=str), weights, budget, max_repeats)
        taken = spark.createDataFrame([(list(m), n, words, True) for m, n, words in plan.patterns], "of array<string>, n long, words long, hot boolean")
    # Patterns without words are taken once.
    whole = F.when(F.col("n") > 0, F.floor(F.col("words") / F.col("n"))).otherwise(1)
    planned = taken.select("of", "hot", whole.alias("_whole"), F.when(F.col("n") > 0, F.col("words") - F.col("_whole") * F.col("n")).otherwise(0).alias("words"))
    upto = _thresholds(sized, planned.where("words > 0").select("of", "words"), wide)
    planned = planned.join(upto, "of", "left").select(F.col("of").alias("_of"), F.col("hot").alias("_hot"), "_whole", F.coalesce("upto", F.lit(-1)).alias("_upto"))
    planned = settle(planned)
    joined = _looked_up(work, F.col("_pattern"), planned, wide)
    mixed = joined.withColumn("repeats", F.col("_whole") + (F.col("_order") <= F.col("_upto")).cast("long"))
    mixed = mixed.withColumn("taken", F.col("size") * F.col("repeats"))
    return mixed.select(*[F.col(f"`{c}`") for c in given.columns], "size", "repeats", "taken"), plan


def _thresholds(sized: DataFrame, wanted: DataFrame, wide: bool) -> DataFrame:
    """(of, upto): for each pattern the largest order whose rows come nearest to its ``words``.

    The 63 bits of the order are narrowed 12 at a time; a step sums sizes by bucket
    within the bucket found before, so at most ``BUCKETS`` rows a pattern are ordered
    in one place.  Two steps leave one row in sixteen million to the last.  The first
    step's rows are sums already, later ones are spread by bucket, so a hot source is
    no hot key of a join.
    """
    table = (lambda found: found) if wide else F.broadcast
    coarse = sized.groupBy("pattern", F.shiftleft(F.shiftrightunsigned("order", 51), 51).alias("order")).agg(F.sum("size").alias("size"))
    found = wanted.select("of", "words", F.lit(0).cast("long").alias("at"))
    for shift, rows in ((51, coarse), (39, sized)):
        inside = (F.col("pattern") == F.col("of")) & (F.shiftrightunsigned("order", shift + 12) == F.col("at"))
        sums = rows.join(table(found), inside).groupBy("of", "words", F.shiftrightunsigned("order", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("of").orderBy("bucket")) - F.col("n")
        ends = sums.withColumn("before", before).where("before < words AND words <= before + n")
        found = settle(ends.select("of", (F.col("words") - F.col("before")).alias("words"), F.col("bucket").alias("at")))
    near = sized.join(table(found), (F.col("pattern") == F.col("of")) & (F.shiftrightunsigned("order", 39) == F.col("at")))
    ties = near.groupBy("of", "words", "order").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("order")) - F.col("n")
    fits = ties.withColumn("before", before).where("2 * before + n <= 2 * words")
    last = fits.groupBy("of").agg(F.max("order").alias("last"))
    return found.join(last, "of", "left").select("of", F.coalesce("last", F.shiftleft("at", 39) - 1).alias("upto"))
