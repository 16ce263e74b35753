"""Connected components of an edge table.

Every task first reduces its edges to stars of its own (a partial aggregation: at
most one edge a node).  If few edges are left, one task finishes them; its input is
bounded by ``ONE_TASK_EDGES``.  Otherwise large-star and small-star steps go on in
parallel until nothing changes, and no node's edges are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.shared import settle

#: Edges (16 bytes each) that a single task may finish.
ONE_TASK_EDGES = 200_000
#: Nodes that a task holds before it passes its stars on and starts anew.
TASK_NODES = 2_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars: each node with the smallest node that the given edges reach."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def found() -> Iterator[pa.RecordBatch]:
        leaves = [x for x in parent if root(x) != x]
        for first in range(0, len(leaves), 100_000):
            part = leaves[first : first + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([parent[x] for x in part], pa.int64())], ["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > TASK_NODES:
            yield from found()
            parent.clear()
    yield from found()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _minimum(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``a``, settled so that the join back is a plain one whose hot keys can be split."""
    return settle(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of"))


def _rounds(edges: DataFrame) -> DataFrame:
    """Star edges to the smallest node of each component, by alternating large and small stars."""
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _minimum(both).withColumn("m", F.least("of", "m"))
        large = both.join(least, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.where("a <> b").distinct())
        joined = large.join(_minimum(large), F.col("a") == F.col("of"))
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = settle(small.select("e.a", "e.b").where("a <> b").distinct())
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges


def components(edges: DataFrame, left: str = "a", right: str = "b", one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node that edges reach, for every node with an edge to another node.

    Edges are undirected pairs of longs; repeated edges and loops change nothing;
    an empty table gives an empty one.
    """
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b")
    stars = settle(pairs.mapInArrow(_stars, "a long, b long"))
    if stars.count() <= one_task_edges:
        stars = settle(stars.coalesce(1).mapInArrow(_stars, "a long, b long"))
    else:
        stars = _rounds(settle(stars.distinct()))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
