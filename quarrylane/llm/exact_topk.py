"""Exact top-k inner products over norm-sorted bands of vectors.

Vectors are rotated by the right singular vectors of the whole table, so their
first components carry most of the length.  Bands hold vectors of falling length; the
longest band is searched first, and the k-th best score that a query finds there is
its bound t for all other bands: a band whose longest vector has |q||v| < t never
meets the query.  Within a band, vectors are taken by descending length in chunks, and
Cauchy-Schwarz gives two more ways out: no vector from here on can reach t, or a vector
cannot by the partial sum of its first components plus the product of the residual
lengths.  What is left is scored exactly on the integer vectors.

Queries and candidates meet in (band, query block) cells of bounded size; a cell
returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.llm.shared import settle

TOP_K = 5
#: Bounds of one cell.
BAND_VECTORS = 100_000
BLOCK_QUERIES = 10_000
#: Candidates scored at once, and rotated components in the partial sums.
CHUNK = 2048
HEAD = 16
#: Whole numbers below this are exact as doubles; a score is at most the largest long.
EXACT = 1 << 53
LARGEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, and every component present and finite; an empty vector is usable."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def floored(x: Column) -> Column:
    """The floor of a double as a double, also beyond a long."""
    return F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x)


def rows_of(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """A list column as rows of doubles, shorter vectors padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), size))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of the table, strongest first, from its Gram matrix (size x size, summed where the rows are)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = rows_of(batch.column(0), size)
            total += x.T @ x
        i, j = np.divmod(np.arange(size * size), size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    summed = vectors.select("v").mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros((size, size))
    for row in summed:
        gram[row["i"], row["j"]] = row["v"]
    # The scale changes no direction and keeps very large sums finite.
    _, directions = np.linalg.eigh(np.nan_to_num(gram / max(np.abs(gram).max(initial=0), 1.0)))
    return directions[:, ::-1]


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; beyond doubles' exact range as Python integers, cut at the largest long."""
    bound = queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0)
    if bound < EXACT:
        return queries @ vectors.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    out = np.dot(whole(queries), whole(vectors).T)
    return np.array([[max(-LARGEST, min(LARGEST, x)) for x in row] for row in out.tolist()], object).reshape(out.shape)


def search_cell(
    query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best of these vectors that reach its floor, its own id left out, ties to smaller ids."""
    head = min(HEAD, vectors.shape[1])
    length = np.sqrt((vectors**2).sum(1))
    order = np.lexsort((ids, -length))
    ids, vectors, length = ids[order], vectors[order], length[order]
    first, query_first = (vectors @ turn)[:, :head], (queries @ turn)[:, :head]
    rest = np.sqrt(np.maximum(length**2 - (first**2).sum(1), 0))
    query_length = np.sqrt((queries**2).sum(1))
    query_rest = np.sqrt(np.maximum(query_length**2 - (query_first**2).sum(1), 0))
    # Rounding of the rotated sums is far below this.
    slack = 1e-6 * (1 + query_length * (length[0] if len(length) else 0))
    # (score, -id) of the best so far; `worst` is what a candidate has to reach.
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    worst = np.array(floors, np.float64)
    alive = np.arange(len(queries))
    for start in range(0, len(ids), CHUNK):
        stop = min(start + CHUNK, len(ids))
        alive = alive[query_length[alive] * length[start] + slack[alive] >= worst[alive]]
        if not len(alive):
            break
        bound = query_first[alive] @ first[start:stop].T + np.outer(query_rest[alive], rest[start:stop])
        possible = bound + slack[alive, None] >= worst[alive][:, None]
        possible &= ids[None, start:stop] != query_ids[alive][:, None]
        columns, rows = np.flatnonzero(possible.any(0)), np.flatnonzero(possible.any(1))
        if not len(columns):
            continue
        # Ids ascend along the columns, so that a stable sort breaks ties by id.
        columns = columns[np.argsort(ids[start + columns], kind="stable")]
        scores = exact_scores(queries[alive[rows]], vectors[start + columns])
        if scores.dtype == object:
            ranks = [sorted(np.flatnonzero(p), key=lambda c: (-s[c], c)) for p, s in zip(possible[np.ix_(rows, columns)], scores)]
        else:
            hidden = np.where(possible[np.ix_(rows, columns)], scores, -np.inf)
            ranks = np.argsort(-hidden, 1, kind="stable")[:, : 2 * k]
            ranks = [[c for c in r if hidden[i, c] > -np.inf] for i, r in enumerate(ranks)]
        for i, row in enumerate(rows):
            q = alive[row]
            # An id may have several vectors; it is listed once.
            found = dict((name, score) for score, name in best[q])
            for c in ranks[i]:
                name, score = -int(ids[start + columns[c]]), int(scores[i, c])
                if name not in found and sum(s >= score for s in found.values()) >= k and score < worst[q]:
                    break
                found[name] = max(score, found.get(name, score))
            best[q] = sorted(((s, n) for n, s in found.items()), reverse=True)[:k]
            if len(best[q]) == k:
                worst[q] = max(worst[q], best[q][-1][0])
    return [(int(query_ids[q]), -name, score) for q, found in enumerate(best) for score, name in found]


def top_k(
    vectors: DataFrame, is_query: Column, components: Column, id_column: str = "vec_id", k: int = TOP_K,
    band_vectors: int = BAND_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products with every other id's vector.

    ``components`` is an array of whole numbers as doubles, null where a vector takes no
    part.  Rows with a null id take no part.  Repeated rows count once; an id with
    different vectors takes part with each and is listed once, with its best score.
    Shorter vectors, empty ones too, are padded with zeros.  Products that doubles do
    not hold exactly are computed in whole numbers of any size; a score beyond a long
    is the largest one, and ties go to smaller ids there too.  Fewer than ``k``
    candidates give fewer rows; an empty table gives none.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    given = (
        vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), is_query.alias("is_query"), components.cast("array<double>").alias("v"))
        .where("id IS NOT NULL AND v IS NOT NULL")
        .distinct()
        .withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)))
    )
    given = settle(given)
    counts = given.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max(F.size("v")).alias("size")).first()
    if not counts["n"] or not counts["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, blocks = max(counts["size"], 1), -(-counts["q"] // block_queries)
    bands = -(-counts["n"] // band_vectors)
    # Small tables still use all cores.
    bands = max(bands, min(2 * spark.sparkContext.defaultParallelism, -(-counts["n"] // CHUNK)))
    turn = spark.sparkContext.broadcast(rotation(given, size))
    # Cuts between bands; vectors of equal length beyond a band's share are spread by their ids.
    cuts = given.agg(F.percentile_approx("length", F.array(*[F.lit(1 - i / bands) for i in range(1, bands)]), 100 * bands).alias("c")).first()["c"] if bands > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    level = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: F.col("length") <= c)) if cuts else F.lit(0)
    levelled = given.withColumn("level", level.cast("int"))
    heights = levelled.groupBy("level").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("level").collect()
    parts = {r["level"]: -(-r["n"] // max(band_vectors // 2, CHUNK)) for r in heights}
    part_of = F.element_at(F.create_map(*[F.lit(x) for r in parts.items() for x in r]), F.col("level"))
    block = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)).cast("int")
    candidates = levelled.select("id", "v", "level", F.pmod(F.xxhash64(F.lit(1), "id"), part_of).cast("int").alias("part"))
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = given.where("is_query").select(F.col("id").alias("asking"), F.col("v").alias("wanted"), F.col("length").alias("mine"), block.alias("block"))
    places = F.broadcast(
        spark.createDataFrame([(r["level"], float(r["longest"]), i) for r in heights for i in range(parts[r["level"]])], "level int, longest double, part int")
    )

    def cells(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = search_cell(
                left["asking"].to_numpy(), rows_of(left["wanted"], size), left["floor"].to_numpy(), right["id"].to_numpy(), rows_of(right["v"], size), turn.value, k
            )
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def met(asked: DataFrame, among: DataFrame) -> DataFrame:
        keys = ["level", "part", "block"]
        return asked.groupBy(*keys).cogroup(among.groupBy(*keys)).applyInArrow(cells, "query_id long, vec_id long, score long")

    def best(rows: DataFrame) -> DataFrame:
        once = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    highest = heights[0]["level"]
    start = queries.withColumn("floor", F.lit(float("-inf"))).join(places.where(F.col("level") == highest))
    found = settle(best(met(start, candidates.where(F.col("level") == highest))))
    if len(heights) == 1:
        return found
    # A query with k scores needs no band that cannot reach the last of them.
    floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("bound"))
    asked = queries.join(floors, F.col("asking") == F.col("of"), "left").withColumn("floor", F.coalesce("bound", F.lit(float("-inf"))))
    reach = F.col("mine") * F.col("longest") * (1 + 1e-6) + 1 >= F.col("floor")
    asked = asked.join(places.where(F.col("level") != highest)).where(reach)
    return best(found.drop("rank").unionByName(met(asked, candidates.where(F.col("level") != highest))))
