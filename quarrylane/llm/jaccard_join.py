"""Exact n-gram Jaccard join: which documents' shingle sets reach a similarity, as components.

Equal sets are one node from the start.  A set that links needs most of its
shingles in other sets (for 85 %: all but 15 %), which gives bounds from its size:

1. On a quarter of the hash space, shingles of one node only are counted per node;
   nodes with more of them than their size allows are out.  Most documents are.
2. The same on all shingles of the nodes left.
3. Of each node left, the rarest shingles (as many as it may miss, and one) are its
   prefix: linked nodes share one.  Posting lists by prefix shingle and size band
   become stars, whose components hold every possible link.
4. In a component, a blocked sparse product of the document by n-gram incidence
   adds up overlaps over blocks of columns; pairs whose overlap, with all they have
   left, stays below the bound of their sizes are dropped on the way.  Columns that
   the same documents hold are one column with a weight.  Large components are cut
   in blocks of documents, and a cell is a pair of blocks.

A cell returns a spanning forest of its links, so no step emits all pairs of a
group.  Counts are pre-aggregated before their shuffles; a hot shingle costs each
task one row.  Sets are keyed by 128 bits, shingles by 64: a false shared shingle
adds one to an overlap of sets that share nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.components import components
from quarrylane.llm.shared import Words, finish, give_back, key_of, release, settle, slices, text_buffers

#: What near-duplicate operators take unless a contract says otherwise.
SHINGLE_WORDS = 5
PERCENT = 80

#: The first filter looks at shingles whose hash is divisible by this.
SAMPLE = 4
SLICE_BYTES = 1 << 19
#: Bounds of a block of documents in a large component, and of the products of entries added up at once.
BLOCK_DOCUMENTS = 128
BLOCK_SHINGLES = 400_000
PRODUCTS = 1 << 20
#: Nodes whose keys may travel to all tasks (16 bytes each); beyond it, a join takes their place.
BROADCAST_NODES = 1 << 20

_FACTORS = finish(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, without words none."""
    for first, last in slices(offsets, SLICE_BYTES):
        words = Words(data, offsets[first : last + 1], lower=True)
        h = words.hash
        grams = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for i in range(size):
            grams += finish(h[i : len(h) - size + 1 + i] * _FACTORS[i]) if len(grams) else 0
        grams = finish(grams + np.uint64(size))
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                short = finish(h[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True)
                yield finish(short + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """The 128-bit key of a set, as two longs."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _over_sets(documents: DataFrame, text_column: str, size: int, carry: list[Column], emit: Callable, schema: str) -> DataFrame:
    """Rows that ``emit`` makes of each slice's carried columns and shingle sets."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            sets = shingle_sets(data, offsets, size)
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                yield emit(part.columns[1:], [next(sets) for _ in range(part.num_rows)])
            del data, offsets, sets
            give_back()

    return documents.select(F.col(f"`{text_column}`").alias("text"), *carry).mapInArrow(mapped, schema)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _signed(shingles: list[np.ndarray]) -> np.ndarray:
    return (np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)).view(np.int64)


def few_unshared(entries: DataFrame, nodes: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Of ``nodes`` (keys, n), those with at most the unshared (shingle, keys) entries that a link allows."""
    shared = entries.groupBy("shingle").agg(*[F.min(k).alias(k) for k in keys], *[F.max(k).alias(f"other_{k}") for k in keys])
    single = shared.where(" AND ".join(f"{k} = other_{k}" for k in keys))
    alone = single.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.count("*").alias("alone"))
    joined = nodes.join(alone, [F.col(k) == F.col(f"of_{k}") for k in keys], "left")
    return joined.where(100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")).select(*keys, "n")


class _Wanted:
    """A bounded set of node keys, sorted."""

    def __init__(self, keys: list[tuple[int, int]]):
        keys.sort()
        self.node, self.check = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))

    def __contains__(self, key: tuple[int, int]) -> bool:
        a, b = np.searchsorted(self.node, key[0], "left"), np.searchsorted(self.node, key[0], "right")
        return key[1] in self.check[a:b]


def _members(nodes: DataFrame, documents: DataFrame, rows: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """(node, check, n, shingles) of ``nodes``, from the texts."""
    spark, schema = nodes.sparkSession, "node long, check long, n long, shingles binary"
    wanted = None
    if nodes.count() <= BROADCAST_NODES:
        wanted = spark.sparkContext.broadcast(_Wanted([(r["node"], r["check"]) for r in nodes.select("node", "check").toLocalIterator()]))
    else:
        # A set is read from the rows of its smallest id; rows without an id are all read.
        first = rows.join(nodes, ["node", "check"], "left_semi").groupBy("node", "check").agg(F.min("doc_id").alias("mine"))
        key = F.col(f"`{id_column}`").cast("long")
        documents = documents.join(first.select("mine").distinct(), key == F.col("mine"), "left_semi").unionByName(documents.where(key.isNull()))

    def emit(_, sets: list[np.ndarray]) -> pa.RecordBatch:
        found = {node_of(s): s for s in sets if len(s)}
        if wanted is not None:
            found = {k: s for k, s in found.items() if k in wanted.value}
        return _batch(schema, [k[0] for k in found], [k[1] for k in found], [len(s) for s in found.values()], [s.tobytes() for s in found.values()])

    # Copies of one set meet before the shuffle.
    members = _over_sets(documents, text_column, size, [], emit, schema).groupBy("node", "check", "n").agg(F.min("shingles").alias("shingles"))
    return members if wanted is not None else members.join(nodes, ["node", "check", "n"], "left_semi")


def _exploded(members: DataFrame) -> DataFrame:
    """(shingle, place, n) of (place, n, shingles)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [np.frombuffer(b.as_buffer(), np.int64) for b in part.column(2)]
                sizes = [len(s) for s in sets]
                columns = (np.repeat(part.column(i).to_numpy(), sizes) for i in (0, 1))
                yield _batch("shingle long, place long, n long", np.concatenate(sets), *columns)

    return members.select("place", "n", "shingles").mapInArrow(mapped, "shingle long, place long, n long")


def incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) entries in column order and the columns' weights.

    Columns of one set are left out: they add to no overlap.  Columns with the same
    rows are one column that counts as often.
    """
    sizes = [len(s) for s in sets]
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, starts = row[order], np.cumsum(count) - count
    # The rows of a column as a sum of pseudo-random numbers.
    marks = finish(np.arange(1, len(sets) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    pattern = np.add.reduceat(marks[row], starts)
    shared = np.flatnonzero(count > 1)
    _, first, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    kept, sizes = starts[shared][first], count[shared][first]
    column = np.repeat(np.arange(len(kept)), sizes)
    entries = np.repeat(kept - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(column))
    return row[entries], column, weight


def cell_links(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets at ``left`` and those at ``right``, by the blocked sparse product.

    Overlaps and bounds are whole numbers, so a pair exactly at the threshold links
    whatever its size.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    row, column, weight = incidence(sets)
    in_left, in_right = np.full(len(sets), -1), np.full(len(sets), -1)
    in_left[left], in_right[right] = np.arange(len(left)), np.arange(len(right))
    ahead = np.bincount(row, weight[column], len(sets)).astype(np.int64)
    need = percent * (sizes[left][:, None] + sizes[right][None, :])
    shape, overlap = need.shape, np.zeros(need.size, np.int64)
    possible = (100 + percent) * np.minimum(ahead[left][:, None], ahead[right][None, :]) >= need
    if len(left) == len(right) and (left == right).all():
        possible = np.triu(possible, 1)
    n = len(weight)
    products = np.bincount(column, in_left[row] >= 0, n) * np.bincount(column, in_right[row] >= 0, n)
    ends = np.searchsorted(column, np.arange(n + 1))
    at = 0
    while at < n:
        stop = at + max(1, int(np.searchsorted(np.cumsum(products[at:]), PRODUCTS, "right")))
        part = slice(ends[at], ends[stop])
        rows, columns = row[part], column[part] - at
        ahead -= np.bincount(rows, weight[column[part]], len(sets)).astype(np.int64)
        # Rows without a possible partner take no part in the product.
        i, j = in_left[rows], in_right[rows]
        mine, other = (i >= 0) & possible.any(1)[i], (j >= 0) & possible.any(0)[j]
        if not possible.any():
            return []
        i, of_i, j = i[mine], columns[mine], j[other]
        many = np.bincount(columns[other], minlength=stop - at)
        first = np.cumsum(many) - many
        times = many[of_i]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pair = np.repeat(i, times) * shape[1] + j[np.repeat(first[of_i], times) + within]
        overlap += np.bincount(pair, np.repeat(weight[at:stop][of_i], times), need.size).astype(np.int64)
        at = stop
        most = np.minimum(ahead[left][:, None], ahead[right][None, :])
        possible &= (100 + percent) * (overlap.reshape(shape) + most) >= need
    linked = possible & ((100 + percent) * overlap.reshape(shape) >= need)
    parent = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = int(left[i]), int(right[j])
        if x != y and root(x) != root(y):
            parent[root(x)] = root(y)
            links.append((int(nodes[x]), int(nodes[y])))
    return links


def _product(members: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """(a, b) links among ``members`` of the same component of ``candidates``, enough to connect what is linked."""
    placed = candidates.withColumnRenamed("node", "of")
    sizes = members.select("place", "n").join(placed, F.col("place") == F.col("of"))
    weight = sizes.groupBy("component").agg(F.count("*").alias("documents"), F.sum("n").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("documents") / BLOCK_DOCUMENTS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    weight = settle(weight.select(F.col("component").alias("of_component"), blocks.alias("blocks")))
    # Blocks are found on small rows; the sets join by node, which no component makes uneven.
    block_of = placed.join(weight, F.col("component") == F.col("of_component")).select("of", "component", "blocks")
    dealt = members.join(block_of, F.col("place") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("place"), "blocks").cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "place", "shingles"
    )

    def linked(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        block, nodes = table["block"].to_numpy(), table["place"].to_numpy()
        sets = [np.frombuffer(b.as_buffer(), np.int64) for b in table["shingles"]]
        links = cell_links(nodes, sets, np.flatnonzero(block == low), np.flatnonzero(block == high), percent)
        give_back()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return cells.groupBy("component", "low", "high").applyInArrow(linked, "a long, b long")


def _sets_of_rows(documents: DataFrame, size: int, id_column: str, text_column: str, row_keys: list[Column]) -> DataFrame:
    """(doc_id, the row keys a, b, n_shingles, node, check) of every row, settled."""
    schema = "doc_id long, a long, b long, n_shingles long, node long, check long"

    def emit(carried: list[pa.Array], sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = [node_of(s) for s in sets]
        return _batch(schema, *carried, [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys])

    carry = [F.col(f"`{id_column}`").cast("long").alias("doc_id"), *(k.alias(n) for k, n in zip(row_keys, "ab"))]
    return settle(_over_sets(documents, text_column, size, carry, emit, schema))


def _classes(documents: DataFrame, rows: DataFrame, size: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """(of_node, of_check, component) of the sets that link with another set."""
    spark = documents.sparkSession
    nodes = settle(rows.where("n_shingles > 0").groupBy("node", "check").agg(F.max("n_shingles").alias("n")))
    schema = "shingle long, node long, check long"

    def sampled(_, sets: list[np.ndarray]) -> pa.RecordBatch:
        few = [s[s % np.uint64(SAMPLE) == 0] for s in sets]
        keys = np.array([node_of(s) for s in sets], np.int64).reshape(-1, 2)
        times = [len(s) for s in few]
        return _batch(schema, _signed(few), np.repeat(keys[:, 0], times), np.repeat(keys[:, 1], times))

    entries = _over_sets(documents, text_column, size, [], sampled, schema)
    first = settle(few_unshared(entries, nodes, ["node", "check"], percent))
    release(spark)
    members = settle(_members(first, documents, rows, id_column, text_column, size).withColumn("place", F.monotonically_increasing_id()))
    release(spark)
    left = settle(few_unshared(_exploded(members).select("shingle", "place"), members.select("place", "n"), ["place"], percent).select(F.col("place").alias("of")))
    release(spark)
    members = settle(members.join(left, F.col("place") == F.col("of")).drop("of"))

    entries = _exploded(members)
    often = settle(entries.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1").withColumnRenamed("shingle", "of"))
    counted = entries.join(often, F.col("shingle") == F.col("of")).select("place", "n", F.struct("often", "shingle").alias("entry"))
    # Shingles of one node only come first in the order and share nothing: they use up the prefix and need no rows.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    listed = counted.groupBy("place", "n").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    room = (prefix - (F.col("n") - F.size("entries"))).cast("int")
    ratio = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    band = F.floor(F.log(F.col("n").cast("double")) / ratio)
    posted = (
        listed.where(room > 0)
        .select("place", band.alias("band"), F.explode(F.slice("entries", F.lit(1), room)).alias("entry"))
        .select("place", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("entry.shingle").alias("shingle"))
    )
    posted = settle(posted)
    heads = settle(
        posted.groupBy("shingle", "band").agg(F.min("place").alias("head"), F.max("place").alias("tail")).where("head <> tail")
        .select(F.col("shingle").alias("of_shingle"), F.col("band").alias("of_band"), "head")
    )
    stars = posted.join(heads, (F.col("shingle") == F.col("of_shingle")) & (F.col("band") == F.col("of_band")))
    candidates = components(stars.select(F.col("place").alias("a"), F.col("head").alias("b")))
    release(spark)
    links = settle(_product(members, candidates, percent))
    groups = components(links).withColumnRenamed("node", "of")
    release(spark)
    linked = members.select("place", F.col("node").alias("of_node"), F.col("check").alias("of_check")).join(groups, F.col("place") == F.col("of"))
    return settle(linked.select("of_node", "of_check", "component"))


def _named(rows: DataFrame, classes: DataFrame, least: Column) -> DataFrame:
    """(of_node, of_check, best): the smallest ``least`` of all rows that each set's links reach."""
    own = settle(rows.where("n_shingles > 0").groupBy("node", "check").agg(F.min(least).alias("own")))
    placed = own.join(classes, (F.col("node") == F.col("of_node")) & (F.col("check") == F.col("of_check")), "left").drop("of_node", "of_check")
    best = settle(placed.where("component IS NOT NULL").groupBy(F.col("component").alias("of_component")).agg(F.min("own").alias("least")))
    joined = placed.join(best, F.col("component") == F.col("of_component"), "left")
    return settle(joined.select(F.col("node").alias("of_node"), F.col("check").alias("of_check"), F.coalesce("least", "own").alias("best")))


def jaccard_components(
    documents: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's
    set is its distinct ``size``-word shingles, all its words as one if it has fewer.
    Two rows link when 100 * intersection >= ``percent`` * union; ``component_id`` is
    the smallest id that links reach.  Nothing is capped.

    A null or empty text, or one without words, has no shingles and links with
    nothing: its component is its own id.  Very long texts take part whole; a worker
    holds the shingles of one text, 8 bytes each.  Rows with a null id take part; a
    component of such rows alone has a null id.  Repeated rows all stay.  Extra
    columns are ignored; an empty table gives an empty one.
    """
    rows = _sets_of_rows(documents, size, id_column, text_column, [F.lit(0).cast("long")] * 2)
    named = _named(rows, _classes(documents, rows, size, percent, id_column, text_column), F.col("doc_id"))
    joined = rows.join(named, (F.col("node") == F.col("of_node")) & (F.col("check") == F.col("of_check")), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("best"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def first_of_components(
    documents: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest id, a null one last.

    Rows are told apart by all their columns, not by their id: of several texts of
    one id, each stays or goes with its own component, and of rows that are equal in
    every column one stays.  Of different rows with the smallest id the first by a
    hash stays.  Rows without words link with nothing and all stay, repeated ones too.
    Columns are those of the input (no map); an empty table gives an empty one.
    """
    keys = list(key_of(*[F.col(f"`{c}`") for c in documents.columns]))
    rows = _sets_of_rows(documents, size, id_column, text_column, keys)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b")
    named = _named(rows, _classes(documents, rows, size, percent, id_column, text_column), order)
    winners = named.select(F.col("best.a").alias("a"), F.col("best.b").alias("b")).distinct()
    often = rows.where("n_shingles > 0").groupBy("a", "b").agg(F.count("*").alias("copies"))
    wordless = rows.where("n_shingles = 0").select("a", "b", F.lit(1).cast("long").alias("copies")).distinct()
    stay = settle(often.join(winners, ["a", "b"], "left_semi").unionByName(wordless).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("copies").alias("_copies")))
    joined = documents.join(stay, (keys[0] == F.col("_a")) & (keys[1] == F.col("_b")))
    once = joined.where("_copies = 1")
    if not stay.where("_copies > 1").isEmpty():
        once = once.unionByName(joined.where("_copies > 1").dropDuplicates(["_a", "_b"]))
    return once.drop("_a", "_b", "_copies")
