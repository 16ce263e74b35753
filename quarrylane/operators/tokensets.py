"""Exact neighbours of token sets by blocks: what travels grows with the sets, not with their candidate pairs.

Tokens are 63-bit hashes with a bit that says whether they index.  The most frequent
have a code of two bytes, the others their lower four bytes, and those whose lower
bytes meet another token's all eight, so codes tell apart what the hashes do.  Sets
are dealt to blocks by their content, and a cell is a pair of blocks.  In a cell, equal
sets are one; a set's rarest tokens are looked up in an index of the other block, and
pairs that cannot reach the percentage with all tokens that are left are dropped.  The
rest is counted in full.  A cell returns the best of each row, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.lineage import settled

#: Tokens that have a short code; they travel to every task, 8 bytes each.
SHORT_CODES = 1 << 16
#: Tokens whose lower bytes meet others' that may travel to every task; with more, all have eight bytes.
MOST_CLASHES = 1 << 20
#: Entries of a block: a cell holds two, at about 30 bytes an entry.  Fewer than FEW are one block, more are SOME blocks at least.
BLOCK_ENTRIES, FEW, SOME = 6_000_000, 200_000, 4
#: Rows of a chunk and of an index within a cell.
CHUNK, INDEX = 64, 2048


def hashed(words: Column, indexes) -> Column:
    """The hashes of an array of tokens; the lowest bit is ``indexes`` of the token."""
    bit = lambda w: F.when(F.coalesce(indexes(w), F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(bit(w)))


def _coded(short: np.ndarray, clashes: np.ndarray | None, blocks: int):
    """Maps (id, side, hashes) to (id, side, n, a, b, block, short, rare, wide)."""
    order = np.argsort(short)
    known, code = short[order], order.astype(np.int64)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            out = []
            for first, last in zip(ends[:-1], ends[1:]):
                own = np.sort(values[first:last])
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                common = known[at] == own
                deltas = np.diff(np.sort(code[at[common]]), prepend=0).astype("<u2")
                rest = own[~common]
                low = rest.astype(np.uint32)
                far = np.ones(len(rest), bool) if clashes is None else np.isin(low, clashes)
                planes = deltas.view(np.uint8).reshape(-1, 2).T.tobytes()
                a, b = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                out.append((len(own), a, b, a % blocks, planes, low[~far].tobytes(), rest[far].tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            arrays = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["id", "side", "n", "a", "b", "block", "short", "rare", "wide"])

    return mapped


def _decoded(table: pa.Table, rows: np.ndarray, flags: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The tokens of these rows as numbers within the cell, rarest first, and which of the numbers index."""
    short, rare, wide = ([table[c][int(r)].as_buffer() for r in rows] for c in ("short", "rare", "wide"))
    far = [np.concatenate([np.frombuffer(x, "<u4").astype(np.uint64), np.frombuffer(y, "<u8")]) for x, y in zip(rare, wide)]
    values, number = np.unique(np.concatenate(far), return_inverse=True)
    number, sets, at = (number + len(flags)).astype(np.int32), [], 0
    for planes, own in zip(short, far):
        low, high = np.frombuffer(planes, np.uint8).reshape(2, -1).astype(np.int32)
        sets.append(np.concatenate([np.cumsum(low | high << 8, dtype=np.int32), number[at : at + len(own)]]))
        at += len(own)
    flags = np.concatenate([flags, (values & np.uint64(1)).astype(bool)])
    often = np.bincount(np.concatenate(sets), minlength=len(flags))
    return [s[np.argsort(often[s], kind="stable")] for s in sets], flags


def links(sets: list[np.ndarray], flags: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """(left, right, shared) of every pair that reaches the percentage and shares a token that indexes.

    Bounds are whole numbers.  If both sides are the same, each pair is there once and none of a set with itself.
    """
    n = np.array([len(s) for s in sets], np.int64)
    same = left is right
    left, right = (x[np.argsort(n[x], kind="stable")] for x in (left, right))
    mark, found = np.zeros(len(flags), bool), [np.zeros((0, 3), np.int64)]
    for at in range(0, len(right), INDEX):
        mine = right[at : at + INDEX]
        m = n[mine]
        tokens = np.concatenate([sets[r] for r in mine])
        posted = np.repeat(np.arange(len(mine)), m)[np.argsort(tokens, kind="stable")]
        count = np.bincount(tokens, minlength=len(flags))
        start = np.cumsum(count) - count
        for first in range(0, min(len(left), at + INDEX) if same else len(left), CHUNK):
            rows = left[first : first + CHUNK]
            k = n[rows]
            if 100 * k[-1] < percent * m[0]:
                continue
            if 100 * m[-1] < percent * k[0]:
                break
            # What a partner of the least size shares; of the rarest tokens that leaves a few more than one.
            least = np.maximum(m[0], -(-percent * k // 100))
            need = -(-percent * (k + least) // (100 + percent))
            keep = np.where(need <= np.minimum(k, m[-1]), np.minimum(k, k - need + 1 + k // 6), 0)
            looked = np.concatenate([sets[r][:x] for r, x in zip(rows, keep)])
            times = count[looked]
            total = int(times.sum())
            if not total:
                continue
            entry = np.arange(total) + np.repeat(start[looked] - (np.cumsum(times) - times), times)
            pair = np.repeat(np.repeat(np.arange(len(rows)) * len(mine), keep), times) + posted[entry]
            shared = np.bincount(pair, minlength=len(rows) * len(mine)).reshape(len(rows), len(mine))
            i, j = np.nonzero(shared >= np.where(keep > 0, np.maximum(need - (k - keep), 1), np.iinfo(np.int64).max)[:, None])
            able = (100 + percent) * np.minimum(shared[i, j] + (k - keep)[i], np.minimum(k[i], m[j])) >= percent * (k[i] + m[j])
            if same:
                able &= first + i < at + j
            i, j = i[able], j[able]
            for x in np.unique(i):
                js = j[i == x]
                own = sets[rows[x]]
                mark[own] = True
                theirs = np.concatenate([sets[mine[y]] for y in js])
                hits, ends = mark[theirs], np.cumsum(m[js]) - m[js]
                both = np.add.reduceat(hits, ends, dtype=np.int64)
                indexed = np.add.reduceat(hits & flags[theirs], ends, dtype=np.int64) > 0
                mark[own] = False
                good = indexed & ((100 + percent) * both >= percent * (k[x] + m[js]))
                if good.any():
                    found.append(np.stack([np.full(good.sum(), rows[x]), mine[js[good]], both[good]], 1))
    return np.concatenate(found)


def _best(table: pa.Table, flags: np.ndarray, percent: int, most: int) -> tuple[list[int], list[int], list[float]]:
    """Rows of a cell, others and ratios: the ``most`` best others of each row."""
    a, b, block, side = (table[c].to_numpy() for c in ("a", "b", "block", "side"))
    place = pc.rank(table["id"].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    # Classes of equal sets, the largest id first.
    order = np.lexsort((-place, b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    starts = np.append(np.flatnonzero(new), len(order))
    members = [order[x:y] for x, y in zip(starts[:-1], starts[1:])]
    heads = order[starts[:-1]]
    sets, flags = _decoded(table, heads, flags)
    n = np.array([len(s) for s in sets], np.int64)
    left = np.flatnonzero(block[heads] == low)
    right = left if low == high else np.flatnonzero(block[heads] == high)
    if not len(left) or not len(right):
        return [], [], []
    found = links(sets, flags, left, right, percent)
    x, y, both = np.concatenate([found, found[:, [1, 0, 2]]]).T
    if low == high:
        own = np.array([c for c in left if len(members[c]) > 1 and flags[sets[c]].any()], np.int64)
        x, y, both = np.concatenate([x, own]), np.concatenate([y, own]), np.concatenate([both, n[own]])
    takes, gives = [m[side[m] & 1 > 0] for m in members], [m[side[m] & 2 > 0] for m in members]
    # A row's own id is left out later, as often as it is there.
    keep = most + int(np.bincount(place).max())
    there = np.array([len(takes[i]) > 0 and len(gives[j]) > 0 for i, j in zip(x, y)], bool)
    x, y, both = x[there], y[there], both[there]
    ratio = both / (n[x] + n[y] - both)
    top = np.array([place[gives[j][0]] for j in y], np.int64)
    order = np.lexsort((-top, -ratio, x))
    x, y, ratio = x[order], y[order], ratio[order]
    ends = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for first, last in zip(ends[:-1], ends[1:]):
        last = min(last, first + keep)
        few = sorted(((r, place[o], o) for r, j in zip(ratio[first:last], y[first:last]) for o in gives[j][:keep]), reverse=True)[:keep]
        for row in takes[x[first]]:
            for r, _, o in [c for c in few if c[1] != place[row]][:most]:
                for column, value in zip(out, (row, o, r)):
                    column.append(value)
    return out


def neighbours(sets: DataFrame, percent: int, most: int) -> DataFrame:
    """(id, other, jaccard) of (id, side, hashes): the best others of each row in each cell.

    ``side`` is 1 for rows that ask, 2 for rows that may answer, 3 for both.
    """
    spark = sets.sparkSession
    kind = sets.schema["id"].dataType.simpleString()
    counted = settled(sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("f")))
    entries = counted.agg(F.sum("f")).first()[0] or 0
    blocks = 1 if entries < FEW else max(SOME, -(-entries // BLOCK_ENTRIES))
    short = np.array([r["h"] for r in counted.orderBy(F.desc("f"), "h").limit(SHORT_CODES).select("h").collect()] or [0], np.int64).view(np.uint64)
    low = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))
    clashing = counted.groupBy(low.alias("low")).agg(F.count("*").alias("c")).where("c > 1").select("low").limit(MOST_CLASHES + 1).collect()
    clashes = None if len(clashing) > MOST_CLASHES else np.array([r["low"] for r in clashing], np.uint32)
    flags = (short & np.uint64(1)).astype(bool)
    schema = f"id {kind}, side int, n int, a long, b long, block int, short binary, rare binary, wide binary"
    shared = spark.sparkContext.broadcast((short, clashes))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _coded(*shared.value, blocks)(batches)

    dealt = sets.select("id", "side", "hashes").mapInArrow(coded, schema).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.select(F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"), "id", "side", "a", "b", "block", "short", "rare", "wide")

    def best(table: pa.Table) -> pa.Table:
        rows, others, ratios = _best(table, flags, percent, most)
        ids = table["id"].combine_chunks()
        take = lambda x: ids.take(pa.array(x, pa.int64()))
        return pa.table({"id": take(rows), "other": take(others), "jaccard": pa.array(ratios, pa.float64())})

    return cells.groupBy("low", "high").applyInArrow(best, f"id {kind}, other {kind}, jaccard double")
