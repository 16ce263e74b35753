"""What the operators of this subpackage share: shared-folder checkpoints, ASCII word rules and array hashing.

Words are maximal runs of anything but the six ASCII white-space bytes, so they
can be found in UTF-8 bytes without decoding.  Hashing works on the buffers of
an Arrow string array, for all words of a slice of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: ASCII white space as a Java character class and as a set of characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Where checkpoints go if the session names no shared folder (tests on one machine).
LOCAL_SHARED_DIR = "/tmp/checkpoints"
#: Bytes of rows sent to a Python worker at once, where the session does not say; Spark's 64 MB times the buffers
#: on both sides are much of a small executor's memory.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    That is the one the session names, else the one the context has; only where there is
    neither is one set.  Checkpoints that nothing refers to any more are removed, and batches
    of ``ARROW_BATCH`` go to Python workers, unless the session says otherwise.
    """
    context = spark.sparkContext
    if ARROW_BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*ARROW_BATCH)
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    inner = context._jsc.sc()
    inner.conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not inner.getCheckpointDir().isDefined():
        context.setCheckpointDir(named or LOCAL_SHARED_DIR)
    return named or inner.getCheckpointDir().get()


def give_back() -> None:
    """Returns freed memory of this worker to the system; workers outlive their tasks and share an executor's memory."""
    import ctypes
    import sys

    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to ``most_bytes`` at most, or hold one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32


def finish(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Values of bytes at the first places of a word; later places are computed by the same rule.
_TABLE_PLACES = 64
_TABLE = finish(np.arange(1, 256 * _TABLE_PLACES + 1, dtype=np.uint64) * _STEP)


def byte_values(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit value of each (place, byte).

    Places do not differ by a factor, so sums of these values have no algebraic
    structure that texts could meet, as powers modulo 2^64 have.
    """
    index = place * 256 + byte
    out = _TABLE[np.minimum(index, len(_TABLE) - 1)]
    late = np.flatnonzero(index >= len(_TABLE))
    out[late] = finish((index[late].astype(np.uint64) + np.uint64(1)) * _STEP)
    return out


def _value_sums(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of ``byte_values`` of each word: place by place, over all words that reach it; words beyond the table byte by byte."""
    kind = np.minimum(lengths, _TABLE_PLACES + 1).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    # The first word of each length, in this order, by length; the last are the long ones.
    first = np.searchsorted(kind[order], np.arange(1, _TABLE_PLACES + 2))
    n = int(first[-1])
    at, sums = starts[order[:n]], np.zeros(n, np.uint64)
    for place in range(_TABLE_PLACES):
        k = int(first[place])
        if k == n:
            break
        sums[k:] += _TABLE[place * 256 : place * 256 + 256][raw[at[k:] + place]]
    out = np.empty(len(starts), np.uint64)
    out[order[:n]] = sums
    if n < len(starts):
        long = order[n:]
        size = lengths[long]
        before = np.cumsum(size) - size
        position = np.arange(size.sum()) - np.repeat(before, size)
        out[long] = np.add.reduceat(byte_values(position, raw[np.repeat(starts[long], size) + position]), before)
    return out


class Words:
    """Words of a slice of documents: where each starts and ends, its document and its 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        base, end = int(offsets[0]), int(offsets[-1])
        raw = data[base:end]
        bounds = offsets - base
        space = _IS_SPACE[raw]
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        at = bounds[:-1][(bounds[:-1] < len(raw)) & (bounds[1:] > bounds[:-1])]
        first[at] = inside[at]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= space[1:]
        last[at[at > 0] - 1] = inside[at[at > 0] - 1]
        self.starts, self.ends = starts, np.flatnonzero(last) + 1
        self.document = np.searchsorted(bounds, starts, "right") - 1
        self.raw, self.bounds, self.inside = raw, bounds, inside
        #: Words before each document, and at the end.
        self.first = np.searchsorted(starts, bounds)
        if len(starts):
            lengths = self.ends - starts
            self.hash = finish(_value_sums(_LOWER[raw] if lower else raw, starts, lengths) + lengths.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def shared_copy(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet under the shared folder and read again, and its path."""
    import uuid

    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def key_of(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns, together a 128-bit key."""
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit("second"), *columns)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that only collected frames refer to; useful between settled steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table written by ``shared_copy``, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def first_by_hash(rows: DataFrame, hashed: Column, ties: list[str], most: int, total: int) -> list[Row]:
    """The ``most`` rows (of about ``total``) with the smallest 64-bit hashes, in that order.

    Only rows under a threshold that twice as many are expected to pass compete, so what
    reaches the driver does not grow with rows or tasks.  If too few pass, the threshold
    is raised fourfold.
    """
    share = 2 * most / max(total, 1)
    while True:
        within = rows if share >= 1 else rows.where(hashed < -(1 << 63) + int((1 << 64) * share))
        found = within.orderBy(hashed, *ties).limit(most).collect()
        if len(found) == most or share >= 1:
            return found
        share *= 4
