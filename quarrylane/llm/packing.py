"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenized and cut at multiples of the sequence length; the histogram
of piece lengths (never longer than the sequence length, so bounded) is packed on
the driver into counted patterns; patterns go back to pieces by their rank among
pieces of the same length, in an order of their own columns, so how rows lie in
partitions changes nothing.  Ranks come from counts of (length, salt) groups, so a
length that a third of all pieces share is spread over all salts, and equal pieces
are counted before they are ranked.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.llm.shared import give_back, settle

SEQUENCE_LENGTH = 2048
END_ID = 1
#: Pieces of one length get ranks salt by salt: so many pieces a salt, and at least so many salts.
SALT_PIECES, LEAST_SALTS = 1 << 16, 1024
#: Parts that counts of equal pieces are kept in.
COPY_PARTS = 1024
#: Encoded pre-tokens of a worker's cache (about 0.4 kB each) before its older half goes.
CACHE_ENTRIES = 131_072

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters only are split by a plain class pattern; all others go to the tokenizer whole.
_PLAIN = re.compile(f"[\\t\\n\\r -~{_LETTER}]*")
#: Fixed value: the pre-tokenizer's pattern, for such texts.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")


class Encoder(dict):
    """Ids of whole texts as little-endian uint32 bytes; pre-tokens are encoded once and kept.

    A pre-token's ids do not depend on its neighbours, so texts whose pre-tokens
    can be found by a plain pattern are the joined ids of their pre-tokens.  Texts
    with any other character, or with a special token's string, are encoded by the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        #: The older half of the cache; what is met again moves to the younger one.
        self.older: dict[str, bytes] = {}
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = [t["content"] for t in spec["added_tokens"]]
        for token in special:
            ranks.pop(token.encode(), None)
        # Only ranks in an unbroken row are BPE merges in order; the pattern is not used for single pieces.
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, loaded when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, piece: str) -> bytes:
        out = self.older.pop(piece, None)
        if out is None:
            out = np.array(self.pieces._encode_single_piece(piece.encode()), "<u4").tobytes()
        if len(self) >= CACHE_ENTRIES // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        if not _PLAIN.fullmatch(text) or (self.special and self.special.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


def cut_pieces(
    documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece: each document's ids and the end id, cut every ``length`` ids.

    A null text is empty: its one piece is the end id.  Rows with equal or null ids
    are each documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One for the task: an idle worker keeps no vocabulary and no cache.
        encoder, end = Encoder(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = ([], [], [], [], [])
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    for column, value in zip(out, (key.as_py(), at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )
        del encoder
        give_back()

    key = F.col(f"`{id_column}`").cast("long")
    return documents.select(key.alias("doc_id"), F.col(f"`{text_column}`").alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: (count, lengths) patterns that use every length as often as the histogram says.

    Lengths are placed longest first.  The shortest open pattern takes the next
    length if there is room, for as many packs as both have; else new packs open.
    Both the number of lengths and that of open patterns are bounded by the capacity.
    """
    open_patterns: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    fills: list[int] = []

    def put(count: int, pattern: tuple[int, ...]) -> None:
        fill = sum(pattern)
        if not open_patterns[fill]:
            heapq.heappush(fills, fill)
        open_patterns[fill].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while fills and not open_patterns[fills[0]]:
                heapq.heappop(fills)
            if not fills or fills[0] + length > capacity:
                put(left, (length,))
                break
            count, pattern = open_patterns[fills[0]].pop()
            used = min(count, left)
            if count > used:
                open_patterns[fills[0]].append((count - used, pattern))
            left -= used
            put(used, (*pattern, length))
    return sorted((p for patterns in open_patterns.values() for p in patterns), key=lambda p: (p[1], p[0]), reverse=True)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where runs of ranks start, and the first sequence and the offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*found)) for length, found in runs.items()}


def ranked(pieces: DataFrame, salts: int = LEAST_SALTS) -> DataFrame:
    """``pieces`` with ``rank`` (from 0, without gaps) among pieces of equal length instead of ``copy``.

    Equal pieces follow each other, whichever of them comes first; all else is
    ordered by the pieces' columns alone.
    """
    order = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    part = F.pmod(F.xxhash64("copy"), F.lit(COPY_PARTS)).cast("int")
    counted = pieces.groupBy("length", *order, part.alias("part")).agg(F.count("*").alias("n")).withColumn("salt", salt)
    window = Window.partitionBy("length", "salt").orderBy(*order, "part")
    within = counted.withColumn("within", F.sum("n").over(window) - F.col("n"))
    groups = pieces.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n"))
    # At most `salts` rows a length.
    before = settle(
        groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .select(F.col("length").alias("of_length"), F.col("salt").alias("of_salt"), "before")
    )
    joined = within.join(before, (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    return joined.withColumn("i", each).select(*order, "length", (F.col("before") + F.col("within") + F.col("i")).alias("rank"))


def pack(
    documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset in the sequence.

    No piece is dropped or cut short; an empty table gives no pieces; extra columns
    are ignored.  A very long text is encoded whole, in one worker, and gives as many
    pieces as it fills sequences.  Repeated rows are packed as often as they occur.
    The same rows give the same result, however they are partitioned.
    """
    pieces = cut_pieces(documents, tokenizer_path, id_column, text_column, length)
    pieces = settle(pieces.withColumn("copy", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = documents.sparkSession.sparkContext.broadcast(slots(pack_histogram(histogram, length)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for value in np.unique(lengths):
                mine = lengths == value
                starts, sequences, offsets = shared.value[int(value)]
                run = np.searchsorted(starts, ranks[mine], "right") - 1
                sequence[mine] = sequences[run] + ranks[mine] - starts[run]
                offset[mine] = offsets[run]
            kept = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    salts = max(LEAST_SALTS, -(-sum(histogram.values()) // SALT_PIECES))
    return ranked(pieces, salts).mapInArrow(
        placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
