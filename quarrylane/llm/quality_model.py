"""Quality classifier: supervised subword embeddings learned by numpy stochastic gradient descent.

A document is the average of learned vectors of its hashed features: words, word
pairs and character n-grams; a softmax over two classes follows.  The labelled
sample is bounded (a documented parameter); scoring covers every whole text.

After training, the output layer is folded into the embedding table: the logit of
an average is the average of the features' logits, so scoring gathers one number a
feature and the model that travels to the executors is one table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.shared import Words, finish, first_by_hash, give_back, settle, slices, text_buffers

#: Bound of the labelled sample: documents of each class, the first by a hash of their ids.
MAX_TRAIN_PER_CLASS = 2500
#: Bound of the features of the whole sample (8 bytes each); documents past it are left out of the sample.
MAX_TRAIN_FEATURES = 1 << 23
#: Documents scored at least this high are predicted to be of class 1.
THRESHOLD = 0.3

BUCKET_BITS = 17
DIMENSIONS = 12
EPOCHS = 12
CHAR_SIZES = (3, 5)
SLICE_BYTES = 1 << 19
#: Odd factors that tell the places of a character n-gram and of a word pair apart.
GRAM_FACTOR, PAIR_FACTOR = np.uint64(0xD1342543DE82EF95), np.uint64(3)


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes as numbers, and where each starts."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[starts]
    if len(starts) == len(raw):
        return lead.astype(np.uint64), starts
    more = (lead >= 0xC0).astype(int) + (lead >= 0xE0) + (lead >= 0xF0)
    codes = (lead & np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint8)[more]).astype(np.uint64)
    for k in (1, 2, 3):
        longer = more >= k
        codes[longer] = (codes[longer] << np.uint64(6)) | (raw[starts[longer] + k] & 0x3F)
    return codes, starts


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays of all hashed features of a slice of documents, one pair a kind: character n-grams, words, word pairs."""
    words = Words(data, offsets, lower=False)
    raw, shift = words.raw, np.uint64(64 - BUCKET_BITS)
    bucket = lambda h: (finish(h) >> shift).astype(np.int32)
    if not len(raw):
        return
    characters, starts = code_points(raw)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))[starts]
    for size in CHAR_SIZES:
        n = len(characters) - size + 1
        if n < 1:
            continue
        gram = np.full(n, size, np.uint64)
        for i in range(size):
            gram = gram * GRAM_FACTOR + characters[i : n + i]
        whole = rows[:n] == rows[size - 1 :]
        yield rows[:n][whole], bucket(gram[whole])
    if len(words.hash):
        yield words.document, bucket(words.hash)
        same = words.document[1:] == words.document[:-1]
        yield words.document[1:][same], bucket(words.hash[:-1][same] * PAIR_FACTOR + words.hash[1:][same])


@dataclass(frozen=True)
class QualityModel:
    """The logit of each hashed feature and the bias; what an average of them gives is the log odds of class 1."""

    logits: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each text; an empty text has the bias alone."""
        out = np.empty(len(offsets) - 1)
        for first, last in slices(offsets, SLICE_BYTES):
            n = last - first
            total, count = np.zeros(n), np.zeros(n)
            for rows, buckets in features(data, offsets[first : last + 1]):
                total += np.bincount(rows, self.logits[buckets], n)
                count += np.bincount(rows, minlength=n)
            out[first:last] = 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))
        return out


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 20) -> QualityModel:
    """Fits by stochastic gradient descent on (label, buckets, weights) examples; the same examples give the same model.

    Classes are weighted to count alike.  Without examples of both classes the
    model gives 0.5 to everything.
    """
    labels = np.array([e[0] for e in examples], int)
    size = 1 << BUCKET_BITS
    if not len(labels) or labels.min() == labels.max():
        return QualityModel(np.zeros(size, np.float32), 0.0)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.array([0.5 / max((labels == c).mean(), 1e-9) for c in (0, 1)])
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(examples)):
            label, buckets, share = examples[i]
            rate = 0.5 * (1 - step / steps)
            step += 1
            rows = vectors[buckets]
            hidden = share @ rows
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            p *= weight[label]
            back = output @ p
            output -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # Shares are of the order of 1/features: their scale is made up for, so that vectors learn as fast as the output.
            vectors[buckets] = rows - (rate * np.outer(share / share.max(), back)).astype(np.float32)
    return QualityModel((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def remainder(id_column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % modulus


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label_column: str, id_column: str, text_column: str, folds: int, per_class: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Feature counts of at most ``per_class`` documents of each class, none of them held out.

    An id with two different labels, or a null one, is not used.  The sample is the
    first ids by hash, ``MAX_TRAIN_FEATURES`` features at most; its size does not
    grow with the input.  Texts of the sample alone go to Python, whole.
    """
    spark = documents.sparkSession
    usable = (
        labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where((F.col("label") == F.col("other")) & (remainder("id", folds) != 0))
        .join(documents.select(F.col(f"`{id_column}`").alias("id")), "id", "left_semi")
    )
    usable = settle(usable.select("id", "label"))
    totals = {row["label"]: row["n"] for row in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [first_by_hash(usable.where(F.col("label") == c), F.xxhash64("id"), ["id"], per_class, n) for c, n in totals.items()]
    ids = [(row["id"], row["label"]) for part in chosen for row in part]
    if not ids:
        return []
    # At most two classes of `per_class` ids.
    sample = F.broadcast(spark.createDataFrame(ids, "of long, label int"))
    texts = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            buckets, shares = [], []
            for i in range(batch.num_rows):
                found = [b for _, b in features(data, offsets[i : i + 2])]
                unique, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
                buckets.append(unique.astype(np.int32).tobytes())
                shares.append((count / max(count.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["id", "label", "buckets", "shares"])

    rows = texts.join(sample, F.col("id") == F.col("of")).select("id", "label", "text").mapInArrow(extracted, "id long, label int, buckets binary, shares binary")
    # Equal texts of an id are one; of an id with very many texts the first by hash compete.
    rows = settle(rows.where(F.length("buckets") > 0).groupBy("id", "label", "buckets", "shares").agg(F.lit(1).alias("one")).drop("one").withColumn("key", F.xxhash64("id", "buckets")))
    sizes = rows.select("key", (F.length("buckets") / 4).cast("long").alias("n")).orderBy(F.xxhash64("key"), "key").limit(2 * per_class).collect()
    upto = np.searchsorted(np.cumsum([r["n"] for r in sizes]), MAX_TRAIN_FEATURES, "right")
    kept = F.broadcast(spark.createDataFrame([(r["key"],) for r in sizes[: int(upto)]], "kept long"))
    # Read part by part, so that the driver holds the sample once.
    found = [(r["id"], r["label"], bytes(r["buckets"]), bytes(r["shares"])) for r in rows.join(kept, F.col("key") == F.col("kept")).coalesce(16).toLocalIterator()]
    return [(label, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for _, label, b, s in sorted(found)]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label_column: str = "quality",
    id_column: str = "doc_id",
    text_column: str = "text",
    folds: int = 5,
    per_class: int = MAX_TRAIN_PER_CLASS,
) -> QualityModel:
    """Learns from labelled rows whose crc32(id as text) is not divisible by ``folds``."""
    return train(labelled_sample(documents, labels, label_column, id_column, text_column, folds, per_class))


def score(documents: DataFrame, model: QualityModel, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or above) added.

    A null or empty text has the score of the bias.  A very long text is scored whole,
    in slices of its own.  All rows stay, repeated ones too; columns named like the added ones are replaced; an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        data, offsets = text_buffers(pa.array(texts, pa.large_string(), from_pandas=True))
        scores = shared.value.scores(data, offsets)
        del data, offsets
        give_back()
        return pd.Series(scores)

    scored = documents.drop("score", "predicted").withColumn("score", probability(F.col(f"`{text_column}`")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
