"""Language-model scores: a log-bilinear neural model trained with noise-contrastive estimation in numpy.

The vectors of the words before a token, each turned by the matrix of its distance,
add up to a prediction; the token's probability is a softmax of products with it.  The
softmax has two levels: symbols lie in groups by falling frequency, about as many
groups as members, and a token's probability is that of its group times that of the
symbol in the group.  Both levels are trained by noise-contrastive estimation, and
batched matrix products over all groups and over all members of the token's group give
normalised log-probabilities.

Corpus statistics are exact over all training texts: the count of every word is a
table that grows with the input and never leaves the cluster.  The model's symbols grow
with the cube root of the training tokens: frequent words have a vector of their own,
all others share the vectors of classes they are hashed to, and within a class the
smoothed unigram shares the class's probability.  A class also has room for one word
never seen.

Training texts are dealt to shards by a hash.  One shard warms the model up; then every
shard trains it in a task of its own, on draws from its tokens, and each vector becomes
the mean over shards, weighted by how often they have it.  A shard has at least
``TOKENS_A_SYMBOL`` tokens a symbol, so what the shards send is a bounded share of the
input at every size.

Words are keyed by 64-bit hashes.  Counts of the most frequent words travel to all
tasks (a bounded table); the other words of each document meet their counts in a join.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.shared import Words, give_back, release, settle, slices, text_buffers

#: Symbols of the model: so many, and so many times the cube root of the training tokens; a quarter are classes.
LEAST_SYMBOLS, SYMBOLS_A_ROOT = 1 << 14, 64
#: Bound of the table of frequent words (16 bytes each) that every task holds; more if more words have a vector of their own.
FREQUENT_WORDS = 1 << 18
#: Words of context.
CONTEXT = 3
DIMENSIONS, BATCH, RATE = 24, 1024, 0.1
#: Noise draws: groups, shared by a batch, and members of the group, for each token.
NOISE_GROUPS, NOISE_MEMBERS = 32, 8
#: Training draws: so many batches, and so many draws of every training token.
STEPS, DRAWS_A_TOKEN = 2500, 0.1
#: Training tokens of a shard for each symbol of the model.
TOKENS_A_SYMBOL = 128
#: Vectors of one block of averages, and shards averaged at once.
BLOCK_ROWS, AVERAGED_AT_ONCE = 4096, 64
#: Tokens scored at once, and rows of one product.
SCORED_AT_ONCE, MULTIPLIED_AT_ONCE = 1 << 18, 512
#: The key of the end token.
END = np.int64(-0x5851F42D4C957F2D)
SLICE_BYTES = 1 << 20
_DISTINCT_AT_ONCE = 1 << 19


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(column)
    for first, last in slices(offsets, SLICE_BYTES):
        yield first, last, Words(data, offsets[first : last + 1], lower=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens of the one text column, the end of every text included."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, distinct = [], 0
        out = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["word", "n"])
        for batch in batches:
            if batch.num_rows:
                parts.append((np.array([END]), np.array([batch.num_rows])))
            for _, _, words in _slices(batch.column(0)):
                keys, n = np.unique(words.hash.view(np.int64), return_counts=True)
                parts.append((keys, n))
                distinct += len(keys)
                if distinct > _DISTINCT_AT_ONCE:
                    parts = [_merged(parts)]
                    distinct = len(parts[0][0])
                    if distinct > _DISTINCT_AT_ONCE // 2:
                        yield out(*parts[0])
                        parts, distinct = [], 0
        if parts:
            yield out(*_merged(parts))
        del parts
        give_back()

    return texts.mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All words at or over a count that at most ``most`` words reach, and their counts; the end token is always one."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    sizes = {r["level"]: r["words"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()}
    total, least = 0, math.inf
    for value in sorted(sizes, reverse=True):
        total += sizes[value]
        if total > most:
            break
        least = value
    found = counts.where((level >= least) | (F.col("word") == int(END))).toArrow()
    words, n = found["word"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


class Tokens:
    """Looks up words: their place in the model and their training count where it is frequent.

    Words with a vector of their own come first, most frequent ones ahead, then the classes that all other words are
    hashed to, then the symbol before the first word.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, own: np.ndarray, classes: int):
        """``keys`` ascend; ``own`` says which of them have a vector of their own, in the order of their places."""
        self.keys, self.counts = keys, counts
        self.rest, self.classes, self.start = len(own), classes, len(own) + classes
        self.places = self.hashed(keys)
        self.places[own] = np.arange(len(own))
        # Keys are hashes: their first bits nearly say where they are.  The first key of each value of these bits.
        self.shift = np.uint64(63 - len(keys).bit_length())
        self.first = np.searchsorted(self._bits(keys), np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)

    def _bits(self, words: np.ndarray) -> np.ndarray:
        return (words.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift

    def hashed(self, words: np.ndarray) -> np.ndarray:
        return self.rest + words % self.classes

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model places, and counts or -1."""
        if not len(self.keys):
            return self.hashed(words), np.full(len(words), -1)
        last = len(self.keys) - 1
        at = np.minimum(self.first[self._bits(words)], last)
        key = self.keys[at]
        on = np.flatnonzero(key < words)
        while len(on := on[at[on] < last]):
            at[on] += 1
            key[on] = self.keys[at[on]]
            on = on[key[on] < words[on]]
        places, counts = self.places[at], self.counts[at]
        unknown = np.flatnonzero(key != words)
        places[unknown], counts[unknown] = self.hashed(words[unknown]), -1
        return places, counts

    def row(self, words: Words, places: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All documents of a slice in a row, each as ``CONTEXT`` start symbols, its places and the end; and where words and ends are."""
        n = len(words.first) - 1
        flat = np.full(len(places) + (CONTEXT + 1) * n, self.start, np.int32)
        at = np.arange(len(places)) + (CONTEXT + 1) * words.document + CONTEXT
        ends = words.first[1:] + (CONTEXT + 1) * np.arange(n) + CONTEXT
        flat[at], flat[ends] = places, end
        return flat, at, ends


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    # Rows and their order in one number: the order of a stable sort, by a faster one.
    order = np.sort((rows.astype(np.int64) << 32) | np.arange(len(rows)))
    ordered = order >> 32
    order &= (1 << 32) - 1
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(np.take(values, order, axis=0), starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Model:
    """Vectors of context words, a matrix a distance, and vectors and biases of groups and of members, which start at their unigram."""

    PARTS = ("query", "turn", "answer", "bias", "group", "group_bias")

    def __init__(self, unigram: np.ndarray, seed: int = 10):
        random = np.random.default_rng(seed)
        words = len(unigram)
        self.width = math.isqrt(max(words - 1, 0)) + 1
        self.groups = -(-words // self.width)
        # A single word is certain and needs no vectors.
        spread = 0.1 if words > 1 else 0.0
        some = lambda *shape: random.normal(0, spread, shape).astype(np.float32)
        mass = np.add.reduceat(unigram, np.arange(0, words, self.width))
        self.chance = np.concatenate([[0.0], np.cumsum(unigram)])
        self.group_bias = np.log(mass).astype(np.float32)
        self.bias = (np.log(unigram) - np.log(mass)[np.arange(words) // self.width]).astype(np.float32)
        self.noise, self.group_noise = self.bias.copy(), self.group_bias.copy()
        self.query, self.answer, self.group = some(words + 1, DIMENSIONS), some(words, DIMENSIONS), some(self.groups, DIMENSIONS)
        self.turn = np.stack([np.eye(DIMENSIONS, dtype=np.float32) / (k + 1) for k in range(CONTEXT)])

    def fit(self, documents: list[np.ndarray], copies: np.ndarray, steps: int, seed: int, rate: float = RATE) -> None:
        """Noise-contrastive estimation on tokens drawn from ``documents`` (rows of places, the end last), each ``copies`` times."""
        words = len(self.bias)
        if not documents or words < 2:
            return
        random = np.random.default_rng(seed)
        sizes = np.array([len(d) for d in documents])
        flat = np.full(sizes.sum() + CONTEXT * len(sizes), words, np.int32)
        first = np.cumsum(sizes) - sizes + CONTEXT * np.arange(1, len(sizes) + 1)
        for at, d in zip(first, documents):
            flat[at : at + len(d)] = d
        drawn = np.cumsum(sizes * copies.astype(np.float64))
        squares = {p: np.ones(getattr(self, p).shape, np.float32) for p in self.PARTS}
        back_by = np.arange(1, CONTEXT + 1)
        bounds = np.append(self.chance[:: self.width][: self.groups], self.chance[-1])
        spare_groups = self.group_noise + np.float32(math.log(NOISE_GROUPS))
        spare = self.noise + np.float32(math.log(NOISE_MEMBERS))

        def some(values: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
            return values if isinstance(at, slice) else np.take(values, at, axis=0)

        def move(part: str, at: np.ndarray | slice, gradient: np.ndarray, pace: float) -> None:
            value = getattr(self, part)
            square = gradient**2
            square += some(squares[part], at)
            squares[part][at] = square
            value[at] = some(value, at) - pace * gradient / np.sqrt(square)

        for step in range(steps):
            d = np.minimum(np.searchsorted(drawn, random.random(BATCH) * drawn[-1], "right"), len(sizes) - 1)
            at = first[d] + (random.random(BATCH) * sizes[d]).astype(np.int64)
            context, word = flat[at[:, None] - back_by], flat[at]
            group = word // self.width
            others = np.clip(np.searchsorted(bounds, random.random(NOISE_GROUPS) * bounds[-1], "right") - 1, 0, self.groups - 1)
            low, high = bounds[group], bounds[group + 1]
            noise = np.searchsorted(self.chance, low[:, None] + random.random((BATCH, NOISE_MEMBERS)) * (high - low)[:, None], "right") - 1
            noise = np.clip(noise, group[:, None] * self.width, np.minimum((group + 1) * self.width, words)[:, None] - 1)

            own = some(self.query, context)
            own = own.reshape(BATCH, -1)
            c = own @ self.turn.reshape(-1, DIMENSIONS)
            of_group, of_others, of_word, of_noise = some(self.group, group), some(self.group, others), some(self.answer, word), some(self.answer, noise)
            miss_group = _sigmoid((c * of_group).sum(1) + self.group_bias[group] - spare_groups[group]) - 1
            miss_others = _sigmoid(c @ of_others.T + self.group_bias[others] - spare_groups[others])
            miss_word = _sigmoid((c * of_word).sum(1) + self.bias[word] - spare[word]) - 1
            miss_noise = _sigmoid(np.matmul(of_noise, c[:, :, None])[:, :, 0] + self.bias[noise] - spare[noise])
            back = miss_group[:, None] * of_group + miss_others @ of_others + miss_word[:, None] * of_word
            back += np.matmul(miss_noise[:, None, :], of_noise)[:, 0]

            pace = rate * (1 - step / steps)
            grown = np.concatenate([c, np.ones((BATCH, 1), np.float32)], 1)
            rows, gradient = _sums(np.concatenate([group, others]), np.concatenate([miss_group[:, None] * grown, miss_others.T @ grown]))
            move("group", rows, gradient[:, :-1], pace)
            move("group_bias", rows, gradient[:, -1], pace)
            of_all = np.concatenate([miss_word[:, None], miss_noise], 1)[:, :, None] * grown[:, None]
            rows, gradient = _sums(np.concatenate([word[:, None], noise], 1).ravel(), of_all.reshape(-1, DIMENSIONS + 1))
            move("answer", rows, gradient[:, :-1], pace)
            move("bias", rows, gradient[:, -1], pace)
            of_query = back @ self.turn.reshape(-1, DIMENSIONS).T
            of_turn = (own.T @ back).reshape(self.turn.shape) / BATCH
            rows, gradient = _sums(context.ravel(), of_query.reshape(-1, DIMENSIONS))
            move("query", rows, gradient, pace)
            move("turn", slice(None), of_turn, pace)


class Scorer:
    """A model ready to give log-probabilities: context vectors are turned once, biases are a component of vectors, exponents are of two."""

    def __init__(self, model: Model):
        wide = lambda v, b: np.ascontiguousarray((np.column_stack([v, b]) / math.log(2)).T.astype(np.float32))
        # The first distance has a one for the bias.
        self.turned = np.zeros((CONTEXT, len(model.query), DIMENSIONS + 1), np.float32)
        for k in range(CONTEXT):
            self.turned[k, :, :-1] = model.query @ model.turn[k]
        self.turned[0, :, -1] = 1
        self.group, self.width = wide(model.group, model.group_bias), model.width
        starts = range(0, len(model.answer), self.width)
        self.answer = [wide(model.answer[a : a + self.width], model.bias[a : a + self.width]) for a in starts]
        # The largest product is within these bounds: the size of the largest bias, and the longest vector times the context's length.
        self.largest = np.array([abs(float(v[-1].max())) for v in [*self.answer, self.group]])
        self.longest = np.sqrt([float((v[:-1] ** 2).sum(0).max()) for v in [*self.answer, self.group]])

    def logs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of places after their contexts (nearest first), normalised over all places."""
        out = np.zeros(len(word))
        most = min(MULTIPLIED_AT_ONCE, len(word))
        c, more = np.empty((2, most, DIMENSIONS + 1), np.float32)
        room = np.empty(most * max(self.width, self.group.shape[1]), np.float32)
        for first in range(0, len(word), SCORED_AT_ONCE):
            before, w = context[first : first + SCORED_AT_ONCE], word[first : first + SCORED_AT_ONCE]
            group = w // self.width
            order = np.argsort(group.astype(np.uint16) if len(self.answer) <= 1 << 16 else group, kind="stable")
            before, group, member = [before[:, k][order] for k in range(CONTEXT)], group[order], (w - group * self.width)[order]
            found = np.empty(len(w), np.float32)
            for a in range(0, len(w), most):
                part = slice(a, min(a + most, len(w)))
                rows, other, g = c[: part.stop - a], more[: part.stop - a], group[part]
                # Rows are taken by ``take``, many times faster than by an index.
                np.take(self.turned[0], before[0][part], axis=0, out=rows, mode="clip")
                for k in range(1, CONTEXT):
                    rows += np.take(self.turned[k], before[k][part], axis=0, out=other, mode="clip")
                # Without the one for the bias.
                length = math.sqrt(max(float(np.einsum("ij,ij->i", rows, rows).max()) - 1, 0))
                reach = self.largest + length * self.longest
                found[part] = self._level(rows, self.group, g, reach[-1], room)
                edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
                for i, j in zip(edges[:-1], edges[1:]):
                    k = int(g[i])
                    found[a + i : a + j] += self._level(rows[i:j], self.answer[k], member[a + i : a + j], reach[k], room)
            out[first + order] = found
        return np.minimum(out * math.log(2), 0)

    @staticmethod
    def _level(c: np.ndarray, vectors: np.ndarray, picked: np.ndarray, reach: float, room: np.ndarray) -> np.ndarray:
        """Binary logarithms of a softmax over the columns of ``vectors``; the largest product of each row is within ``reach`` of zero."""
        logits = np.matmul(c, vectors, out=room[: len(c) * vectors.shape[1]].reshape(len(c), -1))
        # Where the largest product is far from the largest and the least exponent, it does not have to be taken off.
        if reach > 100:
            logits -= logits.max(1, keepdims=True)
        mine = logits[np.arange(len(c)), picked]
        np.exp2(logits, out=logits)
        return mine - np.log2(logits @ np.ones(vectors.shape[1], np.float32))


def _held_out(documents: DataFrame, folds: int, held_out_fold: int, id_column: str) -> Column:
    key = F.col(f"`{id_column}`").cast("string").cast("binary")
    return F.coalesce(F.crc32(key) % folds == held_out_fold, F.lit(False))


def places_of(texts: DataFrame, tokens: Tokens) -> DataFrame:
    """(shard, places): every text of (shard, text) as its places and the end, 4 bytes each."""
    shared = texts.sparkSession.sparkContext.broadcast(tokens)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        end = int(own.find(np.array([END]))[0][0])
        for batch in batches:
            for first, last, words in _slices(batch.column(1)):
                places, _ = own.find(words.hash.view(np.int64))
                flat, _, ends = own.row(words, places, end)
                rows = [flat[a : b + 1].tobytes() for a, b in zip(np.concatenate([[CONTEXT], ends[:-1] + 1 + CONTEXT]), ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(rows, pa.binary())], ["shard", "places"])
        give_back()

    return texts.select("shard", "text").mapInArrow(mapped, "shard long, places binary")


def train_on_shards(texts: DataFrame, hashed: Column, tokens: Tokens, model: Model, n: int, tokens_a_shard: int, seed: int = 10) -> None:
    """Fits ``model`` to all ``texts`` (one text column; ``hashed`` deals them to shards), of ``n`` tokens.

    Equal texts of a shard are held once, with their number.  Shards, draws and their
    order depend on the texts alone, not on how they are partitioned.
    """
    spark = texts.sparkSession
    shards = 1 + n // tokens_a_shard
    dealt = texts.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("long"))
    steps = math.ceil(STEPS / shards) + math.ceil(n * DRAWS_A_TOKEN / shards / BATCH)
    # Single rows of these are averaged by weight of their own; the other parts by a shard's tokens.
    by_row = {"query", "answer", "bias"}

    def trained(start: Broadcast, steps: int, seed: int, rate: float) -> Callable[[pa.Table], pa.Table]:
        def fitted(table: pa.Table) -> pa.Table:
            found: dict[bytes, int] = {}
            for chunk in table["places"].chunks:
                for p in chunk:
                    p = p.as_py()
                    found[p] = found.get(p, 0) + 1
            shard, old, model = table["shard"][0].as_py(), start.value, copy.deepcopy(start.value)
            del table
            ordered = sorted(found)
            documents, copies = [np.frombuffer(p, np.int32) for p in ordered], np.array([found[p] for p in ordered])
            model.fit(documents, copies, steps, seed + shard, rate)
            often, total = np.zeros(len(old.query)), 0.0
            for d, times in zip(documents, copies):
                np.add.at(often, d, float(times))
                total += len(d) * float(times)
            # As a context, the start symbol comes before every text.
            often[-1] = copies.sum()
            out = []
            for part in Model.PARTS:
                delta = (getattr(model, part) - getattr(old, part)).astype(np.float32)
                delta = delta.reshape(len(delta), -1)
                weight = often[: len(delta)] if part in by_row else np.full(len(delta), total)
                for a in range(0, len(delta), BLOCK_ROWS):
                    w = weight[a : a + BLOCK_ROWS]
                    out.append((part, a, shard, w.tobytes(), (w[:, None] * delta[a : a + BLOCK_ROWS]).astype(np.float32).tobytes()))
            give_back()
            return _parts(out)

        return fitted

    def advance(rows: DataFrame, shards: int, steps: int, seed: int, rate: float) -> None:
        start = spark.sparkContext.broadcast(model)
        sums = places_of(rows, tokens).groupBy("shard").applyInArrow(trained(start, steps, seed, rate), _PARTS_SCHEMA)
        while shards > 1:
            shards = -(-shards // AVERAGED_AT_ONCE)
            sums = sums.withColumn("shard", F.floor(F.col("shard") / AVERAGED_AT_ONCE).cast("long"))
            sums = sums.groupBy("part", "first", "shard").applyInArrow(_added, _PARTS_SCHEMA)
        for r in settle(sums).toLocalIterator():
            weight, total = np.frombuffer(r["weight"], np.float64), np.frombuffer(r["total"], np.float32)
            value = getattr(model, r["part"])[r["first"] : r["first"] + len(weight)]
            value += (total.reshape(len(weight), -1) / np.maximum(weight, 1e-9)[:, None]).astype(np.float32).reshape(value.shape)
        start.destroy()

    if shards > 1:
        advance(dealt.where("shard = 0"), 1, STEPS, seed, RATE)
    advance(dealt, shards, steps, seed + 1, RATE if shards == 1 else RATE / 2)


_PARTS_SCHEMA = "part string, first long, shard long, weight binary, total binary"


def _parts(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else ([] for _ in kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "first", "shard", "weight", "total"])


def _added(table: pa.Table) -> pa.Table:
    """The sums of a few shards' weights and weighted changes, in the order of shards."""
    weight, total = 0.0, 0.0
    for i in range(table.num_rows):
        weight = weight + np.frombuffer(table["weight"][i].as_py(), np.float64)
        total = total + np.frombuffer(table["total"][i].as_py(), np.float32).astype(np.float64)
    first = {c: table[c][0].as_py() for c in ("part", "first", "shard")}
    return _parts([(first["part"], first["first"], first["shard"], weight.tobytes(), total.astype(np.float32).tobytes())])


@dataclass(frozen=True)
class Fitted:
    """What is learned: counts of all words (a table), tokens ``n`` and distinct words ``v``, places, the model and the mass of classes."""

    counts: DataFrame
    n: int
    v: int
    tokens: Tokens
    model: Model
    log_mass: np.ndarray


def fit(training: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Fitted:
    """Learns from all rows of ``training``; a null text is empty."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    texts = training.select(text.alias("text"), F.xxhash64(F.lit("shard"), F.col(f"`{id_column}`"), text).alias("hashed"))
    counts = settle(word_counts(texts.select("text")))
    release(training.sparkSession)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"], totals["v"]
    symbols = LEAST_SYMBOLS + int(SYMBOLS_A_ROOT * n ** (1 / 3))
    classes = symbols // 4 if v > symbols else 1
    most = symbols - classes
    keys, often = frequent_words(counts, max(FREQUENT_WORDS, most))
    # The most frequent words first, ties by key; the end token has its own vector whatever its count.
    order = np.lexsort((keys, -often, keys != END))[:most]
    own = order[np.lexsort((keys[order], -often[order]))]
    tokens = Tokens(keys, often, own, classes)
    # Tokens and smoothed counts of each class: what all words hash to, less those with a vector of their own.
    of_class, mass = np.zeros(classes, np.int64), np.ones(classes)
    sums = counts.groupBy(F.pmod("word", F.lit(classes)).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    found = sums.toArrow()
    at = found["class"].to_numpy()
    of_class[at] = found["n"].to_numpy()
    mass[at] += found["n"].to_numpy() + found["v"].to_numpy()
    np.subtract.at(of_class, keys[own] % classes, often[own])
    np.subtract.at(mass, keys[own] % classes, often[own] + 1)
    seen = np.concatenate([often[own], of_class]) + 0.5
    model = Model(seen / seen.sum())
    if n:
        train_on_shards(texts, F.col("hashed"), tokens, model, n, TOKENS_A_SYMBOL * symbols)
        release(training.sparkSession)
    return Fitted(counts, n, v, tokens, model, np.log10(mass))


def score(documents: DataFrame, folds: int = 7, held_out_fold: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from rows whose crc32(id as text) modulo ``folds`` is not
    ``held_out_fold``; rows with a null id are learned from.  A null text is empty
    and has the end token alone.  A very long text is scored whole, in one worker.
    Every row is scored, repeated ones too (each counts as a text of its own); extra
    columns are ignored.  Without anything to learn from, every token is the unknown
    symbol, with probability one.  An empty table gives an empty one.
    """
    held = _held_out(documents, folds, held_out_fold, id_column)
    return score_with(fit(documents.where(~held), id_column, text_column), documents, held, id_column, text_column)


def score_with(fitted: Fitted, documents: DataFrame, held: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``score`` for ``documents``, of which ``held`` says which are held out."""
    spark, n, v = documents.sparkSession, fitted.n, fitted.v
    ln10, log_total = math.log(10), math.log10(n + v + 1)
    shared = spark.sparkContext.broadcast((fitted.tokens, Scorer(fitted.model), fitted.log_mass))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scorer, log_mass = shared.value
        end_place, end_count = (x[0] for x in own.find(np.array([END])))
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for first, last, words in _slices(batch.column(2)):
                rows = last - first
                keys = words.hash.view(np.int64)
                places, found = own.find(keys)
                flat, at, ends = own.row(words, places, end_place)
                add = lambda w: np.bincount(words.document, w, rows)  # noqa: E731,B023
                rare = found < 0
                log_count = np.where(rare, 0, np.log10(np.maximum(found, 0) + 1))
                columns[0].append(np.diff(words.first) + 1)
                columns[1].append(add(~rare).astype(np.int64) + (end_count > 0))
                columns[2].append(add(log_count) + (math.log10(end_count + 1) if end_count > 0 else 0))
                of_rest = places >= own.rest
                within = np.where(of_rest, log_count - log_mass[np.maximum(places - own.rest, 0)], 0)
                before = lambda x: np.stack([flat[x - k] for k in range(1, CONTEXT + 1)]).T  # noqa: E731,B023
                of_words = add(scorer.logs(before(at), places) / ln10 + within)
                of_ends = scorer.logs(before(ends), np.full(rows, end_place)) / ln10
                columns[3].append(of_words + of_ends - (0 if end_place < own.rest else log_mass[end_place - own.rest]))
                bounds = np.searchsorted(words.document[rare], np.arange(rows + 1))
                for a, b in zip(bounds[:-1], bounds[1:]):
                    unique, often = np.unique(keys[rare][a:b] if b > a else keys[:0], return_counts=True)
                    columns[4].append(unique.tobytes())
                    columns[5].append(often.astype(np.int32).tobytes())
            whole = [np.concatenate(c) if c else np.zeros(0) for c in columns[:4]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(whole[0].astype(np.int64)), pa.array(whole[1].astype(np.int64)),
                    pa.array(whole[2].astype(float)), pa.array(whole[3].astype(float)), pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.binary()),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "logs", "model", "rare", "often"],
            )
        give_back()

    key, text = F.col(f"`{id_column}`").cast("long"), F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    given = documents.select(key.alias("doc_id"), held.alias("held_out"), text.alias("text"))
    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, model double, rare binary, often binary"
    rows = settle(given.mapInArrow(scored, schema).withColumn("place", F.monotonically_increasing_id()))
    release(spark)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                words = [np.frombuffer(b.as_buffer(), np.int64) for b in part.column(1)]
                often = [np.frombuffer(b.as_buffer(), np.int32) for b in part.column(2)]
                places = np.repeat(part.column(0).to_numpy(), [len(w) for w in words])
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.concatenate(words)), pa.array(np.concatenate(often))], ["place", "rare_word", "often"])

    entries = rows.select("place", "rare", "often").mapInArrow(exploded, "place long, rare_word long, often int")
    met = entries.join(fitted.counts, F.col("rare_word") == F.col("word"))
    sums = met.groupBy("place").agg(F.sum("often").alias("more_known"), F.sum(F.col("often") * F.log10(F.col("n") + 1)).alias("more_logs"))
    sums = settle(sums.withColumnRenamed("place", "of"))
    release(spark)
    joined = rows.drop("rare", "often").join(sums, F.col("place") == F.col("of"), "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * log_total).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
