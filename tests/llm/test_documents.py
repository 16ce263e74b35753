"""Operators over documents against brute force, and on odd and empty tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylane.llm import jaccard_join, language_model, line_dedup, mixing, packing, quality_model, queries, repetition
from quarrylane.llm.components import components
from quarrylane.llm.shared import Words, text_buffers
from tests.llm.conftest import ODD, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_line_dedup_odd(odd):
    found = rows_of(line_dedup.dedup_lines(odd, min_documents=1))
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[2]["n_lines"], by_id[2]["n_dropped"], by_id[2]["kept_text"]) == (1, 0, "")
    assert (by_id[6]["n_lines"], by_id[6]["n_dropped"], by_id[6]["kept_text"]) == (4, 3, "")
    assert by_id[4]["kept_text"] == " \t\n \r\n "
    assert rows_of(line_dedup.dedup_lines(odd.limit(0))) == []


def test_line_dedup_counts_documents_not_lines(spark):
    df = spark.createDataFrame([(1, "a\na\na"), (2, "A \nb"), (2, "A \nb")], "doc_id long, text string")
    assert {r["kept_text"] for r in line_dedup.dedup_lines(df, min_documents=3).collect()} == {"a\na\na", "A \nb"}
    assert sorted(r["kept_text"] for r in line_dedup.dedup_lines(df, min_documents=2).collect()) == ["", "b", "b"]


def test_line_dedup_is_linear_in_lines(spark):
    """Sixteen times the lines cost far less than a quadratic step would."""
    import time

    def seconds(n):
        text = "\n".join(f"line {i % (n // 2)} of a long text" if i % 2 else f"own {i}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        start = time.perf_counter()
        kept = line_dedup.dedup_lines(df, min_documents=3).collect()
        assert [r["kept_text"] for r in kept] == [text] * 2
        gone = line_dedup.dedup_lines(df.unionByName(spark.createDataFrame([(3, "own 0")], "doc_id long, text string")), min_documents=3).where("doc_id = 1").first()
        assert gone["n_lines"] == n and gone["n_dropped"] == 1 and gone["kept_text"] == text.partition("\n")[2]
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(64_000) < 6 * max(seconds(4000), 1)


def linked_components(texts, size, percent):
    sets, index = {}, defaultdict(list)
    for key, text in texts.items():
        words = WORD.findall(lowered(text))
        sets[key] = {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()
        for s in sets[key]:
            index[s].append(key)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for key, own in sets.items():
        for other, n in Counter(o for s in own for o in index[s] if o > key).items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                a, b = sorted((find(key), find(other)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_against_all_pairs(spark, documents, texts, size, percent):
    found = jaccard_join.jaccard_components(documents, size, percent).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == linked_components(texts, size, percent)


def test_jaccard_dense_group(spark):
    """Many near copies of one text, some linked only through others, in cells of more than one block."""
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(400):
        words = list(base)
        for at in random.integers(0, 60, random.integers(0, 3)):
            words[at] = f"v{random.integers(0, 4)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df, 4, 85).collect()}
    assert found == linked_components(texts, 4, 85)
    assert len({c for _, c in found.values()}) > 1


def test_jaccard_odd(odd):
    found = jaccard_join.jaccard_components(odd).collect()
    assert len(found) == len(ODD)
    by_id = defaultdict(list)
    for r in found:
        by_id[r[0]].append((r[1], r[2]))
    assert by_id[1] == [(4, 1)] and (4, 1) in by_id[None] and (0, None) in by_id[None]
    assert by_id[2] == [(0, 2)] and by_id[4] == [(0, 4)] and by_id[5] == [(1, 5)] and by_id[6] == [(2, 6)] * 2
    assert jaccard_join.jaccard_components(odd.limit(0)).collect() == []


def test_jaccard_join_path_equals_broadcast_path(documents, monkeypatch):
    plain = sorted(jaccard_join.jaccard_components(documents, 4, 85).collect())
    monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", 0)
    assert sorted(jaccard_join.jaccard_components(documents, 4, 85).collect()) == plain


def test_jaccard_join_path_reads_rows_without_id(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[i:] + [f"y{j}" for j in range(i)]) for i in range(0, 9, 2)]
    # Neighbours of the chain link, its ends do not; only rows without an id hold it together.
    rows = [(1, chain[0]), (None, chain[1]), (None, chain[2]), (None, chain[2]), (None, chain[3]), (9, chain[4]), (5, "a b c d e f"), (None, "g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = sorted(jaccard_join.jaccard_components(df, 4, 85).collect(), key=repr)
    assert (9, 57, 1) in [tuple(r) for r in plain]
    monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", 0)
    assert sorted(jaccard_join.jaccard_components(df, 4, 85).collect(), key=repr) == plain


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=8, deadline=None)
def test_components(spark, edges):
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    found = {r[0]: r[1] for r in components(table).collect()}
    assert found == {r[0]: r[1] for r in components(table, one_task_edges=0).collect()}
    reach = {x: {x} for e in edges for x in e}
    for _ in range(13):
        for a, b in edges:
            reach[a] |= reach[b]
            reach[b] |= reach[a]
    assert found == {x: min(r) for x, r in reach.items() if len(r) > 1}


def test_packing_round_trip(spark, documents, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    pieces = rows_of(packing.pack(documents, path))
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_document[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_document[key], key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += p["length"]
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    total = sum(p["length"] for p in pieces)
    assert total / (2048 * len(by_sequence)) > 0.97


@cache
def one_encoder():
    return packing.Encoder(queries.tokenizer_path())


TRICKY = st.lists(st.sampled_from(list("aZ9 '.\n\t\r é×÷ß!<|>_sdmt\x1c\x85\xa0\u2003日½ªĀ") + ["'s", "<|endoftext|>", "  ", "don't"]), max_size=40).map("".join)


@given(TRICKY)
@settings(max_examples=400, deadline=None)
def test_encoder_equals_tokenizer(text):
    encoder = one_encoder()
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_odd(odd):
    pieces = rows_of(packing.pack(odd, queries.tokenizer_path()))
    assert sum(p["start"] == 0 for p in pieces) == len(ODD)
    assert {(p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] in (2, 3)} == {(1, 1)}
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
    assert rows_of(packing.pack(odd.limit(0), queries.tokenizer_path())) == []


def test_packing_does_not_depend_on_partitions(spark, documents):
    small = documents.where("doc_id < 300").select("doc_id", "text")
    copies = small.unionByName(small.where("doc_id % 3 = 0")).unionByName(spark.createDataFrame([(None, None)] * 40, "doc_id long, text string"))
    found = [Counter(map(tuple, packing.pack(copies.repartition(n), queries.tokenizer_path()).collect())) for n in (3, 7)]
    assert found[0] == found[1]
    assert len({(r[5], r[6]) for r in found[0]}) == sum(found[0].values())


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
@settings(deadline=None)
def test_histogram_packing(histogram):
    patterns = packing.pack_histogram(histogram, 32)
    used = Counter()
    for count, pattern in patterns:
        assert sum(pattern) <= 32
        for length in pattern:
            used[length] += count
    assert used == histogram


def test_repetition_against_brute_force(documents, texts):
    for r in rows_of(repetition.apply_rules(documents)):
        text = texts[r["doc_id"]] or ""
        words = WORD.findall(text)
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(text.count(c) for c in repetition.SYMBOLS)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))

        def grams(k):
            places = defaultdict(list)
            for i in range(len(words) - k + 1):
                places[tuple(words[i : i + k])].append(i)
            return [p for p in places.values() if len(p) > 1]

        inside = {i + j for p in grams(8) for i in p for j in range(8)}
        assert r["n_repeat_words"] == len(inside)
        assert r["covered_words"] == len({i + j for p in grams(12) for i in p for j in range(12)})
        longest = r["longest_repeat"]
        assert not grams(longest + 1) and (longest == 0 or grams(longest))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        too_long = longest >= repetition.MIN_REPEAT_WORDS and (longest > repetition.MAX_LONGEST_WORDS or longest > repetition.MAX_LONGEST_FRACTION * len(words))
        assert r["kept"] == (not r["base_failed"] and r["covered_words"] <= repetition.MAX_COVERED_FRACTION * len(words) and not too_long)


@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("ab")), max_size=40))
@settings(deadline=None)
def test_longest_shared(pairs):
    pairs.sort(key=lambda p: p[0])
    found = repetition.longest_shared(np.array([ord(w) for _, w in pairs], np.uint64), np.array([d for d, _ in pairs], np.int64))
    for i, (d, _) in enumerate(pairs):
        best = 0
        for j, (e, _) in enumerate(pairs):
            k = 0
            while i != j and d == e and max(i, j) + k < len(pairs) and pairs[i + k] == pairs[j + k] and pairs[max(i, j) + k][0] == d:
                k += 1
            best = max(best, k)
        assert found[i] == best


def test_repetition_odd(odd):
    found = rows_of(repetition.apply_rules(odd))
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[3]["n_words"] == 0 and by_id[3]["base_failed"] and not by_id[3]["kept"]
    assert by_id[5]["n_repeat_words"] == 30_000 and by_id[5]["longest_repeat"] == 29_999
    assert rows_of(repetition.apply_rules(odd.limit(0))) == []


def test_quality_classifier_held_out(spark, documents):
    big = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    model = quality_model.fit(big, labels, per_class=400)
    again = quality_model.fit(big, labels, per_class=400)
    assert (model.logits == again.logits).all() and model.bias == again.bias
    held = labels.where(quality_model.remainder("doc_id", 5) == 0)
    scored = quality_model.score(big.join(held, "doc_id"), model).select("quality", "score", "predicted").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    auc = np.mean([(good.score > b).mean() for b in bad.score])
    assert auc > 0.97
    assert good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.25


MASK = (1 << 64) - 1


def plain_finish(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_word_hash(word):
    raw = word.encode()
    values = (plain_finish(((i * 256 + b + 1) * 0x9E3779B97F4A7C15) & MASK) for i, b in enumerate(raw))
    return plain_finish((sum(values) + len(raw)) & MASK)


def plain_quality_score(text, logits, bias):
    """One text's score, feature by feature in Python."""
    found = []
    for size in (3, 5):
        for i in range(len(text) - size + 1):
            gram = size
            for c in text[i : i + size]:
                gram = (gram * 0xD1342543DE82EF95 + ord(c)) & MASK
            found.append(gram)
    words = [plain_word_hash(w) for w in WORD.findall(text)]
    found += words + [(a * 3 + b) & MASK for a, b in zip(words, words[1:])]
    total = sum(float(logits[plain_finish(h) >> (64 - quality_model.BUCKET_BITS)]) for h in found)
    return 1 / (1 + math.exp(-(bias + total / max(len(found), 1))))


def test_quality_scores_against_a_plain_scorer(spark, documents, odd):
    random = np.random.default_rng(2)
    model = quality_model.QualityModel(random.normal(0, 5, 1 << quality_model.BUCKET_BITS).astype(np.float32), 0.25)
    some = documents.where("doc_id % 9 = 0").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in quality_model.score(some, model).collect():
        assert r["score"] == pytest.approx(plain_quality_score(r["text"] or "", model.logits, model.bias))
        assert r["predicted"] == (r["score"] >= 0.3)


def test_quality_sample_is_bounded_and_counts_texts_once(spark, monkeypatch):
    rows = [(i, f"text number {i} says {i % 7} things") for i in range(40)] + [(3, f"another text {i}") for i in range(60)] + [(5, "text number 5 says 5 things")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sample = lambda **k: quality_model.labelled_sample(df, labels, "quality", "doc_id", "text", 10**6, **k)
    assert len(sample(per_class=1000)) == 100 and len(sample(per_class=5)) <= 10
    monkeypatch.setattr(quality_model, "MAX_TRAIN_FEATURES", 300)
    assert 0 < sum(len(b) for _, b, _ in sample(per_class=1000)) <= 300


def test_quality_classifier_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, None), (5, 0, None), (6, 1, None), (6, 0, None), (None, 1, None), (7, None, None), (99, 0, None)], "doc_id long, quality int, text string")
    model = quality_model.fit(odd, labels, folds=1000)
    found = rows_of(quality_model.score(odd, model))
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    none = quality_model.fit(odd.limit(0), labels)
    assert {r["score"] for r in quality_model.score(odd, none).collect()} == {0.5}
    assert rows_of(quality_model.score(odd.limit(0), model)) == []


def test_quotas():
    assert mixing.quotas({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 3}, 30) == {"a": 5, "b": 10, "c": 15}
    found = mixing.quotas({"a": 100, "b": 1, "c": 0}, {"a": 1, "b": 2, "c": 3}, 101)
    assert found == {"a": 98.0, "b": 3.0, "c": 0.0}
    assert mixing.default_weights(["b", None, "a", "Z", "é"]) == {"Z": 1, "a": 2, "b": 3, "é": 1, None: 2}


@given(
    st.lists(st.tuples(st.integers(0, 3), st.sets(st.integers(0, 1), min_size=1)), min_size=1, max_size=3),
    st.tuples(st.integers(0, 5), st.integers(0, 5)),
)
@settings(max_examples=60, deadline=None)
def test_min_cost_flow(patterns, demand):
    capacity, members = [c for c, _ in patterns], [sorted(m) for _, m in patterns]
    flow = mixing.min_cost_flow(capacity, members, list(demand), 2)
    price = lambda amounts: sum(sum(1 + u // c for u in range(a)) for a, c in zip(amounts, capacity) if c)

    def fits(amounts):
        need = [0, 0, 0]
        for a, m in zip(amounts, members):
            need[2 if len(m) == 2 else m[0]] += a
        return need[0] <= demand[0] and need[1] <= demand[1] and sum(need) <= sum(demand)

    options = [a for a in product(*(range(2 * c + 1) for c in capacity)) if fits(a)]
    most = max(map(sum, options))
    given_out = [sum(f) for f in flow]
    assert sum(given_out) == most and price(given_out) == min(price(a) for a in options if sum(a) == most)
    for s in (0, 1):
        assert sum(f[m.index(s)] for f, m in zip(flow, members) if s in m) <= demand[s]


def test_mixing(spark, documents, texts):
    found = rows_of(queries.op9_mixing(spark, SF))
    assert sorted(found, key=str) == sorted(rows_of(queries.op9_mixing(spark, SF)), key=str)
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    sizes, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        longest[s] = max(longest[s], r["size"])
    assert target == pytest.approx(mixing.quotas(dict(sizes), mixing.default_weights(list(sizes)), sum(sizes.values())))
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in sizes)


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else [None]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    from pyspark.sql import functions as F

    mixed, plan = mixing.mix(df, F.col("sources"), weights={"a": 1.0, "b": 4.0, None: 1.0})
    taken = Counter()
    for r in mixed.collect():
        taken[tuple(sorted(r["sources"], key=str))] += r["taken"]
    for members, _, words in plan.patterns:
        assert abs(taken[members] - words) <= 4
    total = sum(n for _, n, _ in plan.patterns)
    assert plan.targets["b"] == pytest.approx(total * 4 / 6) and sum(taken.values()) == pytest.approx(total, abs=12)


@pytest.mark.parametrize("weights", [None, {f"s{i}": i % 5 for i in range(40)} | {None: 2.0}])
def test_mixing_of_many_sources_in_a_table_equals_the_driver(spark, monkeypatch, weights):
    from pyspark.sql import functions as F

    random = np.random.default_rng(6)
    names = [f"s{i}" for i in range(40)] + [None]
    rows = [(i, "w " * int(random.integers(0, 40)), names[0 if i % 3 == 0 else int(random.integers(0, 41))]) for i in range(1500)]
    rows += [(2000, "", "only empty" if weights is None else "s3"), (2001, "w " * 3000, "s7"), (2001, "w " * 3000, "s7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)

    def mixed():
        found, plan = mixing.mix(df, F.array("source"), weights)
        return sorted(map(tuple, mixing.with_source(found, plan, "source").select("doc_id", "source", "size", "repeats", "taken", "source_size", "target").collect()), key=str), plan

    plain, plan = mixed()
    assert isinstance(plan, mixing.MixPlan) and len(plain) == len(rows)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 6)
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 7)
    wide, table = mixed()
    assert isinstance(table, mixing.WidePlan) and 0 < table.table.where("hot").count() <= 6
    assert [r[:6] for r in wide] == [r[:6] for r in plain] and [r[6] for r in wide] == pytest.approx([r[6] for r in plain])
    overlapping = df.withColumn("both", F.when(F.col("doc_id") == 5, F.array(F.lit("s1"), F.lit("s2"))).otherwise(F.array("source")))
    with pytest.raises(ValueError, match="overlapping"):
        mixing.mix(overlapping, F.col("both"), weights)


def test_mixing_odd(odd):
    from pyspark.sql import functions as F

    mixed, plan = mixing.mix(odd, F.array("source"))
    found = rows_of(mixed)
    assert len(found) == len(ODD) and set(mixed.columns) == set(odd.columns) | {"size", "repeats", "taken"}
    taken, longest = Counter(), Counter()
    for r in found:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] == r["size"] * r["repeats"] and 0 <= r["repeats"] <= 3
        taken[r["source"]] += r["taken"]
        longest[r["source"]] += r["size"]
    # Equal rows are decided alike, so a source of few rows may be off by what those of one order say.
    assert all(abs(taken[s] - plan.targets[s]) <= longest[s] for s in longest)
    empty, plan = mixing.mix(odd.limit(0), F.array("source"))
    assert rows_of(empty) == [] and plan.targets == {}


def test_language_model(spark, documents, texts):
    found = {r["doc_id"]: r for r in rows_of(language_model.score(documents))}
    tokens = {k: [*WORD.findall(lowered(t)), "\n"] for k, t in texts.items()}
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = Counter(w for k, t in tokens.items() if k not in held for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for k, r in found.items():
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (k in held, len(tokens[k]), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens[k])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[k]))
    gain = sum(found[k]["score"] - found[k]["base_score"] for k in held) / sum(len(tokens[k]) for k in held)
    assert gain > 0.02


@pytest.mark.parametrize("tokens_a_symbol, least", [(128, 1 << 14), (1, 1 << 14), (1000, 700)])
def test_language_model_gives_vectors_beyond_the_most_frequent_words(spark, monkeypatch, tokens_a_symbol, least):
    monkeypatch.setattr(language_model, "TOKENS_A_SYMBOL", tokens_a_symbol)
    monkeypatch.setattr(language_model, "LEAST_SYMBOLS", least)
    random = np.random.default_rng(5)
    # 2000 words as frequent as each other; every second one is fixed by the one before.
    rows = [(i, " ".join(f"a{j} b{j}" for j in random.integers(0, 1000, 60))) for i in range(700)]
    found = language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").collect()
    gain = sum(r["score"] - r["base_score"] for r in found) / sum(r["n_tokens"] for r in found)
    assert gain > 0.5
    again = language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).where("held_out").collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx({r["doc_id"]: r["score"] for r in found}, rel=1e-3)


def plain_language_scores(fitted, counts, text):
    """Score of one text by the model's formula, token by token and with every symbol's product."""
    tokens, model = fitted.tokens, fitted.model
    words = len(model.bias)

    def place(word):
        key = np.int64(language_model.END) if word is None else np.array([plain_word_hash(word)], np.uint64).view(np.int64)[0]
        own = [i for i, k in enumerate(tokens.keys.tolist()) if k == key and tokens.places[i] < tokens.rest]
        return int(tokens.places[own[0]]) if own else tokens.rest + int(key) % tokens.classes

    given = [*WORD.findall(lowered(text)), None]
    places = [words] * language_model.CONTEXT + [place(w) for w in given]
    total = 0.0
    for i, word in enumerate(given):
        at = i + language_model.CONTEXT
        c = sum(model.query[places[at - k - 1]].astype(float) @ model.turn[k].astype(float) for k in range(language_model.CONTEXT))
        group = places[at] // model.width
        logits = model.group @ c + model.group_bias
        total += logits[group] - np.log(np.exp(logits).sum())
        members = range(group * model.width, min((group + 1) * model.width, words))
        logits = model.answer[members] @ c + model.bias[members]
        total += logits[places[at] - members.start] - np.log(np.exp(logits).sum())
        if places[at] >= tokens.rest:
            total += math.log(counts.get(word, 0) + 1) - fitted.log_mass[places[at] - tokens.rest] * math.log(10)
    return total / math.log(10)


def test_language_model_scores_against_plain_recomputation(spark, monkeypatch):
    for name, value in (("LEAST_SYMBOLS", 24), ("FREQUENT_WORDS", 12), ("SYMBOLS_A_ROOT", 0), ("STEPS", 200)):
        monkeypatch.setattr(language_model, name, value)
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(30)] + ["Ünï", "x" * 70]
    rows = [(k, " ".join(words[(k * j) % 32] for j in range(1, 12))) for k in range(40)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = language_model.fit(df)
    counts = Counter(w for _, t in rows for w in [*WORD.findall(lowered(t)), None])
    probes = rows + [(60, "never seen words"), (61, "w1 w1 w1 W1 " + "x" * 70), (62, None)]
    found = language_model.score_with(fitted, spark.createDataFrame(probes, "doc_id long, text string").repartition(3), F.lit(False)).collect()
    text = dict(probes)
    assert len(found) == len(probes)
    for r in found:
        assert r["score"] == pytest.approx(plain_language_scores(fitted, counts, text[r["doc_id"]]), abs=1e-4)


def test_language_model_is_normalised():
    random = np.random.default_rng(1)
    unigram = random.random(37)
    model = language_model.Model(unigram / unigram.sum())
    model.query = random.normal(0, 2, model.query.shape).astype(np.float32)
    context = np.repeat(random.integers(0, 38, (5, language_model.CONTEXT)), 37, axis=0)
    logs = language_model.Scorer(model).logs(context, np.tile(np.arange(37), 5))
    assert np.allclose(np.exp(logs).reshape(5, 37).sum(1), 1, atol=1e-4)


def plain_level(c, vectors, bias, picked):
    """Logarithms of a softmax, 1024 rows at once."""
    out = np.empty(len(c))
    for a in range(0, len(c), 1024):
        logits = c[a : a + 1024] @ vectors.T + bias
        mine = logits[np.arange(len(logits)), picked[a : a + 1024]]
        out[a : a + 1024] = mine - np.log(np.exp(logits).sum(1))
    return out


def plain_logs(model, turned, context, word):
    """``Scorer.logs`` by rows taken by an index, natural exponents and sums, a group at a time."""
    out, group = np.empty(len(word)), word // model.width
    order = np.argsort(group, kind="stable")
    c = np.zeros((len(word), language_model.DIMENSIONS), np.float32)
    for k in range(language_model.CONTEXT):
        c += turned[k][context[order, k]]
    found = plain_level(c, model.group, model.group_bias, group[order])
    edges = np.searchsorted(group[order], np.arange(model.groups + 1))
    for g, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        members = slice(g * model.width, (g + 1) * model.width)
        found[i:j] += plain_level(c[i:j], model.answer[members], model.bias[members], word[order[i:j]] - members.start)
    out[order] = found
    return out


def test_language_model_scores_faster_than_plainly():
    random, words = np.random.default_rng(6), 40_000
    unigram = 1 / np.arange(1, words + 1)
    model = language_model.Model(unigram / unigram.sum())
    scorer, turned = language_model.Scorer(model), np.stack([model.query @ t for t in model.turn])
    word = np.minimum((words ** random.random(60_000)).astype(np.int64), words - 1)
    context = np.stack([np.roll(word, k) for k in range(1, language_model.CONTEXT + 1)]).T.astype(np.int32)
    took, found = {}, {}
    for name, logs in [("plain", lambda: plain_logs(model, turned, context, word)), ("scorer", lambda: scorer.logs(context, word))] * 5:
        began = time.process_time()
        found[name] = logs()
        took[name] = min(took.get(name, math.inf), time.process_time() - began)
    assert np.allclose(found["plain"], found["scorer"], atol=1e-4)
    assert took["scorer"] < 0.8 * took["plain"]


def test_language_model_finds_words():
    random = np.random.default_rng(7)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    # Many keys that begin with the same bits, and the first and the last there are.
    keys = np.unique(np.concatenate([random.integers(low, high, 500), np.arange(300), [low, high]]))
    counts, own = random.integers(1, 99, len(keys)), random.permutation(len(keys))[:100]
    for n in (0, 1, 2, len(keys)):
        tokens = language_model.Tokens(keys[:n], counts[:n], own[own < n], 7)
        place = {int(keys[i]): p for p, i in enumerate(own[own < n])}
        count = {int(k): int(c) for k, c in zip(keys[:n], counts[:n])}
        words = np.concatenate([keys, random.integers(low, high, 500), np.arange(-9, 310)])
        places, found = tokens.find(words)
        assert found.tolist() == [count.get(w, -1) for w in words.tolist()]
        assert places.tolist() == [place.get(w, tokens.rest + w % 7) for w in words.tolist()]


def test_word_hashes_at_the_end_of_the_table():
    texts = ["a" * n + " " + "É" * (n // 2) + "Z" for n in (1, 2, 62, 63, 64, 65, 66, 129, 400)] + ["", "  ", "b"]
    data, offsets = text_buffers(pa.array(texts))
    words = Words(data, offsets, lower=True)
    assert words.hash.tolist() == [plain_word_hash(w) for t in texts for w in WORD.findall(lowered(t))]


def test_language_model_learns_from_every_place_of_its_context():
    random = np.random.default_rng(4)
    # The next word is fixed by the word two before it.
    documents = []
    for _ in range(300):
        d = random.integers(0, 20, 2).tolist()
        while len(d) < 30:
            d.append((d[-2] * 7 + 3) % 20)
        documents.append(np.array(d, np.int32))
    model = language_model.Model(np.full(20, 0.05))
    model.fit(documents, np.ones(300), 2000, 1)
    d = np.concatenate(documents[:50]).reshape(50, 30)
    logs = language_model.Scorer(model).logs(np.stack([d[:, 9], d[:, 8], d[:, 7]], 1), d[:, 10])
    assert np.exp(logs).mean() > 0.8


def test_language_model_odd(odd):
    found = rows_of(language_model.score(odd))
    assert len(found) == len(ODD) and {r["n_tokens"] for r in found if r["doc_id"] in (2, 3, 4)} == {1}
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)
    assert rows_of(language_model.score(odd.limit(0))) == []


def test_language_model_without_training(spark):
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    df = spark.createDataFrame([(key, "a b")], "doc_id long, text string")
    (row,) = rows_of(language_model.score(df))
    assert (row["train_tokens"], row["n_known"], row["base_score"], row["score"]) == (0, 0, 0, 0)


def test_kept_hash_of_everything_dropped(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    kept = [r["kept_text"] for r in line_dedup.dedup_lines(df, min_documents=2).collect()]
    assert [hashlib.sha256(k.encode()).hexdigest() for k in kept] == [hashlib.sha256(b"").hexdigest()] * 2


def test_jaccard_of_very_large_sets_at_the_threshold():
    """Sizes past 2^24 / 185 shingles, where single floats no longer hold the products."""
    for a, b, shared in ((98_734, 98_735, 90_729), (98_734, 98_735, 90_728), (110_000, 110_000, 101_082), (110_000, 110_000, 101_081)):
        left = np.arange(a, dtype=np.int64)
        right = np.concatenate([left[:shared], np.arange(10**6, 10**6 + b - shared)])
        found = jaccard_join.cell_links(np.array([7, 8]), [left, right], np.arange(2), np.arange(2), 85)
        assert bool(found) == (100 * shared >= 85 * (a + b - shared))


@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=2, max_size=14), st.integers(30, 100), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_blocked_sparse_product(sets, percent, products):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    before, jaccard_join.PRODUCTS = jaccard_join.PRODUCTS, products
    try:
        half = len(sets) // 2
        cells = [(np.arange(half), np.arange(half, len(sets))), (np.arange(len(sets)), np.arange(len(sets)))]
        for left, right in cells:
            root = list(range(len(sets)))
            find = lambda x: x if root[x] == x else find(root[x])  # noqa: E731,B023
            for x, y in jaccard_join.cell_links(np.arange(len(sets)), arrays, left, right, percent):
                assert 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and find(x) != find(y)
                root[find(x)] = find(y)
            for i in left:
                for j in right:
                    if i != j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                        assert find(i) == find(j)
    finally:
        jaccard_join.PRODUCTS = before


@pytest.mark.parametrize("length", [512, 1024, 2048, 4096])
def test_word_hashes_tell_thue_morse_words_apart(spark, length):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(length))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, f"{word} {other} " * 2)], "doc_id long, text string")
    assert {r[0]: r[2] for r in jaccard_join.jaccard_components(df, 4, 85).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r["doc_id"]: r["longest_repeat"] for r in repetition.apply_rules(df).collect()} == {1: 0, 2: 0, 3: 2}


def near_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    near = text + " tail"
    rows = [
        (1, text, "x"), (2, near, "x"), (2, "an unrelated text that has nothing to do with the others", "x"), (3, text, "x"), (3, text, "x"),
        (None, near + " more", "x"), (5, "", "x"), (5, "", "x"), (6, None, "x"), (None, "only rows without an id say this one", "x"),
        (None, "only rows without an id say this one", "x"), (8, "said twice by one id in equal rows", "x"), (8, "said twice by one id in equal rows", "x"),
        (9, "said twice by one id in two sources", "x"), (9, "said twice by one id in two sources", "y"),
    ]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("nodes", [None, 0])
def test_first_of_components_goes_by_rows(spark, monkeypatch, nodes):
    if nodes is not None:
        monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", nodes)
    rows, df = near_rows(spark)
    kept = [tuple(r) for r in jaccard_join.first_of_components(df).collect()]
    expected = [rows[0], rows[2], rows[6], rows[7], rows[8], rows[9], rows[11]]
    left = Counter(kept) - Counter(expected)
    assert Counter(expected) - Counter(kept) == Counter() and sum(left.values()) == 1 and next(iter(left))[0] == 9
    assert jaccard_join.first_of_components(df.limit(0)).collect() == []


def test_jaccard_null_ids_on_both_paths(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (None, text + " a"), (3, text + " b")], "doc_id long, text string")
    for nodes in (1 << 20, 0):
        monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", nodes)
        assert {r[2] for r in jaccard_join.jaccard_components(df, 4, 85).collect()} == {3}
