"""The pipeline, stage by stage, against plain Python on what each stage was given."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quarrylane.llm import packing
from tests.llm.conftest import SF
from tests.llm.test_documents import WORD, linked_components, lowered


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, as each next stage gets them."""
    from quarrylane.llm.shared import shared_copy

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [[tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = shared_copy(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        rows.append([tuple(r) for r in docs.collect()])
    return rows


def test_quality_keeps_good_documents(spark, kept):
    given, left = Counter(kept[0]), Counter(kept[1])
    assert not left - given
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stays = {r[0] for r in kept[1]}
    good, bad = ([k in stays for k, q in labels.items() if q == want] for want in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_lines(kept):
    keys = {r[0]: [lowered(line).strip(" \t\n\x0b\x0c\r") for line in r[1].split("\n")] for r in kept[1]}
    often = Counter(k for found in keys.values() for k in set(found))
    expected = Counter()
    for key, text, lang, source, _ in kept[1]:
        lines = [line for line, k in zip(text.split("\n"), keys[key]) if not k or often[k] < 10]
        expected[(key, "\n".join(lines), lang, source, len("\n".join(lines)))] += 1
    assert Counter(kept[2]) == expected


def test_one_of_each_group_stays(kept):
    groups = linked_components({r[0]: r[1] for r in kept[2]}, 5, 80)
    expected = {k for k, (n, c) in groups.items() if k == c}
    assert {r[0] for r in kept[3]} == expected and len(kept[3]) == len(expected)


def test_mix_is_near_its_targets(kept):
    from quarrylane.llm.mixing import default_weights, quotas

    given, taken = Counter(kept[3]), Counter(kept[4])
    assert all(r in given and n <= 3 * given[r] for r, n in taken.items())
    size, target_words, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept[3]:
        size[r[3]] += len(WORD.findall(r[1]))
        longest[r[3]] = max(longest[r[3]], len(WORD.findall(r[1])))
    for r in kept[4]:
        target_words[r[3]] += len(WORD.findall(r[1]))
    for source, target in quotas(dict(size), default_weights(list(size)), sum(size.values())).items():
        assert abs(target_words[source] - target) <= longest[source] / 2 + 1


def test_everything_is_packed(kept):
    from quarrylane.llm.queries import tokenizer_path

    encoder = packing.Encoder(tokenizer_path())
    expected = sum(len(encoder.encode(r[1])) // 4 + 1 for r in kept[4])
    assert sum(p[2] for p in kept[5]) == expected
    fill = defaultdict(int)
    for p in kept[5]:
        fill[p[5]] += p[2]
    assert max(fill.values()) <= 2048


def test_run_and_odd_rows(spark, odd):
    assert corpus_pipeline.run(spark, SF).count() > 0
    # Each stage on the odd rows themselves: what it may return of them.
    given = Counter(tuple(r) for r in odd.select(*corpus_pipeline.COLUMNS).collect())
    found = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES}
    rows = {name: Counter(tuple(r) for r in df.collect()) for name, df in found.items()}
    assert not rows["quality classifier"] - given
    assert rows["line dedup"] == Counter({(i, t or "", lang, s, len(t or "")): n for (i, t, lang, s, _), n in given.items()})
    near = rows["n-gram Jaccard join"]
    assert not near - given and sum(given.values()) - sum(near.values()) == 2
    assert sum(n for r, n in near.items() if r[1] == "a b c d e f g h") == 1 and sum(n for r, n in near.items() if r[0] == 6) == 1
    mixed = rows["mixing sources to target weights"]
    assert set(mixed) <= set(given) and all(n <= 3 * given[r] for r, n in mixed.items())
    pieces = found["packing"].where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces} == Counter(r[0] for r in given.elements())
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert all(r["length"] >= 1 and r["start"] + r["length"] <= r["doc_tokens"] for r in docs.collect())
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
