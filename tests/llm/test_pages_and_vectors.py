"""URL filter, archive and top-k search against brute force, and on odd and empty tables."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import archive, exact_topk, queries, url_filter
from tests.llm.conftest import SF

URLS = [
    (1, "https://WWW.Example.COM/en/7?x=1#y", "a"), (2, None, "a"), (3, "no scheme", None), (4, "http://", ""), (5, "ftp://h?p/q", "b"),
    (6, "http://example.com/en/8", "b"), (7, "http://notexample.com/en/7", "b"), (8, "x://a.net/de/8#/f", "é"), (8, "x://a.net/de/8#/f", "é"),
    (None, "http://b.org/es/" + "z" * 100_000, "q" * 100_000), (9, "http://example.net/de/8/\n?q", None), (10, "http://u.com/en/://other.org/es/", "a"),
]


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def plain_rule(host, path):
    fits = []
    for verdict, rule in queries.URL_RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*u, None, None) for u in URLS], "page_id long, url string, html string, verdict long, _one string").drop("_one")


def test_url_rules(spark, pages):
    found = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(found) == len(URLS)
    for r in found:
        assert (r["host"], r["path"]) == plain_host_path(r["url"])
        rule, verdict = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).collect() == []


def test_url_query(spark):
    found = queries.op1_url_filter(spark, SF).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in found:
        assert (r["host"], r["path"]) == plain_host_path(urls[r["page_id"]])
        assert r["rule"] == plain_rule(r["host"], r["path"])[0]


def test_trees_learn_lexical_labels(spark):
    random = np.random.default_rng(3)
    urls = []
    for i in range(4000):
        bad = i % 2
        path = "".join(random.choice(list("0123456789abcdef" if bad else "abcdefghij"), 12))
        urls.append((i, f"http://site{i % 50}.{'biz' if bad and i % 3 else 'org'}/{path}" + "?a=1&b=2" * bad * int(random.integers(0, 2)), bad))
    df = spark.createDataFrame(urls, "id long, url string, label int")
    # The rest has its labels hidden and is scored by what the others taught.
    work = url_filter.with_features(url_filter.parsed(df, "url").withColumn("_blocked", F.expr("CASE WHEN id % 5 <> 0 THEN label END")))
    model = url_filter.fit(work, per_verdict=1500)
    rows = work.where("id % 5 = 0").select("_x", "label").collect()
    right = (model.probability(np.array([r["_x"] for r in rows])) >= 0.5) == np.array([r["label"] for r in rows], bool)
    assert right.mean() > 0.95


def plain_features(url):
    host, path = plain_host_path(url)
    url = url or ""
    n = max(len(url), 1)
    query = url.partition("#")[0].partition("?")[2]
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum("0" <= c <= "9" for c in url) / n,
        -sum(c / n * math.log2(c / n) for c in Counter(url).values()), query.count("=") + query.count("&"), len(query), "#" in url,
        url.count("-") + url.count("_"), max([len(r) for r in re.findall("[0-9]+", url)] or [0]), url.startswith("https:"),
        sum("A" <= c <= "Z" for c in url) / n, sum(ord(c) > 126 or c == "%" for c in url) / n, len(path.rpartition("/")[2]),
    ]


def test_features_and_verdicts_against_brute_force(spark, pages):
    """Lexical features, suffix statistics on other folds, and tree sums, all computed plainly."""
    work = url_filter.parsed(pages.withColumn("given", F.col("url")), "url")
    work = work.withColumn("_blocked", F.expr("CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 4 = 0 AS INT) END"))
    rows = url_filter.with_features(work).collect()
    assert len(rows) == len(URLS)
    known = {}
    for r in rows:
        known[r["_url"]] = (r["_one"], r["_two"], r["_fold"], max((x["_blocked"] for x in rows if x["_url"] == r["_url"] and x["_blocked"] is not None), default=None))
    for r in rows:
        assert r["_x"][:16] == pytest.approx([float(v) for v in plain_features(r["given"])])
        for k, at in ((0, 16), (1, 17)):
            same = [v for v in known.values() if v[k] == r["_one" if k == 0 else "_two"]]
            assert r["_x"][at] == pytest.approx(math.log1p(len(same)))
            others = [v[3] for v in same if v[3] is not None and (r["_blocked"] is None or v[2] != r["_fold"])]
            assert r["_x"][at + 2] == pytest.approx((sum(others) + 1) / (len(others) + 2))
    random = np.random.default_rng(1)
    x = random.random((500, 3))
    model = url_filter.UrlModel(*url_filter.boost(x, (x[:, 0] > x[:, 1]).astype(float)))
    for row, p in zip(x, model.probability(x)):
        total = model.base
        for tree in model.trees:
            node = 0
            while node < len(tree.feature):
                node = 2 * node + (2 if row[tree.feature[node]] > tree.threshold[node] else 1)
            total += url_filter.RATE * tree.value[node - len(tree.feature)]
        assert p == pytest.approx(1 / (1 + math.exp(-total)))


def test_one_hot_url_is_not_the_sample(spark):
    rows = [(i, "http://hot.com/en/", 1) for i in range(3000)] + [(i, f"http://s{i}.com/en/{i}", 1) for i in range(900)] + [(i, f"http://t{i}.org/{i}", 0) for i in range(900)]
    work = url_filter.with_features(url_filter.parsed(spark.createDataFrame(rows, "id long, url string, _blocked int"), "url"))
    seen = []
    plain = url_filter.boost
    try:
        url_filter.boost = lambda x, y: seen.append((x, y)) or plain(x, y)
        url_filter.fit(work, per_verdict=200)
    finally:
        url_filter.boost = plain
    (x, y) = seen[0]
    assert (y == 1).sum() == (y == 0).sum() == 200 and (x[:, 0] == len("http://hot.com/en/")).sum() <= 1


def test_boosting_of_one_class():
    assert url_filter.boost(np.zeros((3, 2)), np.ones(3))[0] > 0
    assert url_filter.boost(np.zeros((0, 2)), np.zeros(0)) == (0.0, [])


def test_archive_round_trip(spark, pages):
    path = archive.write_archive(pages)
    records, payloads = archive.read_archive(spark, path)
    back = archive.reconstruct(records, payloads).collect()
    assert len(back) == len(URLS)
    distinct = {(h or "").encode() for _, _, h in URLS}
    assert payloads.count() == len(distinct)
    largest = {p: max((i for i, _, h in URLS if (h or "").encode() == p and i is not None), default=None) for p in distinct}
    html = {i: (h or "").encode() for i, _, h in URLS}
    for r in back:
        payload = bytes(r["payload"])
        assert payload == html[r["record_id"]] and r["payload_bytes"] == len(payload)
        fields = archive.parse_header(bytes(r["header"]))
        assert fields["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        response = r["record_id"] == largest[payload]
        assert fields["warc-type"] == r["record_type"] == ("response" if response else "revisit")
        block = payload if response else b""
        assert bytes(r["record"]) == bytes(r["header"]) + block + b"\r\n\r\n" and int(fields["content-length"]) == len(block)
        assert r["refers_to"] == (None if response else largest[payload])


def test_archive_small_payloads_and_empty_table(spark, pages):
    records, payloads = archive.read_archive(spark, archive.write_archive(pages, min_bytes=2))
    kinds = {(r["payload_bytes"], r["record_type"]) for r in records.collect()}
    assert (1, "revisit") not in kinds and (0, "revisit") not in kinds
    records, payloads = archive.read_archive(spark, archive.write_archive(pages.limit(0)))
    assert archive.reconstruct(records, payloads).collect() == []


def test_archive_notices_changed_bytes(spark, pages, tmp_path):
    path = archive.write_archive(pages, path=str(tmp_path / "archive"))
    spark.createDataFrame([(b"0" * 32, 1, b"x")], archive.PAYLOAD_SCHEMA).write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        archive.read_archive(spark, path)[1].collect()


def plain_top(vectors, k):
    out = set()
    for q, v in vectors:
        if q % 3 == 0:
            scores = {}
            for c, w in vectors:
                if c != q:
                    n = min(len(v), len(w))
                    scores[c] = max(scores.get(c, -(10**30)), sum(a * b for a, b in zip(v[:n], w[:n])))
            for i, (s, c) in enumerate(sorted(((-s, c) for c, s in scores.items()))[:k]):
                out.add((q, i + 1, c, -s))
    return out


def test_top_k_with_ties_and_many_cells(spark):
    random = np.random.default_rng(8)
    vectors = [(i, random.integers(-3, 4, 6).tolist()) for i in range(300)] + [(300, [0] * 6), (301, [1, 2])]
    df = spark.createDataFrame(vectors + vectors[:5], "vec_id long, v array<int>")
    found = exact_topk.top_k(df, F.col("vec_id") % 3 == 0, F.col("v"), band_vectors=70, block_queries=40).collect()
    assert {tuple(r) for r in found} == plain_top(vectors, 5) and len(found) == len(plain_top(vectors, 5))


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, -1.0]), (None, [9.0, 9.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = F.transform("embedding", lambda x: exact_topk.floored(256 * x.cast("double")))
    parts = F.when(exact_topk.usable(F.col("embedding")), whole)
    found = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, parts).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 6, 0), (0, 2, 5, 256 * 128 - 512 * 256)]
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, parts).collect() == []


def test_top_k_large_components_and_clashing_columns(spark):
    rows = [(0, [1e8, 2.0], "x", "y"), (1, [1e8, 1.0], "x", "y"), (2, [1e8, 2.0], None, "y"), (3, [3e38, 1.0], "x", "y"), (4, [-3e38, 1.0], "x", "y"), (5, [0.0, 0.5], "x", None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, id string")
    whole = F.transform("embedding", lambda x: exact_topk.floored(256 * x.cast("double")))
    found = exact_topk.top_k(df, F.col("vec_id") == 0, F.when(exact_topk.usable(F.col("embedding")), whole)).collect()
    big, largest = 25_600_000_000, 2**63 - 1
    # Scores past a long are cut to it, and cut scores are ties.
    expected = [(0, 1, 1, largest), (0, 2, 2, largest), (0, 3, 3, largest), (0, 4, 5, 512 * 128), (0, 5, 4, -largest)]
    assert big * big > largest and sorted(tuple(r) for r in found) == expected


@pytest.mark.parametrize("scale", [1, 10**7])
def test_top_k_over_bands_of_different_lengths(spark, scale):
    random = np.random.default_rng(12)
    vectors = [(i, (random.integers(-4, 5, 8) * scale * int(random.integers(1, 9))).tolist()) for i in range(260)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    found = exact_topk.top_k(df, F.col("vec_id") % 3 == 0, F.col("v"), band_vectors=40, block_queries=30).collect()
    assert {tuple(r) for r in found} == plain_top(vectors, 5) and len(found) == len(plain_top(vectors, 5))


def test_first_by_hash_is_the_plain_order(spark):
    from quarrylane.llm.shared import first_by_hash

    rows = spark.range(5000).withColumn("k", F.col("id") % 4000)
    plain = rows.orderBy(F.xxhash64("k"), "id").limit(50).collect()
    assert first_by_hash(rows, F.xxhash64("k"), ["id"], 50, 5000) == plain
    assert first_by_hash(rows, F.xxhash64("k"), ["id"], 50, 10**9) == plain
