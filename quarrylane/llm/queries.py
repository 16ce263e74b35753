"""The registered queries of this subpackage: ``opN_<name>`` over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import archive, exact_topk, jaccard_join, language_model, line_dedup, mixing, packing, quality_model, repetition, url_filter
from quarrylane.llm.shared import remove, settle

#: Fixed values of the contract of op1: (verdict, rule).
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def tokenizer_path() -> str:
    """The public byte-level tokenizer of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs by rules and, where none fits, by boosted trees."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line deduplication of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = line_dedup.dedup_lines(documents)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE h.k IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot h USING (k)
GROUP BY doc_id
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels outside the held-out fold."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_model.score(documents, quality_model.fit(documents, labels))
    held_out = F.coalesce(quality_model.remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenized, cut and packed into sequences."""
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, 85 %."""
    return jaccard_join.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive, read back and put together again; columns come from the records read."""
    path = archive.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    records = archive.reconstruct(*archive.read_archive(spark, path))
    header = F.decode("header", "UTF-8")
    field = lambda pattern: F.regexp_extract(header, pattern, 1)
    number = lambda c: F.expr("try_cast(%s AS BIGINT)" % c)
    found = records.select(
        F.length("payload").cast("long").alias("payload_bytes"),
        field(r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]{32})\r\n").alias("payload_digest"),
        field(r"\r\nWARC-Type: (\w+)\r\n").alias("record_type"),
        field(r"\r\nWARC-Record-ID: <urn:page:(-?\d*)>\r\n").alias("own"),
        field(r"\r\nWARC-Refers-To: <urn:page:(-?\d*)>\r\n").alias("other"),
    ).select(
        number("own").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("other").alias("refers_to")
    )
    # The digests are kept and the archive goes.
    found = settle(found)
    remove(spark, path)
    return found


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS best FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
      '0000000100100011010001010110011110001001101010111100110111101111',
      CAST(4 * (strpos('0123456789abcdef', substr(hex, CAST(i AS INTEGER), 1)) - 1) + 1 AS INTEGER), 4)), '') AS bits
  FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
      + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
      + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
      + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the suffix-array verdict of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition.apply_rules(documents).drop("text")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    whole = F.transform("embedding", lambda x: exact_topk.floored(256 * x.cast("double")))
    components = F.when(exact_topk.usable(F.col("embedding")), whole)
    return exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0, components)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights 1, 2, 3, repeating."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed, plan = mixing.mix(documents, F.array("source"))
    return mixing.with_source(mixed, plan, "source").select("doc_id", "size", "source_size", "target", "taken")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear scores of all documents."""
    return language_model.score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage."""
    return {
        f.__name__: f
        for f in (
            op1_url_filter, op2_line_dedup, op3_quality_classifier, op4_packing, op5_jaccard_join,
            op6_warc_archive, op7_repetition_rules, op8_exact_topk, op9_mixing, op10_language_model,
        )
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op2_line_dedup": OP2_SQL, "op6_warc_archive": OP6_SQL, "op8_exact_topk": OP8_SQL}
