"""A content-addressed WARC archive in two tables.

``payloads(sha256, size, payload)`` holds the bytes of every distinct payload once;
``records`` holds each record's exact header bytes, the digest of its payload and
its place.  Original records are put together again by a join of the two, with the
stored digest and size verified against the bytes.

Which record keeps a payload is found on digests alone; payload bytes cross one
shuffle when an archive is written and one when records are put together again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm.shared import settle, shared_dir

#: Payloads under this size are never revisited: each of their records is a response.
MIN_REVISIT_BYTES = 0
#: Fixed value: the base-32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = "record_id long, sha256 binary, sha1 string, payload_bytes long, record_type string, refers_to long, header binary"
PAYLOAD_SCHEMA = "sha256 binary, size long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary column: 160 bits are 8 groups of 20, 4 characters each."""
    digest = F.sha1(payload)
    characters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        characters += [F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*characters)


def assign_roles(digested: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds ``record_type`` and ``refers_to``: of equal payloads the largest id is the response.

    Payloads under ``min_bytes`` are all responses.  Rows with a null id are
    revisits if an equal payload has an id.  Repeated rows with the largest id
    are all responses.  The maximum is pre-aggregated before its shuffle and settled,
    so that the join back is a plain one whose skewed digests are split.
    """
    best = settle(digested.groupBy("sha256").agg(F.max("record_id").alias("best")).withColumnRenamed("sha256", "best_sha256"))
    joined = digested.join(best, F.col("sha256") == F.col("best_sha256"))
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("best").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("best"))
    return joined.withColumns(
        {
            "record_type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            "refers_to": F.when(revisit, F.col("best")),
        }
    ).drop("best_sha256", "best")


def record_header(date: str) -> Column:
    """The exact header block of one WARC/1.1 record, with its closing empty line, from the columns of a record."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("uri") == "", F.lit("")).otherwise(line("WARC-Target-URI", F.col("uri"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return F.encode(text, "UTF-8")


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    id_column: str = "page_id",
    uri_column: str = "url",
    payload_column: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_bytes: int = MIN_REVISIT_BYTES,
) -> str:
    """Writes one record a row and returns the archive's path (in the shared folder unless given).

    A null payload is empty; a null URI gives a record without a target; rows with
    a null id are written with an empty record id.  Line ends in a URI are removed,
    so that they cannot forge a header.  Extra columns are ignored; an empty table
    gives an empty archive that reads back.
    """
    path = path or f"{shared_dir(pages.sparkSession).rstrip('/')}/archive-{uuid.uuid4().hex}"
    given = pages.select(
        F.col(f"`{id_column}`").cast("long").alias("record_id"),
        F.regexp_replace(F.coalesce(F.col(f"`{uri_column}`"), F.lit("")), r"[\r\n]+", "").alias("uri"),
        F.coalesce(F.col(f"`{payload_column}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    digested = settle(
        given.select("record_id", "uri", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("payload_bytes"))
    )
    records = assign_roles(digested, min_bytes).withColumn("header", record_header(date)).drop("uri")
    records.select(*[c.split()[0] for c in RECORD_SCHEMA.split(", ")]).write.option("compression", "zstd").parquet(f"{path}/records")
    # Equal payloads meet in one row before the shuffle (one a task), so a hot payload is not gathered.
    payloads = given.select("sha256", F.length("payload").cast("long").alias("size"), "payload")
    payloads.groupBy("sha256", "size").agg(F.any_value("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The archive's ``records`` and its verified ``payloads``; bytes that differ from their digest raise an error."""
    stored = spark.read.schema(PAYLOAD_SCHEMA).parquet(f"{path}/payloads")
    right = (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (F.length("payload") == F.col("size"))
    verified = stored.withColumn(
        "payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary"))
    )
    return spark.read.schema(RECORD_SCHEMA).parquet(f"{path}/records"), verified


def reconstruct(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Records with ``payload`` (of a revisit: that of the record it refers to) and the exact ``record`` bytes."""
    kept = payloads.select(F.col("sha256").alias("stored_sha256"), F.col("payload"))
    joined = records.join(kept, F.col("sha256") == F.col("stored_sha256")).drop("stored_sha256")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))


def parse_header(header: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line is under ``version``."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    fields = {"version": lines[0]}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields
