"""Line deduplication with DataFrame functions only.

Lines are exploded as 128-bit hashes of their normalised form (no text), distinct
documents are counted per hash, the hashes at or over the threshold are joined
back to the line positions, and each document is put together again from the
positions it keeps.  Lines are shuffled once, as arrays that the text was split into
before the last join; every step costs a document as much as it has lines.

Hot lines: the count is pre-aggregated before its shuffle (one row for a hash and
task at most, after the distinct step on hash *and* document), and the join with
the hot hashes is a plain shuffled join of two settled inputs, whose skewed
partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.shared import SPACES, ascii_lower, key_of, settle

#: Production parameters.
MIN_DOCUMENTS = 10
MIN_KEY_LENGTH = 1


def dedup_lines(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_key_length: int = MIN_KEY_LENGTH,
) -> DataFrame:
    """``documents`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added; all rows and columns stay.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased.  A line goes if its key has ``min_key_length`` code points or more
    and is in ``min_documents`` documents or more.

    Nulls and empty texts are one empty line.  A document is a distinct id for the
    count; rows with a null id count as one document together.  Repeated rows all
    stay, each with the same result.  Very long texts cost time in proportion to their
    lines; one text must fit a task.  Columns of the input named like an added
    column are replaced by it.  An empty table gives an empty table.
    """
    given = documents.drop("kept_text", "n_lines", "n_dropped", "_lines", "_a", "_b")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    first, second = key_of(text)
    row = F.struct(F.col(f"`{id_column}`").alias("id"), first.alias("a"), second.alias("b"))
    keys = F.transform(F.split(text, "\n", -1), lambda line: ascii_lower(F.btrim(line, F.lit(SPACES))))
    one, two = key_of(F.col("key"))
    # Hashes of whole texts are made before lines are exploded, once a document.
    lines = (
        given.select(row.alias("row"), keys.alias("keys"))
        .select("row", F.posexplode("keys").alias("position", "key"))
        .where(F.char_length("key") >= max(min_key_length, 0))
        .select("row", "position", one.alias("one"), two.alias("two"))
    )
    counted = lines.select("one", "two", F.coalesce(F.xxhash64("row.id"), F.lit(0)).alias("id"), F.col("row.id").alias("exact"))
    hot = (
        counted.groupBy("one", "two", "id", "exact").agg(F.lit(1).alias("n"))
        .groupBy("one", "two").agg(F.count("n").alias("n"))
        .where(F.col("n") >= min_documents)
        .select(F.col("one").alias("hot_one"), F.col("two").alias("hot_two"))
    )
    hot = settle(hot)
    dropped = (
        lines.join(hot, (F.col("one") == F.col("hot_one")) & (F.col("two") == F.col("hot_two")))
        .groupBy("row").agg(F.collect_set("position").alias("gone"))
        .select(F.col("row.id").alias("gone_id"), F.col("row.a").alias("gone_a"), F.col("row.b").alias("gone_b"), "gone")
    )
    # Split below the join, so that no line is looked up in anything but a column that exists.
    whole = given.withColumns({"_lines": F.split(text, "\n", -1), "_a": first, "_b": second})
    joined = whole.join(
        dropped,
        F.col(f"`{id_column}`").eqNullSafe(F.col("gone_id")) & (F.col("_a") == F.col("gone_a")) & (F.col("_b") == F.col("gone_b")),
        "left",
    )
    n = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.array_join(F.when(F.col("gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i))), "\n")
    return joined.select(
        *[F.col(f"`{c}`") for c in given.columns],
        kept.alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long")).alias("n_dropped"),
    )
