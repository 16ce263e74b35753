"""The corpus pipeline: quality, line deduplication, near duplicates, mixing and packing of ``documents``.

Each stage takes the documents that the one before kept and returns the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import jaccard_join, line_dedup, mixing, packing, quality_model, queries
from quarrylane.llm.shared import release, remove, settle, shared_copy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of this input."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more have."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, that of the smallest id; rows without words stay."""
    return jaccard_join.first_of_components(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    mixed, _ = mixing.mix(docs.select(*COLUMNS), F.array("source"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return mixed.where("repeats > 0").withColumn("copy", copies).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, one row a piece."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the flow and the packing patterns are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each stage's documents are written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = shared_copy(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
        release(spark)
    packed = settle(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, before)
    return packed
