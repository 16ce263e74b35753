"""Incremental upsert of training histories: a stream of rows merged into a table, last non-null value first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylane.operators.history import upsert


def merged(stored: DataFrame | None, incoming: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """Stored rows overridden by the non-null values of incoming ones; one row a key, with the order of its last change."""
    both = incoming if stored is None else stored.unionByName(incoming, allowMissingColumns=True)
    return upsert(both.withColumn("_order", F.col(order)), key, "_order", [*values, order])


def start(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str, values: list[str]) -> StreamingQuery:
    """Runs the upsert for every micro-batch until the available input is used up.

    A batch is written as a new version and becomes current when its write is
    complete; a batch that is repeated after a failure writes the same version.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        stored = spark.read.parquet(f"{path}/version={number - 1}") if number else None
        merged(stored, batch.select(*key, order, *values), key, order, values).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
