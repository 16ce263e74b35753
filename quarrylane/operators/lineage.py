"""Reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Where checkpoints go if neither the session nor the cluster names a folder (tests on one machine).
LOCAL_DIR = "/tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """A folder of its own for one query, in the folder that driver and executors share."""
    import uuid

    _folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/scratch-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage; executors may be lost afterwards."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> None:
    """Sets a checkpoint folder where there is none."""
    context = spark.sparkContext
    inner = context._jsc.sc()
    inner.conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not inner.getCheckpointDir().isDefined():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or LOCAL_DIR)
