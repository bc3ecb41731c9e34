"""What plans need from the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Where it names none: in one process a folder of this machine will do; on a cluster
    it is one below the warehouse, which all executors reach.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        top = f"/tmp/checkpoints/{uuid.uuid4().hex}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or top)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, which outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers by a few MB, not by the 64 MB that a session allows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
