"""Streams: watermarked window counts, and incremental verification of a growing log."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import checkpoint_dir


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "6 hours") -> DataFrame:
    """window_start, event_type, n, total of a stream (or a batch) with ts, event_type, value."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through a file sink in the shared folder; read back as a batch."""
    spark: SparkSession = stream.sparkSession
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "complete":  # each batch replaces what the one before said
        query = sink.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")).start()
    else:
        query = sink.format("parquet").option("path", f"{at}/out").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def chain_breaks(log: DataFrame) -> DataFrame:
    """workspace, seq, id, reason: links of a streamed log that do not follow the last digest seen.

    State is one (seq, digest) per workspace, so the stream may run for ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, digest = state.get if state.exists else (0, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if (r.prev if isinstance(r.prev, str) else None) != digest:
                out.append((key[0], int(r.seq), r.id, "chain_break"))
            if int(r.seq) != seq + 1:
                out.append((key[0], int(r.seq), r.id, "sequence_gap"))
            seq, digest = int(r.seq), r.digest
        state.update((seq, digest))
        yield pd.DataFrame(out, columns=["workspace", "seq", "id", "reason"])

    return log.groupBy("workspace").applyInPandasWithState(step, "workspace string, seq long, id string, reason string", "seq long, digest string", "append", GroupStateTimeout.NoTimeout)
