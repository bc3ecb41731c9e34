"""What writes and reads of a store cost by its size: ``python -m veritrail.measure PATH [N ...]``, a JSON line each."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession

from .store import Store


def _timed(action) -> float:
    began = time.perf_counter()
    action()
    return (time.perf_counter() - began) * 1000


def measure(spark: SparkSession, path: str, sizes: Iterable[int] = (100, 500, 2000)) -> Iterator[dict[str, Any]]:
    """n, append_ms (per record, as one table), load_ms (open and verify), purge_ms, log_kb."""
    for n in sizes:
        at = f"{path}/n{n}"
        store = Store(spark, at, "measured")
        rows = spark.range(n).selectExpr("id AS pos", "'node' AS kind", "'r' || id AS id", "'{\"text\":\"record number ' || id || '\"}' AS content", "cast(null as string) AS meta")
        append = _timed(lambda s=store, r=rows: s.append_frame(r)) / n
        load = _timed(lambda a=at: Store(spark, a, "measured"))
        purge = _timed(lambda s=store: s.purge("r0", "measured"))
        size = store.files._fs.getContentSummary(store.files._at()).getLength() / 1024
        yield {"n": n, "append_ms": round(append, 3), "load_ms": round(load, 1), "purge_ms": round(purge, 1), "log_kb": round(size, 1)}


if __name__ == "__main__":
    session = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for line in measure(session, sys.argv[1], [int(x) for x in sys.argv[2:]] or (100, 500, 2000)):
        print(json.dumps(line))
