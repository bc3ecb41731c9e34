"""The record log: JSON lines in, versioned Parquet inside, one writer at a time.

A store is a folder: ``v<n>/`` holds the rows of version n, and the empty file
``v<n>.ready`` is made once they are complete.  The highest ready version counts, so
there is no moment without one.  Appends add files to it; a purge writes the next
version, makes it ready and removes what was before, so erased content leaves the
disk; what a crash left behind is removed by the next writer.  All access goes through
Hadoop's file system, so any shared store will do.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.canonical import canonicalise
from ..schema import KINDS, RECORD

LOCK_WAIT_S, LOCK_RETRY_S, LOCK_STALE_S, LOCK_BEAT_S = 5.0, 0.015, 30.0, 5.0
_READY, _VERSION = re.compile(r"v(\d+)\.ready"), re.compile(r"v(\d+)(?:\.ready)?")
_LINE = "kind string, id string, seq long, prev string, digest string, contentDigest string, salt string, content string, meta string"


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The log of a JSON-lines file: RECORD plus ``pos`` (where each line stands).

    Blank lines are skipped.  A malformed line or an unknown kind aborts; with
    ``strict`` off it becomes a row whose ``problem`` is the reason code.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("pos"))
    rows = lines.select("pos", F.try_parse_json("value").alias("j"), F.from_json("value", _LINE, {"mode": "PERMISSIVE"}).alias("r"))
    known = F.coalesce(F.col("r.kind").isin(*KINDS), F.lit(False))
    problem = F.when(F.col("j").isNull() | F.col("r.id").isNull() | F.col("r.seq").isNull(), "malformed_line").when(~known, "unknown_kind")
    out = rows.select(
        F.try_variant_get("j", "$.meta.workspace", "string").alias("workspace"), "r.seq", "r.kind", "r.id", "r.prev", "r.digest", F.col("r.contentDigest").alias("content_digest"),
        "r.salt", canonicalise(F.to_json(F.try_variant_get("j", "$.content", "variant"))).alias("content"), canonicalise(F.to_json(F.try_variant_get("j", "$.meta", "variant"))).alias("meta"),
        "pos", problem.alias("problem"),
    )
    # a JSON null is a purged content, not the text "null"
    out = out.withColumn("content", F.when(F.col("content") != "null", F.col("content")))
    if not strict:
        return out
    bad = out.where("problem is not null").select("problem").first()
    if bad is not None:
        raise EngineError(bad["problem"])
    return out.drop("problem")


class LogStore:
    """Files of one store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _names(self) -> list[str]:
        return [status.getPath().getName() for status in self._fs.listStatus(self._at())] if self._fs.exists(self._at()) else []

    def version(self) -> int:
        return max((int(m[1]) for name in self._names() if (m := _READY.fullmatch(name))), default=0)

    def _sweep(self, current: int) -> None:
        """Removes every version but one, their markers first."""
        for name in sorted(self._names(), key=lambda name: not name.endswith(".ready")):
            m = _VERSION.fullmatch(name)
            if m and int(m[1]) != current:
                self._fs.delete(self._at(name), True)

    def read(self) -> DataFrame:
        """A missing store is an empty one."""
        n = self.version()
        return self.spark.read.schema(RECORD).parquet(f"{self.path}/v{n}") if n else self.spark.createDataFrame([], RECORD)

    def _holder(self) -> str | None:
        try:
            stream = self._fs.open(self._at("LOCK"))
        except Exception:  # it went meanwhile
            return None
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _touch(self, ended: threading.Event) -> None:
        """Tells others that the holder is alive."""
        while not ended.wait(LOCK_BEAT_S):
            self._fs.setTimes(self._at("LOCK"), int(time.time() * 1000), -1)

    def _break(self) -> None:
        """Moves a lock aside that has not been touched for too long, unless it is another's by then."""
        stale, aside = self._holder(), f"LOCK.{uuid.uuid4().hex}"
        if stale is None or not self._fs.rename(self._at("LOCK"), self._at(aside)):
            return
        self._fs.delete(self._at(aside), False)

    @contextmanager
    def lock(self, wait: float = LOCK_WAIT_S):
        """One writer: an exclusively created file with the holder's token, touched while it is held.

        One that nobody has touched for ``LOCK_STALE_S`` is moved aside; a holder removes its own only.
        """
        began, token = time.monotonic(), uuid.uuid4().hex
        self._fs.mkdirs(self._at())
        while True:
            try:
                self._put("LOCK", token, overwrite=False)
                break
            except Exception as held:  # py4j wraps the file system's own exceptions
                if "exist" not in str(held).lower():
                    raise
                try:
                    age = time.time() - self._fs.getFileStatus(self._at("LOCK")).getModificationTime() / 1000
                except Exception:  # it went meanwhile
                    continue
                if age > LOCK_STALE_S:
                    self._break()
                elif time.monotonic() - began > wait:
                    raise EngineError("lock_timeout") from None
                time.sleep(LOCK_RETRY_S)
        ended = threading.Event()
        beat = threading.Thread(target=self._touch, args=(ended,), daemon=True)
        beat.start()
        try:
            yield
        finally:
            ended.set()
            beat.join()
            if self._holder() == token:
                self._fs.delete(self._at("LOCK"), False)

    def append(self, rows: DataFrame) -> None:
        """Under the lock: add rows to the current version."""
        n = self.version()
        self._sweep(n)
        rows.select(*RECORD.fieldNames()).write.mode("append").parquet(f"{self.path}/v{n or 1}")
        if not n:
            self._put("v1.ready", "", overwrite=True)

    def rewrite(self, rows: DataFrame) -> None:
        """Under the lock: replace everything, then remove what was."""
        n = self.version() + 1
        rows.select(*RECORD.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/v{n}")
        self._put(f"v{n}.ready", "", overwrite=True)
        self._sweep(n)


def citations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records: id, text; edges: source, target, type, weight) of a folder of markdown notes.

    A note that names another one (``DEC-`` and three digits) was informed by it; one
    that says it supersedes another was caused by it.
    """
    notes = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"(DEC-[0-9]{3})", 1).alias("id"), F.col("value").alias("text")).where("id <> ''")
    named = notes.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(DEC-[0-9]{3})\b"), F.lit(1)))).alias("other")).where("id <> other")
    over = notes.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)supersedes[^\n]*?\b(DEC-[0-9]{3})\b"), F.lit(1)))).alias("other")).where("id <> other")
    known = notes.select(F.col("id").alias("other"))
    edges = named.select(F.col("other").alias("source"), F.col("id").alias("target"), F.lit("INFLUENCED").alias("type"), F.lit(0.6).alias("weight"), "other")
    edges = edges.unionByName(over.select(F.col("other").alias("source"), F.col("id").alias("target"), F.lit("CAUSED").alias("type"), F.lit(0.95).alias("weight"), "other"))
    return notes, edges.join(known, "other", "left_semi").drop("other")
