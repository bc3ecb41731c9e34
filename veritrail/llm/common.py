"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable


BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def sample_share(keys: Column, share: float) -> Column:
    """True for a fixed pseudo-random share of the keys."""
    bound = int(min(1.0, max(0.0, share)) * (2**31))
    return F.pmod(F.xxhash64(keys, F.lit(0x5EED)), F.lit(2**31)) < F.lit(bound)


def batches_of_bytes(values: Iterable[bytes | None], limit: int) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges whose texts stay under ``limit`` bytes, one row at least."""
    start = size = 0
    count = 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
        count = i + 1
    if count > start:
        yield start, count


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts) of runs of a binary column that stay under ``limit`` bytes, one row at
    least, so that only one run at a time is copied out of Arrow."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + limit, "right")))
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def releasing(run: Callable) -> Callable:
    """For functions over batches in Python workers, which are kept for later tasks: what one has
    used for its batches goes back to the system when it ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers by a few MB, not by the 64 MB that a session allows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def rewritten(docs: DataFrame, row: Column, text: Column) -> list[Column]:
    """The columns of ``docs`` from a struct of them, with a new text; n_chars follows it where it changed."""
    columns = {c: row[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(text.eqNullSafe(row["text"]), row["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return [columns[c].alias(c) for c in docs.columns]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join ``rows`` with a table of one row per key, however often a key occurs in ``rows``.

    The table is written first: both sides of the join then are plain shuffles, of which
    adaptive execution splits the partition of a hot key (or broadcasts a table that
    turns out to be small).  A table aggregated by the same keys inside the plan would
    share the shuffle of its aggregation and bar that.
    """
    return rows.join(durable(table), keys, "left")
