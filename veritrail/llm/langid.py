"""Language identification by multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (n-gram bucket by language) that is
fitted on a bounded sample of labelled rows and broadcast; its size is fixed by
``buckets`` and the number of languages.  Scoring walks Arrow batches: the
n-gram buckets of a batch form a sparse count matrix in coordinate form, whose
product with the log-probability matrix is taken by gathering and summing rows.

Defined cases
    null text, empty text or text without a letter -> ``und``, score 0.0;
    no labelled row at all -> every row is ``und``, score 0.0;
    a null id is scored like any other and is never held out or learned from;
    repeated rows are scored row by row; equal scores go to the smaller label;
    other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, releasing, sample_share, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
CHUNK = 1 << 19
#: Fitting uses about this many labelled rows of a language at most.
TRAIN_ROWS_PER_LANG = 600


def _pieces(texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Code points of lower-cased texts in runs of about CHUNK: ([(row, n counted starts)], points).

    Each piece is followed by ``max(ORDERS) - 1`` points of what comes next in its
    text, or zeros at its end, so n-grams never depend on neighbours in the batch; one
    more zero ends a run, so that every counted start has its n-gram.
    """
    tail = max(ORDERS) - 1
    end = np.zeros(1, np.uint32)
    rows: list[tuple[int, int]] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([points, np.zeros(tail, np.uint32)])
        for at in range(0, max(1, len(points) - tail), CHUNK):
            n = min(CHUNK, len(points) - tail - at)
            if n <= 0:
                continue
            rows.append((i, n))
            parts.append(points[at : at + n + tail])
            size += n
            if size >= CHUNK:
                yield rows, np.concatenate([*parts, end])
                rows, parts, size = [], [], 0
    if rows:
        yield rows, np.concatenate([*parts, end])


def _buckets(points: np.ndarray, order: int, buckets: int) -> np.ndarray:
    n = len(points) - order + 1
    with np.errstate(over="ignore"):
        h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for j in range(order):
            h = (h ^ points[j : j + n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return (h % np.uint32(buckets)).astype(np.int32)


def _lower(value: bytes | None) -> str:
    return value.decode("utf-8", "replace").lower() if value else ""


def fit(docs: DataFrame, learn: str, buckets: int = BUCKETS, rows_per_lang: int = TRAIN_ROWS_PER_LANG) -> dict | None:
    """Fit on rows where column ``learn`` is true and ``lang`` is not null.

    The count per language covers all of them; the texts are a hash sample of about
    ``rows_per_lang`` rows each, which bounds the pass whatever the corpus size.
    Returns ``{"langs", "logp"}``, or None if nothing is labelled.
    """
    labelled = docs.where(F.col(learn) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    keep = F.lit(False)
    for lang in langs:
        keep = keep | ((F.col("lang") == F.lit(lang)) & sample_share(F.col("doc_id"), rows_per_lang / sizes[lang]))

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {lang: k for k, lang in enumerate(langs)}
        totals = np.zeros((len(langs), buckets), np.int64)
        for batch in batches:
            lang_of = batch.column("lang").to_pylist()
            for lo, texts in slices(batch.column("data"), 2 * CHUNK):
                for rows, points in _pieces([_lower(v) for v in texts]):
                    pos = 0
                    for i, n in rows:
                        run = points[pos : pos + n + max(ORDERS) - 1]
                        for order in ORDERS:
                            ids = _buckets(run[: n + order - 1], order, buckets)
                            totals[at[lang_of[lo + i]]] += np.bincount(ids, minlength=buckets)
                        pos += n + max(ORDERS) - 1
        lang_ix, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang_ix.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[lang_ix, bucket])],
            names=["lang_ix", "bucket", "n"],
        )

    sample = labelled.where(keep).select("lang", F.col("text").cast("binary").alias("data"))
    counted = sample.mapInArrow(count, "lang_ix int, bucket int, n long").groupBy("lang_ix", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most languages x buckets rows
    counts = np.zeros((len(langs), buckets))
    counts[got["lang_ix"], got["bucket"]] = got["n"]
    smoothed = counts + 0.1
    logp = np.log(smoothed) - np.log(smoothed.sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    return {"langs": langs, "logp": np.ascontiguousarray(logp), "prior": prior}


def score_texts(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, its posterior) for lower-cased texts."""
    logp, buckets, tail = model["logp"], model["logp"].shape[1], max(ORDERS) - 1
    total = np.tile(model["prior"], (len(texts), 1))
    for rows, points in _pieces(texts):
        counts = np.array([n for _, n in rows])
        starts = np.concatenate([[0], np.cumsum(counts + tail)[:-1]])
        ends = starts + counts
        for order in ORDERS:
            ids = _buckets(points, order, buckets)
            # starts and ends alternate: the even segments are the pieces themselves
            cuts = np.minimum(np.stack([starts, ends], 1).ravel(), len(ids) - 1)
            for k in range(len(model["langs"])):
                sums = np.add.reduceat(np.take(logp[k], ids), cuts)[::2]
                np.add.at(total[:, k], [i for i, _ in rows], sums)
    best = total.argmax(axis=1) if len(texts) else np.empty(0, int)
    spread = np.exp(total - total.max(axis=1, keepdims=True)) if len(texts) else total
    share = 1.0 / spread.sum(axis=1) if len(texts) else np.empty(0)
    return best, share


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row (``held_out`` is passed through)."""
    if model is None:
        return docs.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    @releasing
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        names = np.array(known["langs"], dtype=object)
        for column in columns:
            found = [score_texts([_lower(v) for v in texts], known) for _, texts in slices(column, 2 * CHUNK)]
            best = np.concatenate([np.empty(0, int), *(b for b, _ in found)])
            share = np.concatenate([np.empty(0), *(s for _, s in found)])
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(np.minimum(share, 1.0).round(6))], names=["lang", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "held_out", lettered.alias("lettered"), score(F.col("text").cast("binary")).alias("found"))
    return rows.select(
        "doc_id", "held_out", F.when(F.col("lettered"), F.col("found.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.col("found.score")).otherwise(0.0).alias("score"),
    )


def identify_languages(docs: DataFrame, folds: int = 5, held_fold: int = 0, **options) -> DataFrame:
    """Fit outside the held-out fold, then predict every document from its text alone."""
    marked = docs.select("doc_id", "text", "lang", F.coalesce(fold_of("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"))
    marked = marked.withColumn("learn", ~F.col("held_out") & F.col("doc_id").isNotNull())
    return predict(marked, fit(marked, "learn", **options))
