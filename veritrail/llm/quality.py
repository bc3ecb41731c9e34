"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of the
whole text is encoded (hashed byte 2- and 3-grams plus a few surface ratios, then
a learned tanh layer); a gated attention ``softmax(w . (tanh(Vh) * sigmoid(Uh)))``
weighs the encoded passages, and a logistic layer scores their weighted sum.
Only document labels are learned from.  The fit uses a bounded sample of labelled
rows (``rows_per_class`` of each class, and no more of them than ``TRAIN_BYTES`` of
text hold), each with all its passages; scoring uses every passage of every row.
A text's features and score depend on that text and the model alone.

Defined cases
    null and empty texts are one passage without content and get a score too;
    no label, or labels of one class only -> every score is the share of label 1
    among the labels (0.5 without any);
    several labels of one id -> their mean, rounded half up, is learned;
    a null id is scored like any other and never learned from; repeated rows are
    scored row by row; texts are cut into pieces of ``PIECE`` bytes before they are
    cut into passages, so very long ones need no more memory; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of_bytes, fold_of, releasing, sample_share, slices

PASSAGE_WORDS = 64
HASHED = 256
SURFACE = 6
PIECE = 1 << 18
HIDDEN = 24
GATE = 12
#: Bounds of the fit: rows and bytes of text of each class.
TRAIN_ROWS_PER_CLASS = 600
TRAIN_BYTES = 16 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(b" ", at, at + PIECE), text.rfind(b"\n", at, at + PIECE))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features by passage, passages by text); a text without words has one passage.

    Every text is followed by two line ends, so its last n-grams never reach the next one.
    """
    raw = np.frombuffer(b"\n\n".join(texts) + b"\n\n", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    first_byte = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    space = _SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    start_at = np.flatnonzero(starts)
    word_doc = np.searchsorted(first_byte, start_at, "right") - 1
    words_of = np.bincount(word_doc, minlength=len(texts))
    word_in_doc = np.arange(len(start_at)) - np.concatenate([[0], np.cumsum(words_of)[:-1]])[word_doc]
    passages_of = np.maximum(1, -(-words_of // PASSAGE_WORDS))
    first_passage = np.concatenate([[0], np.cumsum(passages_of)[:-1]])
    n = int(passages_of.sum())
    word_passage = first_passage[word_doc] + word_in_doc // PASSAGE_WORDS
    # each byte belongs to the passage of the last word that began at or before it, in its own text
    byte_word = np.cumsum(starts) - 1
    inked = ~space
    where = word_passage[byte_word[inked]] if len(start_at) else np.empty(0, np.int64)
    out = np.zeros((n, HASHED + SURFACE), np.float32)
    if len(where):
        b = raw.astype(np.uint32)
        two = b[:-2] * np.uint32(0x01000193) ^ b[1:-1]
        with np.errstate(over="ignore"):
            h2 = two * np.uint32(0x9E3779B1) >> np.uint32(24)
            h3 = (two * np.uint32(0x01000193) ^ b[2:]) * np.uint32(0x85EBCA6B) >> np.uint32(24)
        at = np.flatnonzero(inked[:-2])
        own = where[: len(at)]
        counts = np.bincount(own * HASHED + h2[at], minlength=n * HASHED) + np.bincount(own * HASHED + h3[at], minlength=n * HASHED)
        counts = counts.reshape(n, HASHED)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[:, :HASHED] = np.sqrt(counts / total)
        inked_of = np.maximum(np.bincount(where, minlength=n), 1)
        seen = raw[inked]
        for k, mask in enumerate(((seen >= 65) & (seen <= 90), (seen >= 48) & (seen <= 57), _PUNCT[seen], seen >= 128)):
            out[:, HASHED + k] = np.bincount(where, mask, n) / inked_of
        out[:, HASHED + 4] = ((counts / total) ** 2).sum(axis=1)
        out[:, HASHED + 5] = np.bincount(word_passage, minlength=n) / inked_of
    return out, passages_of


def _forward(x: np.ndarray, starts: np.ndarray, owner: np.ndarray, p: dict) -> dict:
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    a = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["d"]}


def _train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 80, rate: float = 0.03) -> dict:
    rng = np.random.default_rng(7)
    width = x.shape[1]
    p = {
        "W": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(()),
    }
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, steps + 1):
        f = _forward(x, starts, owner, p)
        g = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        gz = g[:, None] * p["c"]
        ga = (f["h"] * gz[owner]).sum(axis=1)
        ge = f["a"] * (ga - np.add.reduceat(f["a"] * ga, starts)[owner])
        gt, gs = ge[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), ge[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        gh = f["a"][:, None] * gz[owner] + gt @ p["V"].T + gs @ p["U"].T
        gx = gh * (1 - f["h"] ** 2)
        grads = {"W": x.T @ gx, "b": gx.sum(0), "V": f["h"].T @ gt, "U": f["h"].T @ gs, "w": ge @ (f["t"] * f["s"]), "c": f["z"].T @ g, "d": g.sum()}
        for k, grad in grads.items():
            grad = grad + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = TRAIN_ROWS_PER_CLASS) -> dict:
    """``docs``: doc_id, text; ``labels``: doc_id, quality, already without held-out ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {"constant": float(next(iter(sizes))) if sizes else 0.5}
    chosen = F.lit(False)
    for label, n in sizes.items():
        chosen = chosen | ((F.col("label") == label) & sample_share(F.col("doc_id"), rows_per_class / n))
    # the chosen labels are about 2 x rows_per_class rows: bounded, so broadcast
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("data")).join(F.broadcast(known.where(chosen)), "doc_id")
    ahead = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), F.xxhash64("data")).rowsBetween(Window.unboundedPreceding, -1)  # rows of the sample only
    sample = sample.withColumn("ahead", F.coalesce(F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).over(ahead), F.lit(0))).where(F.col("ahead") < TRAIN_BYTES).drop("ahead")

    @releasing
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_, sizes_, blobs = batch.column("label").to_pylist(), [], []
            for value in batch.column("data"):
                rows = np.concatenate([encode([piece])[0] for piece in _pieces(value.as_py() or b"")])
                sizes_.append(len(rows))
                blobs.append(rows.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels_, pa.int32()), pa.array(sizes_, pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "label", "n", "blob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(features, f"doc_id {kind}, label int, n int, blob binary").toPandas()
    got["key"] = got["blob"].map(zlib.crc32)
    got = got.sort_values(["doc_id", "n", "key"])
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        return {"constant": sizes.get(1, 0) / sum(sizes.values())}
    x = np.frombuffer(b"".join(got["blob"]), np.float16).astype(np.float32).reshape(-1, HASHED + SURFACE)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    params = _train((x - mean) / std, got["n"].to_numpy(), y)
    # back from the sample's class balance to that of all labels
    shift = np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return {"p": {k: np.asarray(v, np.float64) for k, v in params.items()}, "mean": mean, "std": std, "shift": float(shift)}


def score_texts(texts: list[bytes | None], model: dict) -> np.ndarray:
    """In double precision and rounded, so that a score is the same in any company."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    p, out = model["p"], np.empty(len(texts))
    for lo, hi in batches_of_bytes(texts, PIECE):
        pieces = [(i, piece) for i in range(lo, hi) for piece in _pieces(texts[i] or b"")]
        hidden, gates, sizes = [], [], np.zeros(hi - lo, np.int64)
        for a, b in batches_of_bytes([piece for _, piece in pieces], PIECE):
            x, n = encode([piece for _, piece in pieces[a:b]])
            h = np.tanh((x - model["mean"]).astype(np.float64) / model["std"] @ p["W"] + p["b"])
            hidden.append(h)
            gates.append((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
            np.add.at(sizes, [i - lo for i, _ in pieces[a:b]], n)
        h, e = np.concatenate(hidden), np.concatenate(gates)
        starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(hi - lo), sizes)
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        z = np.add.reduceat((e / np.add.reduceat(e, starts)[owner])[:, None] * h, starts)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"] + model["shift"], -30, 30)))
    return np.round(out, 6)


def scorer(docs: DataFrame, model: dict) -> Column:
    """The score of the text column; only texts go to Python, and only scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @releasing
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [score_texts(texts, shared.value) for _, texts in slices(column, PIECE)]
            yield pa.array(np.concatenate([np.empty(0), *parts]))

    return run(F.col("text").cast("binary"))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    open_labels = labels.select("doc_id", "quality").where(fold_of("doc_id", folds) != held_fold)
    model = fit(docs.select("doc_id", "text"), open_labels)
    rows = docs.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"), scorer(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **folds) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``."""
    open_labels = labels.select("doc_id", "quality").where(fold_of("doc_id", folds.get("folds", 4)) != folds.get("held_fold", 2))
    model = fit(docs.select("doc_id", "text"), open_labels)
    return docs.where(scorer(docs, model) >= threshold)
