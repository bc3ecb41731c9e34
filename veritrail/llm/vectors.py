"""Embedding near-dedup by product quantisation.

Equal vectors form one class, so copies are never paired.  Coarse centroids and
codebooks of residual subspaces are fitted on a bounded sample; every class is
indexed: its list, its residual codes and its quantisation error.  A class is
sent to those lists that a vector within the threshold can fall into.  There,
table-lookup distances to all codes of a block, less each code's own error, give
a lower bound, and whatever may reach the threshold is checked by exact cosine
in double precision.  Blocks of the same list are compared once, lists upwards
only; a task returns link counts and a spanning forest, never its pairs.

Sufficient probes: if ``a`` and ``b`` are within ``r``, ``b`` in list ``c`` and
``c'`` is another centroid, then ``a`` lies behind the border of ``c`` and ``c'``
by at most the share of ``b - a`` across that border.  That share is ``r`` at
most; for a difference in no special direction of ``d`` dimensions it has
deviation ``r / sqrt(d)``.  Probes allow ``PROBE_SIGMAS`` of these, capped at
``r`` (where recall is certain).  Measured recall stands in the README.

Defined cases
    vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing and are their own component; vectors of different length do not
    link; repeated rows count as separate vectors; a null vec_id has no component
    id unless a linked vector has one; other columns are ignored; an empty table
    gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import durable, lookup, sample_share

THRESHOLD = 0.95
PROBE_SIGMAS = 3.0
SUBSPACES = 8
#: Bounds of the fit, and of a task: vectors of a block, queries of a slice.
TRAIN_ROWS = 16_384
MAX_LISTS = 4096
ROWS_PER_LIST = 100
BLOCK_ROWS = 1024
SLICE_ROWS = 4096


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        cuts = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], cuts)
        sizes = np.diff([*cuts, len(x)])
        c[near[order][cuts]] = sums / sizes[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, rows: int = 4096) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + rows] @ c.T - half).argmax(axis=1) for i in range(0, len(x), rows)]) if len(x) else np.empty(0, int)


def fit(x: np.ndarray, n: int) -> dict:
    """Centroids and codebooks from unit vectors ``x``, a sample of ``n``."""
    rng = np.random.default_rng(3)
    lists = max(1, min(MAX_LISTS, n // ROWS_PER_LIST, len(x)))
    c = _kmeans(x, lists, 6, rng)
    residual = x - c[_nearest(x, c)]
    parts = [p for p in np.array_split(np.arange(x.shape[1]), SUBSPACES) if len(p)]
    books = [_kmeans(residual[:, p], min(256, len(x)), 5, rng) for p in parts]
    apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] - 2 * c @ c.T + (c**2).sum(1), 0))
    return {"c": c, "parts": parts, "books": books, "apart": np.maximum(apart, 1e-9)}


def probes(x: np.ndarray, home: np.ndarray, model: dict, reach: float) -> np.ndarray:
    """Lists (as a mask) that a vector within the threshold of each row can be in, from its own list upwards."""
    c = model["c"]
    d2 = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
    rows, near = np.arange(len(x)), np.argpartition(d2, min(4, len(c)) - 1, axis=1)[:, :4]
    ok = np.ones(d2.shape, bool)
    for other in near.T:
        behind = (d2 - d2[rows, other][:, None]) / (2 * model["apart"][other])
        behind[rows, other] = -1
        ok &= behind <= reach
    ok[rows, home] = True
    return ok & (np.arange(len(c)) >= home[:, None])


def _unit(blobs: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    joined = b"".join(blobs)  # in the width that the table has, floats or doubles
    raw = np.frombuffer(joined, np.float32 if len(joined) == 4 * dim * len(blobs) else np.float64).reshape(len(blobs), dim).astype(np.float64)
    return raw, _scaled(raw)


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows of unit length; by their largest component first, so that squares neither overflow nor vanish."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw**2).sum(axis=1, keepdims=True))


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _compare(model: dict, dim: int, threshold: float):
    reach = math.sqrt(2 - 2 * threshold)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home = key[0].as_py()
        get = {c: table.column(c) for c in table.column_names}
        role = get["role"].to_numpy().astype(int)
        ids, weight = get["cid"].to_numpy(), get["n"].to_numpy()
        raw, x = _unit(get["vec"].to_pylist(), dim)
        q, d = np.flatnonzero(role > 0), np.flatnonzero(role == 0)
        inside = role[q] == 2  # queries of this very block: each pair once
        residual = x - model["c"][home]
        codes = np.frombuffer(b"".join(get["codes"].take(pa.array(d)).to_pylist()), np.uint8).reshape(len(d), len(model["parts"])).astype(np.intp)
        slack = reach + get["error"].to_numpy()[d] + 1e-6
        counts, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(q), 128) if len(d) else ():
            some = q[at : at + 128]
            distance = np.zeros((len(some), len(d)))
            for s, (part, book) in enumerate(zip(model["parts"], model["books"], strict=True)):
                own = residual[some][:, part]
                lookup = (own**2).sum(1)[:, None] - 2 * own @ book.T + (book**2).sum(1)
                distance += np.take(lookup, codes[:, s], axis=1)
            maybe = distance <= slack**2
            maybe &= ~inside[at : at + 128][:, None] | (ids[some][:, None] < ids[d][None, :])
            i, j = np.nonzero(maybe)
            i, j = some[i], d[j]
            cosine = np.einsum("ij,ij->i", x[i], x[j])
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            np.add.at(counts, i, weight[j])
            np.add.at(counts, j, weight[i])
            labels = _merge(labels, i, j)
        # a class of the block itself stands here as query and as data
        hit = np.flatnonzero((counts > 0) | (labels != np.arange(len(ids))))
        return pa.table({"cid": ids[hit], "links": counts[hit], "other": ids[labels[hit]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sigmas: float = PROBE_SIGMAS) -> DataFrame:
    """vec_id, n_links, component_id, kept, class_size of every row."""
    narrow = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    cast = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
    finite = F.forall(cast, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(cast, lambda v: v != 0)
    marked = vectors.select("vec_id", cast.alias("v"), F.coalesce(finite, F.lit(False)).alias("ok"))
    keyed = marked.select("vec_id", "v", F.when(F.col("ok"), F.md5(F.col("v").cast("string").cast("binary"))).alias("same"))
    classes = keyed.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = durable(classes.withColumns({"cid": F.monotonically_increasing_id(), "dim": F.size("v")}))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = None
    for dim, n in sorted(sizes.items()):
        part = _links(classes.where(F.col("dim") == dim), dim, n, threshold, sigmas)
        found = part if found is None else found.unionByName(part)
    kind = vectors.schema["vec_id"].dataType
    if found is None:
        alone = marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(1).cast("long").alias("class_size"))
    found = durable(found)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.where("cid <> other"), "cid", "other")
    named = classes.select("cid", "same", "least", "n").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = lookup(named.select("cid", "root", "same", "n", "links"), least, ["root"])
    table = named.select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.col("n").alias("class_size"))
    out = keyed.select("vec_id", "same").join(table, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast(kind)
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def _links(classes: DataFrame, dim: int, n: int, threshold: float, sigmas: float) -> DataFrame:
    """cid, links (weighted counts, in parts), other (an edge of a spanning forest, or cid itself)."""
    sc = classes.sparkSession.sparkContext
    # about TRAIN_ROWS rows: the documented bound of the fit
    sample = classes.where(sample_share(F.col("cid"), TRAIN_ROWS / n)).select("cid", "v").toPandas().sort_values("cid")
    if not len(sample):
        sample = classes.select("cid", "v").limit(TRAIN_ROWS).toPandas()
    x = np.array(sample["v"].tolist(), float).reshape(-1, dim)
    model = fit(_scaled(x), n)
    shared = sc.broadcast(model)
    reach = math.sqrt(2 - 2 * threshold) * min(1.0, sigmas / math.sqrt(dim)) + 1e-6

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                raw = np.ascontiguousarray(flat[at * dim : (at + rows.num_rows) * dim].reshape(-1, dim))
                unit = _scaled(raw.astype(np.float64))
                home = _nearest(unit, model["c"])
                residual = unit - model["c"][home]
                codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(model["parts"], model["books"], strict=True)], axis=1)
                coded = np.concatenate([b[codes[:, s]] for s, b in enumerate(model["books"])], axis=1)
                error = np.sqrt(((residual - coded) ** 2).sum(axis=1))
                mask = probes(unit, home, model, reach)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("cid"), rows.column("n"), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(home.astype(np.int32)),
                     pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()), pa.array(error), pa.array([np.flatnonzero(m).astype(np.int32) for m in mask], pa.list_(pa.int32()))],
                    names=["cid", "n", "vec", "home", "codes", "error", "probes"],
                )

    indexed = durable(classes.select("cid", "n", "v").mapInArrow(index, "cid long, n long, vec binary, home int, codes binary, error double, probes array<int>"))
    # at most MAX_LISTS rows each
    held = {r["home"]: r["k"] for r in indexed.groupBy("home").agg(F.count("*").alias("k")).collect()}
    asked = {r["p"]: r["k"] for r in indexed.select(F.explode("probes").alias("p")).groupBy("p").agg(F.count("*").alias("k")).collect()}
    lists = len(model["c"])
    blocks = F.array(*[F.lit(max(1, -(-held.get(i, 0) // BLOCK_ROWS))) for i in range(lists)]) if lists <= 64 else F.lit([max(1, -(-held.get(i, 0) // BLOCK_ROWS)) for i in range(lists)])
    slices = F.array(*[F.lit(max(1, -(-asked.get(i, 0) // SLICE_ROWS))) for i in range(lists)]) if lists <= 64 else F.lit([max(1, -(-asked.get(i, 0) // SLICE_ROWS)) for i in range(lists)])
    placed = indexed.withColumns({"_b": blocks, "_s": slices, "_h": F.xxhash64("cid")})
    placed = placed.withColumn("own", F.pmod(F.col("_h"), F.get("_b", F.col("home"))).cast("int"))
    data = placed.select(
        F.col("home").alias("list"), F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.get("_s", F.col("home")) - 1)).alias("slice"),
        F.lit(0).alias("role"), "cid", "n", "vec", "codes", "error",
    )
    asks = placed.select("*", F.explode("probes").alias("list"))
    asks = asks.select("*", F.explode(F.sequence(F.when(F.col("list") == F.col("home"), F.col("own")).otherwise(0), F.get("_b", F.col("list")) - 1)).alias("block"))
    asks = asks.select(
        "list", "block", F.pmod(F.shiftright("_h", 20), F.get("_s", F.col("list"))).cast("int").alias("slice"),
        F.when((F.col("list") == F.col("home")) & (F.col("block") == F.col("own")), 2).otherwise(1).alias("role"), "cid", "n", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"),
    )
    groups = data.unionByName(asks).groupBy("list", "block", "slice")
    return groups.applyInArrow(lambda key, table: _compare(shared.value, dim, threshold)(key, table), "cid long, links long, other long")
