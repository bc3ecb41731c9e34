"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its ``WIDTH``-word shingles; a weight is the count
of the shingle in the text times its IDF.  The IDF of a shingle that a share ``f`` of
all documents hold is ``1 + ln(1 / max(f, s)) / ln(1 / s)``: shingles rarer than ``s``
all weigh 2, and those above it, at most ``HEAVY`` of them whatever the size of the
corpus, are counted exactly.  ``SAMPLES`` consistent weighted samples of each text
agree between two texts with the probability of their weighted Jaccard similarity;
they form ``BANDS`` bands of ``ROWS``.  Texts that share a band are candidates, and
every link is verified by the exact weighted Jaccard similarity.

Exact copies are one class from the start.  Pairs are never listed inside a band:
first each member is checked against the least of its band, and the verified
links form components.  Only bands whose members are then in several components
are looked at again, in blocks: members of different components whose samples
agree as often as similar texts do (``least_agree`` of ``SAMPLES``; 0 checks every
pair) are checked inside the block until none are left apart, and only links that
join components leave it.

Defined cases
    null and empty texts, and texts without a word, are near to nothing; empty ones
    are copies of each other, null ones too; texts of fewer than ``WIDTH`` words
    have one shingle of all their words; repeated rows are copies; a null doc_id is
    a copy or a link like any other, and the class is the least id that is not null;
    texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import durable, releasing, slices
from .words import LOWER, PLAIN, positions_in, shingles, word_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 3
SAMPLES = BANDS * ROWS
#: Samples of 36 that pairs of similarity 0.8 share but for one in 100,000.
AGREE = 18
#: The share of documents from which a shingle's frequency counts, and how many such shingles
#: there may be: a corpus of longer texts has a larger share.
SHARE = 1 / 256
HEAVY = 1 << 20
DF_BUCKETS = 1 << 18
CHUNK = 1 << 19
#: Rows and bytes of text of a block of a band.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
SALT_ROWS = 256
#: Shingles that a task keeps of one block.
HELD_SHINGLES = 3_000_000
_TABLE_BITS = 15


def weighted_sets(texts: list[bytes | None], idf: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, weights, shingles by text), hashes ascending in each text."""
    words, counts = word_hashes([t or b"" for t in texts], PLAIN, LOWER)
    doc, pos = positions_in(counts)
    runs = shingles(words, WIDTH)
    whole = pos[: len(runs)] + WIDTH <= counts[doc[: len(runs)]]
    owner, hashes = doc[: len(runs)][whole], runs[whole]
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        first = np.cumsum(counts) - counts
        ones = np.array([shingles(words[first[i] : first[i] + counts[i]], int(counts[i]))[0] for i in short], np.uint64)
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, ones])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]) if len(owner) else np.empty(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff([*at, len(owner)]).astype(np.float64)
    owner, hashes = owner[at], hashes[at]
    sizes = np.bincount(owner, minlength=len(texts))
    return hashes, tf if idf is None else tf * idf_of(hashes, idf), sizes


def idf_of(hashes: np.ndarray, idf: dict) -> np.ndarray:
    out = np.full(len(hashes), 2.0)
    if len(idf["hashes"]) and len(hashes):
        at = np.minimum(np.searchsorted(idf["hashes"], hashes), len(idf["hashes"]) - 1)
        hit = idf["hashes"][at] == hashes
        out[hit] = idf["weights"][at[hit]]
    return out


_rng = np.random.default_rng(5)
_GAMMA = _rng.gamma(2, 1, (SAMPLES, 1 << _TABLE_BITS)).astype(np.float32)
_BETA = _rng.random((SAMPLES, 1 << _TABLE_BITS), np.float32)
_ODD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UNIT = np.float32(2**-24)


def samples(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SAMPLES 32-bit consistent weighted samples of every text with a shingle (rows of zero for others).

    The deciding draw, gamma(2, 1) as the log of a product of two uniforms, is made of 48 bits
    of the shingle's own hash; step and offset come from tables of 2^15 draws.
    """
    out = np.zeros((len(sizes), SAMPLES), np.uint32)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    starts = (np.cumsum(sizes) - sizes)[filled]
    own = sizes[filled]
    log_w = np.log(weights).astype(np.float32)
    mixed = hashes ^ (hashes >> np.uint64(32))
    for k in range(SAMPLES):
        with np.errstate(over="ignore"):
            x = mixed * _ODD[k]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
        at = (x & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.intp)
        u = ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * _UNIT
        u *= (((x >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * _UNIT
        r, beta = _GAMMA[k].take(at), _BETA[k].take(at)
        t = np.floor(log_w / r + beta)
        a = np.log(-np.log(u)) - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == np.repeat(least, own))
        pick = hit[np.searchsorted(hit, starts)]  # ties: the smallest hash
        with np.errstate(over="ignore"):
            out[filled, k] = ((hashes[pick] ^ (t[pick].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    return out


def _bands(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.uint64).reshape(len(rows), BANDS, ROWS)
    key = np.zeros((len(rows), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = (key ^ wide[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        key += np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
    return key.view(np.int64)


def fit_idf(docs: DataFrame) -> dict:
    """Hashes (ascending) and weights of the shingles that more than a share of all documents hold.

    A first pass counts documents by hash bucket; only shingles of buckets above the share can
    be above it themselves, and these are counted one by one in a second pass.
    """
    texts = docs.select(F.col("text").cast("binary").alias("data"))

    @releasing
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DF_BUCKETS + 1, np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            for _, data in slices(batch.column("data"), CHUNK):
                df[:-1] += np.bincount(_bucket(weighted_sets(data, None)[0]), minlength=DF_BUCKETS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "n"])

    got = texts.mapInArrow(sieve, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most DF_BUCKETS + 1 rows
    df = np.zeros(DF_BUCKETS + 1)
    df[got["bucket"]] = got["n"]
    total = df[-1]
    share = max(SHARE, df[:-1].sum() / max(total, 1) / HEAVY)
    open_ = df[:-1] > share * total
    if not open_.any():
        return {"hashes": np.empty(0, np.uint64), "weights": np.empty(0)}
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(open_))

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(shared.value, count=DF_BUCKETS).astype(bool)
        for batch in batches:
            for _, data in slices(batch.column("data"), CHUNK):
                hashes = weighted_sets(data, None)[0]
                hashes, n = np.unique(hashes[open_[_bucket(hashes)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    # each counts for more than share * total of all df.sum() pairs of document and shingle: at most HEAVY rows
    heavy = texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(float(share * total))).toPandas()
    hashes = heavy["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    weights = 1 + np.log(total / heavy["n"].to_numpy(float)[order]) / np.log(1 / share) if share < 1 else np.ones(len(order))
    return {"hashes": hashes[order], "weights": weights}


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(DF_BUCKETS)).astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _verify(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity.  Each side's text is joined by its
    id; an ``a`` of many pairs is split, and its text written once for each part."""
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
    hot = durable(hot)
    salted = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"), F.lit(0)).alias("salt"))
    left = salted.join(texts.select(F.col("cid").alias("b"), F.col("data").alias("data_b")), "b")
    right = texts.select(F.col("cid").alias("a"), F.col("data").alias("data_a")).join(hot, "a", "left")
    right = right.select("a", "data_a", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = left.join(right, ["a", "salt"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            ok = np.zeros(batch.num_rows, bool)
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            for i in range(batch.num_rows):
                sets = []
                for side, column in ((a[i], "data_a"), (b[i], "data_b")):
                    if side not in known:
                        if len(known) > 512:
                            known.clear()
                        known[side] = weighted_sets([batch.column(column)[i].as_py()], idf.value)[:2]
                    sets.append(known[side])
                ok[i] = weighted_jaccard(*sets) >= similarity
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return both.select("a", "b", "data_a", "data_b").mapInArrow(run, "a long, b long")


def _cross(idf, similarity: float, least_agree: int = AGREE):
    """Links of one band block that join components: members of different components whose samples
    agree often enough are checked, unless links found before have joined them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cid, root, role = (table.column(c).to_numpy() for c in ("cid", "root", "role"))
        rows = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(cid), SAMPLES)
        bands, band = _bands(rows), key[0].as_py()
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        pairs = []
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            agree = np.zeros((len(some), len(right)), np.int16)
            for k in range(SAMPLES):
                agree += rows[some, k][:, None] == rows[right, k][None, :]
            i, j = np.nonzero((agree >= least_agree) & (root[some][:, None] != root[right][None, :]))
            i, j = some[i], right[j]
            # a pair belongs to the first band that it shares
            own = np.take_along_axis(bands[i], (bands[i] == bands[j]).argmax(axis=1)[:, None], axis=1)[:, 0] == band
            own &= (role[i] != 2) | (i < j)
            pairs.append(np.stack([i[own], j[own]], axis=1))
        pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), int)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        _, label = np.unique(root, return_inverse=True)
        top = np.arange(label.max(initial=0) + 1)  # the component that each root has come to
        data, known, held, links = table.column("data"), {}, 0, []

        def weights(x: int) -> tuple[np.ndarray, np.ndarray, float]:
            nonlocal held
            if x not in known:
                if held > HELD_SHINGLES:
                    known.clear()
                    held = 0
                hashes, w, _ = weighted_sets([data[x].as_py()], idf.value)
                known[x] = hashes, w, float(w.sum())
                held += len(w)
            return known[x]

        cuts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(pairs)] if len(cuts) else [], strict=True):
            i = pairs[a, 0]
            own, w, total = weights(i)
            partners = pairs[a:b, 1]
            for at in range(0, len(partners), 64):
                some = [j for j in partners[at : at + 64] if top[label[j]] != top[label[i]]]
                if not some or not len(own):
                    continue
                sets = [weights(j) for j in some]
                theirs = np.concatenate([x[0] for x in sets])
                spot = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                both = np.where(own[spot] == theirs, np.minimum(w[spot], np.concatenate([x[1] for x in sets])), 0)
                both = np.add.reduceat(both, np.cumsum([0, *(len(x[0]) for x in sets[:-1])]))
                alike = both / (total + np.array([x[2] for x in sets]) - both) >= similarity
                for j in (j for j, ok in zip(some, alike, strict=True) if ok):
                    x, y = top[label[i]], top[label[j]]
                    if x != y:
                        top[top == max(x, y)] = min(x, y)
                        links.append((cid[i], cid[j]))
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found.min(axis=1)), "b": pa.array(found.max(axis=1))})

    return run


def _text_key() -> Column:
    return F.md5(F.coalesce(F.concat(F.lit("t").cast("binary"), F.col("text").cast("binary")), F.lit("n").cast("binary")))


def _classes(docs: DataFrame, similarity: float, least_agree: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id and same - the key of its text - of every row; same, least - its least id -, n and root of every text)."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(fit_idf(docs))

    @F.arrow_udf("binary")
    @releasing
    def sign(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sigs = []
            for _, data in slices(column, CHUNK):
                hashes, weights, sizes = weighted_sets(data, idf.value)
                rows = samples(hashes, weights, sizes)
                sigs += [r.tobytes() if n else None for r, n in zip(rows, sizes, strict=True)]
            yield pa.array(sigs, pa.binary())

    rows = docs.select("doc_id", _text_key().alias("same"), F.col("text").cast("binary").alias("data"))
    signed = durable(rows.select("doc_id", "same", F.octet_length("data").alias("bytes"), sign("data").alias("sig")))
    classes = signed.groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.first("sig").alias("sig"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))

    @releasing
    def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, SAMPLES)
            cid, size = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("cid", "bytes"))
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(_bands(sigs).ravel()), pa.array(size)], names=["cid", "band", "bytes"])

    banded = classes.where("sig is not null").select("cid", F.col("bytes").cast("long").alias("bytes"), "sig").mapInArrow(band_rows, "cid long, band long, bytes long")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    # written, as both sides of the next join then are plain shuffles, of which Spark splits a hot band
    shared = durable(banded.groupBy("band").agg(F.min("cid").alias("a"), F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1").drop("n"))
    members = durable(banded.join(shared, "band").select("band", "a", F.col("cid").alias("b"), "blocks"))
    first = durable(members.where("a <> b").select("a", "b").distinct())

    # the texts of candidates only: one row of each class
    wanted = first.select(F.col("a").alias("cid")).unionByName(first.select(F.col("b").alias("cid"))).distinct()
    chosen = classes.join(wanted, "cid").select("cid", F.col("same").alias("_same"), F.col("least").alias("_least"))
    texts = durable(rows.join(chosen, (F.col("same") == F.col("_same")) & F.col("doc_id").eqNullSafe(F.col("_least"))).select("cid", "data").dropDuplicates(["cid"]))
    links = durable(_verify(first, texts, idf, similarity))
    roots = components(links)

    # bands that still hold several components
    rooted = members.select("band", F.col("b").alias("cid"), "blocks").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = durable(rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band"))
    again = rooted.join(mixed, "band").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    again = again.join(classes.select("cid", "sig").join(texts, "cid"), "cid")
    # block x meets block y: each member stands in one row of blocks and one column
    spots = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y"), F.when(o == F.col("own"), 2).when(o > F.col("own"), 0).otherwise(1).alias("role")))
    met = again.select("band", F.explode(spots).alias("s"), "cid", "root", "sig", "data").select("band", "s.x", "s.y", "s.role", "cid", "root", "sig", "data")
    compare = _cross(idf, similarity, least_agree)
    more = met.groupBy("band", "x", "y").applyInArrow(lambda key, table: compare(key, table), "a long, b long")
    roots = components(links.unionByName(more))

    named = classes.select("cid", "same", "least", "n").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    return signed.select("doc_id", "same"), named


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, least_agree: int = AGREE) -> DataFrame:
    """doc_id, class_id (the least id of its class), kept, n_copies (rows with the same text),
    n_class (rows of the class), for every row."""
    rows, named = _classes(docs, similarity, least_agree)
    # written for the same reason: a root may have a third of all texts, and a text a third of all rows
    summed = durable(named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class")))
    table = named.join(summed, "root", "left").select("same", "class_id", F.col("n").alias("n_copies"), "n_class")
    out = rows.join(table, "same", "left")
    kind = docs.schema["doc_id"].dataType
    return out.select("doc_id", F.col("class_id").cast(kind).alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"), "n_copies", "n_class")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, least_agree: int = AGREE) -> DataFrame:
    """One row of each class with all its columns: that of the least id (without any id: of the
    least text key), and one of the rows that repeat it."""
    _, named = _classes(docs, similarity, least_agree)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("nameless"), "least", "same")).alias("best"))
    best = best.select(F.col("best.same").alias("_best"), F.col("best.least").alias("_least"))
    rows = docs.select(_text_key().alias("_same"), F.col("doc_id").alias("_id"), F.struct(*docs.columns).alias("row"))
    chosen = rows.join(best, (F.col("_same") == F.col("_best")) & F.col("_id").eqNullSafe(F.col("_least")), "left_semi")
    return chosen.dropDuplicates(["_same", "_id"]).select("row.*")  # keyed as the join, so that nothing is shuffled again
