"""Substring dedup by difference-cover anchors.

Two texts that share ``LENGTH`` consecutive words share them at any alignment of
their positions.  ``COVER`` is a difference cover modulo ``PERIOD``: for every
pair of positions some shift below the period brings both into the cover.  So it
is enough to hash windows of ``ANCHOR = LENGTH - PERIOD + 1`` words at covered
positions: any shared run of ``LENGTH`` words holds an anchor that both texts
hash.  Three linear passes, none of which forms pairs:

1.  anchors at covered positions; those whose hash occurs more than once are
    returned to their documents;
2.  each is extended to the full windows around it, and these windows are hashed
    (96 bits); every occurrence but the first by (doc_id, start) is returned;
3.  the words those windows cover are removed.

Hashes travel packed: a chunk of documents sends one block of hashes to each of a
number of buckets that grows with the corpus.  Before that a chunk combines its
own repeats, so a passage that everyone shares costs a bucket one entry a chunk.
Rows whose whole text is that of a smaller doc_id are covered by windows from end
to end, so they need no anchors of their own.

Defined cases
    doc_id is a whole number; null and empty texts have no words (sha256 of the empty string); texts of fewer
    than ``LENGTH`` words lose nothing; an occurrence is (doc_id, start), so rows
    that repeat a doc_id and text are the same occurrences and give equal rows; a
    null doc_id counts as smaller than any other; texts of any length are read
    whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, mix64, releasing, slices
from .words import WHITESPACE, positions_in, shingles, word_hashes

LENGTH = 20
PERIOD = 13
#: A perfect difference set modulo 13: every difference but 0 occurs once.
COVER = (0, 1, 3, 9)
ANCHOR = LENGTH - PERIOD + 1
CHUNK = 2 << 20
#: Bytes of text for each bucket of hashes, and for each group of documents that get marks back.
BUCKET_BYTES = 4 << 20
_NULL_ID = -(2**63)
_BLOCK = "bucket int, direct boolean, ids binary, keys binary, sizes binary, starts binary, hashes binary, checks binary, known binary"
_BUNDLE = "dest int, ids binary, keys binary, sizes binary, starts binary"
_MARK = "id long, key long, starts binary"


def _pack(bucket: int, direct: bool, ids, keys, doc, starts, hashes, checks, known) -> tuple:
    """Entries in the order of their documents; ids and keys once for each document."""
    docs, sizes = np.unique(doc, return_counts=True)
    return (
        bucket, direct, ids[docs].tobytes(), keys[docs].tobytes(), sizes.astype(np.uint32).tobytes(), starts.astype(np.uint32).tobytes(),
        b"" if direct else hashes.tobytes(), b"" if direct or checks is None else checks.tobytes(), b"" if direct else np.packbits(known).tobytes(),
    )


def _deal(ids, keys, doc, starts, hashes, checks, buckets: int, keep_first: bool) -> Iterator[tuple]:
    """Blocks of one chunk: its own repeats directly, one entry of each hash to the bucket of the hash.

    With ``keep_first`` the first occurrence stays open and later ones are certain;
    without it all occurrences of a repeated hash are certain, and the one entry
    only tells the bucket that the hash exists.
    """
    if not len(hashes):
        return
    order = np.lexsort((starts, ids[doc], hashes)) if checks is None else np.lexsort((starts, ids[doc], checks, hashes))
    h = hashes[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (False if checks is None else checks[order][1:] != checks[order][:-1])])
    group = np.cumsum(new) - 1
    repeated = np.bincount(group)[group] > 1
    sure = ~new if keep_first else repeated
    if keep_first:  # equal rows are the same occurrence
        first = order[np.flatnonzero(new)[group]]
        sure &= (ids[doc[order]] != ids[doc[first]]) | (starts[order] != starts[first])
        new = ~sure
    entries, certain = np.sort(order[new]), np.sort(order[sure])
    known = np.zeros(len(hashes), bool)
    if not keep_first:
        known[order[repeated]] = True
    if len(certain):
        yield _pack(buckets + int(hashes[certain[0]] % np.uint64(buckets)), True, ids, keys, doc[certain], starts[certain], None, None, None)
    own = (hashes[entries] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[by], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
        e = entries[by[a:b]]
        yield _pack(int(own[by[a]]), False, ids, keys, doc[e], starts[e], hashes[e], None if checks is None else checks[e], known[e])


def _by_document(i: np.ndarray, k: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries in the order of (id, key, start), and where each document begins and ends."""
    order = np.lexsort((s, k, i))
    i, k, s = i[order], k[order], s[order]
    cuts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])])) if len(i) else np.empty(0, int)
    return i, k, s, cuts, np.array([*cuts[1:], len(i)] if len(i) else [], int)


def _bundles(i: np.ndarray, k: np.ndarray, s: np.ndarray, buckets: int) -> pa.Table:
    """The entries packed by group of documents, so that a bucket sends a row to each group at most."""
    with np.errstate(over="ignore"):
        dest = (mix64(i.astype(np.uint64) ^ k.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    rows = []
    order = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.diff(dest[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)] if len(order) else [], strict=True):
        own = order[a:b]
        ids, keys, starts, at, ends = _by_document(i[own], k[own], s[own])
        rows.append((int(dest[own[0]]), ids[at].tobytes(), keys[at].tobytes(), (ends - at).astype(np.uint32).tobytes(), starts.astype(np.uint32).tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _BUNDLE.split(", ")])


def _gather(table: pa.Table) -> pa.Table:
    """One row for each marked document of a group."""
    parts = []
    for row in table.select(["ids", "keys", "sizes", "starts"]).to_pylist():
        sizes = np.frombuffer(row["sizes"], np.uint32)
        parts.append((np.repeat(np.frombuffer(row["ids"], np.int64), sizes), np.repeat(np.frombuffer(row["keys"], np.int64), sizes), np.frombuffer(row["starts"], np.uint32)))
    i, k, s, cuts, ends = _by_document(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return pa.table({"id": pa.array(i[cuts], pa.int64()), "key": pa.array(k[cuts], pa.int64()), "starts": pa.array([s[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})


def _settle(keep_first: bool, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """The marks of one bucket: entries whose hash occurs elsewhere too (but the first, with ``keep_first``)."""

    def run(table: pa.Table) -> pa.Table:
        ids, keys, starts, hashes, checks, known = [], [], [], [], [], []
        direct: list[tuple[np.ndarray, ...]] = []
        for row in table.to_batches():
            for i in range(row.num_rows):
                get = {c: row.column(c)[i].as_py() for c in row.schema.names}
                sizes = np.frombuffer(get["sizes"], np.uint32)
                unpacked = np.repeat(np.frombuffer(get["ids"], np.int64), sizes), np.repeat(np.frombuffer(get["keys"], np.int64), sizes), np.frombuffer(get["starts"], np.uint32)
                if get["direct"]:
                    direct.append(unpacked)
                    continue
                for to, value in zip((ids, keys, starts), unpacked, strict=True):
                    to.append(value)
                hashes.append(np.frombuffer(get["hashes"], np.uint64))
                checks.append(np.frombuffer(get["checks"], np.uint32))
                known.append(np.unpackbits(np.frombuffer(get["known"], np.uint8), count=len(hashes[-1])).astype(bool))
        if ids:
            i, k, s, h, known_ = map(np.concatenate, (ids, keys, starts, hashes, known))
            c = np.concatenate(checks)
            order = np.lexsort((s, i, c, h)) if len(c) else np.lexsort((s, i, h))
            ho = h[order]
            new = np.concatenate([[True], ho[1:] != ho[:-1]])
            if len(c):
                new[1:] |= c[order][1:] != c[order][:-1]
            group = np.cumsum(new) - 1
            if keep_first:
                first = order[np.flatnonzero(new)[group]]
                picked = (i[order] != i[first]) | (s[order] != s[first])
            else:
                picked = (np.bincount(group)[group] > 1) & ~known_[order]
            picked = order[picked]
            direct.append((i[picked], k[picked], s[picked]))
        i, k, s = (np.concatenate(x) for x in zip(*direct, strict=True)) if direct else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32))
        return _bundles(i, k, s, buckets)

    return run


def _blocks(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _anchor_blocks(buckets: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            for lo, data in slices(batch.column("data"), CHUNK):
                hi = lo + len(data)
                words, counts = word_hashes([x or b"" for x in data], WHITESPACE)
                doc, pos = positions_in(counts)
                anchors = shingles(words, ANCHOR)
                at = np.flatnonzero(cover[pos[: len(anchors)] % PERIOD] & (pos[: len(anchors)] + ANCHOR <= counts[doc[: len(anchors)]]) & (counts[doc[: len(anchors)]] >= LENGTH))
                yield from _deal(ids[lo:hi], keys[lo:hi], doc[at], pos[at], anchors[at], None, buckets, keep_first=False)

    return releasing(lambda batches: _blocks(rows(batches)))


def _window_blocks(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            marks = batch.column("starts")
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            for lo, data in slices(batch.column("data"), CHUNK):
                hi = lo + len(data)
                words, counts = word_hashes([x or b"" for x in data], WHITESPACE)
                doc, pos = positions_in(counts)
                first = np.cumsum(counts) - counts
                # a window is open if an anchor starts at most PERIOD - 1 words behind its start
                steps = np.zeros(len(words) + 1, np.int32)
                for i in range(lo, hi):
                    at = np.frombuffer(marks[i].as_py(), np.uint32).astype(np.int64)
                    np.add.at(steps, first[i - lo] + np.maximum(at - (PERIOD - 1), 0), 1)
                    np.add.at(steps, first[i - lo] + at + 1, -1)
                opened = np.cumsum(steps[:-1]) > 0
                at = np.flatnonzero(opened & (pos + LENGTH <= counts[doc]))
                if len(at):
                    hashes, checks = shingles(words, LENGTH)[at], (shingles(words, LENGTH, seed=1)[at] >> np.uint64(32)).astype(np.uint32)
                    yield from _deal(ids[lo:hi], keys[lo:hi], doc[at], pos[at], hashes, checks, buckets, keep_first=True)

    return releasing(lambda batches: _blocks(rows(batches)))


def covered(n: int, starts: bytes) -> np.ndarray:
    """Which of ``n`` words the windows at ``starts`` cover."""
    steps = np.zeros(n + 1, np.int32)
    at = np.frombuffer(starts, np.uint32).astype(np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + LENGTH, -1)
    return np.cumsum(steps[:-1]) > 0


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("data"))


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the documents as id, key, data; one row for each of them that loses words: id, key,
    whole - its whole text is that of a smaller id -, starts - packed, of the windows to remove)."""
    rows = _rows(docs)
    bytes_in = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(8, -(-bytes_in // BUCKET_BYTES))

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("key"), F.md5(F.col("text").cast("binary")).alias("same"))
    firsts = texts.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = lookup(texts, firsts, ["same"]).where("id > first").select("id", "key").distinct()

    own = rows.join(copies.withColumn("copy", F.lit(True)), ["id", "key"], "left").where("copy is null").select("id", "key", "data")
    blocks = own.mapInArrow(_anchor_blocks(buckets), _BLOCK)
    anchors = blocks.groupBy("bucket").applyInArrow(_settle(False, buckets), _BUNDLE).groupBy("dest").applyInArrow(_gather, _MARK)
    held = rows.join(anchors, ["id", "key"])
    blocks = held.mapInArrow(_window_blocks(buckets), _BLOCK)
    windows = blocks.groupBy("bucket").applyInArrow(_settle(True, buckets), _BUNDLE).groupBy("dest").applyInArrow(_gather, _MARK)
    # a copy has no anchors of its own, so no document is in both
    lost = windows.select("id", "key", F.lit(False).alias("whole"), "starts").unionByName(copies.select("id", "key", F.lit(True).alias("whole"), F.lit(None).cast("binary").alias("starts")))
    return rows, lost


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, lost = repeated_windows(docs)

    @releasing
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, whole, starts in zip(batch.column("data"), batch.column("whole"), batch.column("starts"), strict=True):
                words = (text.as_py() or b"").split()
                starts = starts.as_py()
                if whole.as_py() and len(words) >= LENGTH:
                    kept = []
                elif starts:
                    gone = covered(len(words), starts)
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                else:
                    kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests)], names=["id", "n_words", "n_removed", "kept_sha256"])

    out = rows.join(lost, ["id", "key"], "left").mapInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string")
    kind = docs.schema["doc_id"].dataType
    return out.select(F.nullif("id", F.lit(_NULL_ID)).cast(kind).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
