"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item becomes windows of ``WINDOW`` consecutive words (an item of
fewer words is one window).  The words of a window are ordered by how many
documents hold them; as a window has to be contained whole, its necessary prefix
is its rarest word.  Documents are joined on these prefix words only; a match at
word ``i`` fixes where the window would start, the start and the length have to
fit into the document, and the words are then compared exactly.

The benchmark is the bounded side: its vocabulary is counted over all documents in
one pass, and it is split into blocks of about ``BLOCK_WINDOWS`` windows.  The index
of a block is broadcast and every document meets it in a pass of its own, which keeps
rows with hits only, so the memory of a pass is bounded whatever the size of the
benchmark.  Texts alone go to Python, findings alone come back.

Defined cases
    null and empty texts have no words and no hits; items without words occur
    nowhere; rows of one item_id are one item with all their windows; a null
    item_id reads as the empty string; document rows are handled one by one, so
    repeated rows repeat and null ids stay; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, releasing, rewritten, slices

WINDOW = 8
CHUNK = 1 << 20
BLOCK_WINDOWS = 1_000_000
#: Pairs of a place in a text and a window that are compared at once.
PAIRS = 1 << 20
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text after lower-casing A-Z: runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(_LOWER).split() if text else []


def windows_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    if len(words) <= WINDOW:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def build_index(items: Iterable[tuple[str, bytes]], rarity: dict[bytes, int]) -> dict:
    """The windows of some items as arrays: word numbers, lengths, where the rarest word of each stands, windows in the order of
    that word with the range of every word, items by window, and how many windows each item has."""
    windows_by_item: dict[str, set] = defaultdict(set)
    for item, text in items:
        windows_by_item[item].update(windows_of(words_of(text)))
    names, at, holders = sorted(windows_by_item), {}, []
    for k, item in enumerate(names):
        for window in windows_by_item[item]:
            holders.append((at.setdefault(window, len(at)), k))
    number = {w: i for i, w in enumerate(sorted({w for window in at for w in window}))}
    rank = sorted(number, key=lambda w: (rarity.get(w, 0), w))
    place = np.empty(len(rank), np.int64)
    place[[number[w] for w in rank]] = np.arange(len(rank))
    words = np.full((len(at), WINDOW), -1, np.int32)
    for window, i in at.items():
        words[i, : len(window)] = [number[w] for w in window]
    order = np.where(words >= 0, place[words] if len(place) else words, len(rank))
    rarest = order.argmin(axis=1) if len(at) else np.empty(0, np.int64)  # the first of equal ones
    prefix = words[np.arange(len(at)), rarest]
    by = np.argsort(prefix, kind="stable")
    held = np.array(sorted(holders), np.int64).reshape(-1, 2)
    return {
        "number": number, "words": words[by], "size": (words[by] >= 0).sum(axis=1), "rarest": rarest[by], "range": np.searchsorted(prefix[by], np.arange(len(number) + 1)),
        "names": names, "sizes": [len(windows_by_item[x]) for x in names], "items": held[:, 1], "held": np.searchsorted(held[:, 0], np.arange(len(at) + 1)), "window": by,
    }


def find_windows(words: list[bytes], index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(start, row of the index) of every occurrence of a window."""
    number = index["number"]
    ids = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
    known = np.flatnonzero(ids >= 0)
    low, high = index["range"][ids[known]], index["range"][ids[known] + 1]
    known, low, n = known[high > low], low[high > low], (high - low)[high > low]
    starts, rows = [], []
    ends = np.cumsum(n)
    a = 0
    while a < len(known):  # a bounded number of pairs of place and window at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        row = np.repeat(low[a:b] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(n[a:b].sum())
        start = np.repeat(known[a:b], n[a:b]) - index["rarest"][row]
        ok = (start >= 0) & (start + index["size"][row] <= len(words))
        start, row = start[ok], row[ok]
        for j in range(WINDOW):
            same = (index["size"][row] <= j) | (ids[np.minimum(start + j, len(words) - 1)] == index["words"][row, j])
            start, row = start[same], row[same]
        starts.append(start)
        rows.append(row)
        a = b
    return (np.concatenate(starts), np.concatenate(rows)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("data")).where(F.col("data").isNotNull())


def _rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a benchmark block occurs."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column("data"):
                for word in wanted.value.intersection(words_of(text.as_py())):
                    seen[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("data")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


_FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,contained:array<string>,hits:binary,cut:binary>"
_SHAPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("contained", pa.list_(pa.string())), ("hits", pa.binary()), ("cut", pa.binary())])


def _find(text: bytes | None, index: dict | None, earlier: list[dict], cutting: bool) -> dict:
    """What one text holds of one block, with what earlier passes have found in it."""
    words = words_of(text)
    starts, rows = find_windows(words, index) if index else ([], [])
    out = {"n_words": len(words), "n_hit": 0, "items": [], "contained": [], "hits": None, "cut": None}
    if not len(starts) and not earlier:
        return out
    hit = np.zeros(len(words) + 1, bool)
    items, contained = set(), set()
    for before in earlier:
        items.update(before["items"])
        contained.update(before["contained"])
        for a, b in np.frombuffer(before["hits"], np.uint32).reshape(-1, 2):
            hit[a:b] = True
    share: dict[int, int] = defaultdict(int)
    for start, row in zip(starts, rows, strict=True):
        hit[start : start + index["size"][row]] = True
    for window in {index["window"][row] for row in rows}:
        for item in index["items"][index["held"][window] : index["held"][window + 1]]:
            share[int(item)] += 1
    spans = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8))).astype(np.uint32)
    out |= {"n_hit": int(hit.sum()), "items": sorted({*items, *(index["names"][k] for k in share)}), "hits": spans.tobytes()}
    out["contained"] = sorted({*contained, *(index["names"][k] for k, got in share.items() if 2 * got >= index["sizes"][k])})
    out["cut"] = cut(text, spans.reshape(-1, 2)) if cutting else None
    return out


def _finder(index, cutting: bool):
    @F.arrow_udf(_FOUND)
    @releasing
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([_find(text, index.value, [], cutting) for _, texts in slices(column, CHUNK) for text in texts], _SHAPE)

    return run(F.col("text").cast("binary"))


def _settle(cutting: bool):
    @F.arrow_udf(_FOUND)
    @releasing
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, known in columns:
            yield pa.array([_find(text, None, known[at + i].as_py() or [], cutting) for at, texts in slices(column, CHUNK) for i, text in enumerate(texts)], _SHAPE)

    return run(F.col("text").cast("binary"), F.col("known"))


def match(docs: DataFrame, benchmark: DataFrame, cutting: bool = False) -> DataFrame:
    """row (a struct of all columns of ``docs``), text and found: n_words, n_hit, items, contained (items of which half
    of the windows or more occur), hits (start and end of each run of hit words, as packed
    32-bit pairs) and, with ``cutting``, the text without them."""
    spark = docs.sparkSession
    items = _items(benchmark)
    bytes_in = items.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-bytes_in // (BLOCK_WINDOWS * 8)))
    vocabulary = items.mapInArrow(_vocabulary, "word binary").distinct().collect()  # the words of the benchmark, the bounded side
    rarity = _rarity(docs, {bytes(r["word"]) for r in vocabulary})
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")

    def index_of(part: DataFrame):
        return spark.sparkContext.broadcast(build_index([(r["item"], bytes(r["data"])) for r in part.collect()], rarity))  # one block: bounded

    if blocks == 1:
        return rows.withColumn("found", _finder(index_of(items), cutting))
    rows = durable(rows.withColumn("at", F.monotonically_increasing_id()))
    passes = []
    for block in range(blocks):
        found = _finder(index_of(items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)), False)
        passes.append(durable(rows.select("at", found.alias("found")).where(F.size("found.items") > 0)))
    known = passes[0]
    for part in passes[1:]:
        known = known.unionByName(part)
    known = known.groupBy("at").agg(F.collect_list("found").alias("known"))  # one entry a block at most
    return rows.join(known, "at", "left").withColumn("found", _settle(cutting)).select("row", "text", "found")


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = {w for text in batch.column("data").to_pylist() for w in words_of(text)}
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary())], names=["word"])


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = match(docs.select("doc_id", "text"), benchmark)
    n_items = F.size("found.items").cast("long")
    return found.select(
        "row.doc_id", "found.n_words", "found.n_hit", n_items.alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"),
    )


def cut(text: bytes, spans: np.ndarray) -> bytes:
    """The text without its words from start to end of each span, and what stands between those words."""
    at = [m.span() for m in _RUN.finditer(text.translate(_LOWER))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """The columns of ``docs``.  Documents that hold ``least_items`` items, or half of the
    windows of any item, go; from the others the hit words are cut out (n_chars follows)."""
    marked = match(docs, benchmark, cutting=True).where((F.size("found.items") < least_items) & (F.size("found.contained") == 0))
    return marked.select(*rewritten(docs, F.col("row"), F.coalesce(F.col("found.cut").cast("string"), F.col("row.text"))))
