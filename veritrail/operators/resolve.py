"""Resolution: blocking, similarity, capping and clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import block_keys, jaccard, trigrams
from ..schema import SUGGEST_MIN_SCORE, WEIGHT_NAME, WEIGHT_PROPS, WEIGHT_TYPE
from ..session import durable
from .components import components

#: Edges of a component that one task takes.
TASK_EDGES = 200_000


def keyed(records: DataFrame, type_scoped: bool = False, phonetic: bool = False) -> DataFrame:
    """id, key: one row per blocking key.  ``records``: id, name, type."""
    keys = block_keys(F.col("name"), F.col("type") if type_scoped else None, phonetic)
    return records.select("id", F.explode(keys).alias("key"))


def block(records: DataFrame, type_scoped: bool = False, phonetic: bool = False) -> DataFrame:
    """a, b (a < b): pairs that share a key, each once.

    A self equi join on the key; pairs are made distinct before anything is scored.
    """
    k = keyed(records, type_scoped, phonetic)
    left, right = k.select(F.col("id").alias("a"), "key"), k.select(F.col("id").alias("b"), "key")
    return left.join(right, "key").where("a < b").select("a", "b").distinct()


def block_stats(records: DataFrame, type_scoped: bool = False, phonetic: bool = False) -> DataFrame:
    """One row: records, all_pairs, blocks, compared - the last without a join per block."""
    k = keyed(records, type_scoped, phonetic)
    totals = records.agg(F.count("*").alias("records")).withColumn("all_pairs", F.expr("records * (records - 1) div 2"))
    blocks = k.agg(F.countDistinct("key").alias("blocks"))
    pairs = block(records, type_scoped, phonetic).agg(F.count("*").alias("compared"))
    return totals.join(F.broadcast(blocks)).join(F.broadcast(pairs))  # one row each


def props_score(a: Column, b: Column) -> Column:
    """Share of the shared keys whose values agree."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    agree = F.size(F.filter(shared, lambda k: F.coalesce(F.try_element_at(a, k) == F.try_element_at(b, k), F.lit(False))))
    return F.when(F.coalesce(F.size(shared), F.lit(0)) > 0, agree / F.size(shared)).otherwise(0.0)


def combine(name: Column, type_: Column, props: Column) -> Column:
    return WEIGHT_NAME * name + WEIGHT_TYPE * type_ + WEIGHT_PROPS * props


def score_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """a, b, score, name_score, type_score, props_score; trigrams are made once per record."""
    has_props = "props" in records.columns
    ready = records.select("id", "type", trigrams(F.col("name")).alias("g"), *(["props"] if has_props else []))

    def side(x: str) -> DataFrame:
        return ready.select(F.col("id").alias(x), F.struct(*[c for c in ready.columns if c != "id"]).alias(f"_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    name = jaccard(F.col("_a.g"), F.col("_b.g"))
    type_ = F.when(F.col("_a.type") == F.col("_b.type"), 1.0).otherwise(0.0)
    props = props_score(F.col("_a.props"), F.col("_b.props")) if has_props else F.lit(0.0)
    scored = both.select("a", "b", name.alias("name_score"), type_.alias("type_score"), props.alias("props_score"))
    return scored.withColumn("score", F.round(combine(F.col("name_score"), F.col("type_score"), F.col("props_score")), 12))


def cap_by_similarity(pairs: DataFrame, most: int | None) -> DataFrame:
    """Pairs that either end ranks among its ``most`` best; 0 and None keep every pair."""
    if not most:
        return pairs
    ends = pairs.select(F.col("a").alias("end"), "a", "b", "score").unionByName(pairs.select(F.col("b").alias("end"), "a", "b", "score"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("score"), F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string"))))
    kept = ends.withColumn("_r", rank).where(F.col("_r") <= most).select("a", "b").distinct()
    return pairs.join(kept, ["a", "b"], "left_semi")


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The maximum spanning forest of some edges: strongest first, ties by key."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pdf = pdf.assign(_k=pdf["a"].astype(str) + " " + pdf["b"].astype(str)).sort_values(["score", "_k"], ascending=[False, True])
    keep = []
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        x, y = find(a), find(b)
        keep.append(x != y)
        parent[x] = y
    return pdf[keep].drop(columns="_k")


def _grown_forest(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest of edges (a, b, score, cluster) of any size, by Boruvka's rounds.

    In each round every part of a component takes the strongest edge that leaves it; parts so
    joined are one in the next.  Edges are ordered by score and key without ties, so there are no cycles.
    """
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    parts = durable(ends.select("node", F.col("node").alias("part")))
    kept = None
    while True:
        sided = edges.join(parts.select(F.col("node").alias("a"), F.col("part").alias("_x")), "a").join(parts.select(F.col("node").alias("b"), F.col("part").alias("_y")), "b")
        leaving = durable(sided.where("_x <> _y").select("a", "b", "score", "cluster", "_x", "_y"))
        if leaving.isEmpty():
            return kept
        either = leaving.select("*", F.col("_x").alias("_p")).unionByName(leaving.select("*", F.col("_y").alias("_p")))
        best = either.groupBy("_p").agg(F.min_by(F.struct("a", "b", "score", "cluster", "_x", "_y"), F.struct(-F.col("score"), _key())).alias("e"))
        chosen = durable(best.select("e.*").distinct())
        kept = chosen.select("a", "b", "score", "cluster") if kept is None else kept.unionByName(chosen.select("a", "b", "score", "cluster"))
        joined = components(chosen, "_x", "_y").select(F.col("node").alias("part"), F.col("root").alias("_new"))
        parts = durable(parts.join(joined, "part", "left").select("node", F.coalesce("_new", "part").alias("part")))


def _key() -> Column:
    return F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string"))


def cluster(ids: DataFrame, pairs: DataFrame, min_score: float = SUGGEST_MIN_SCORE, task_edges: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(membership: id, cluster; clusters: cluster, size, merges, weak_a, weak_b, weak_score).

    Components come first.  The weakest merging edge is the least of a maximum
    spanning forest: of a component of ``task_edges`` edges at most in one task each, of
    larger ones in rounds over all their edges.
    """
    accepted = pairs.where(F.col("score") >= min_score).select("a", "b", "score")
    roots = components(accepted)
    members = ids.select("id").join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("cluster"))
    placed = accepted.join(roots.select(F.col("node").alias("a"), F.col("root").alias("cluster")), "a").select("a", "b", "score", "cluster")
    large = durable(placed.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > task_edges).select("cluster"))
    forest = placed.join(large, "cluster", "left_anti").select("a", "b", "score", "cluster")
    forest = forest.groupBy("cluster").applyInPandas(lambda pdf: _forest(pdf)[["a", "b", "score", "cluster"]], placed.schema)
    if not large.isEmpty():
        forest = forest.unionByName(_grown_forest(durable(placed.join(large, "cluster", "left_semi").select("a", "b", "score", "cluster"))))
    weak = forest.groupBy("cluster").agg(F.count("*").alias("merges"), F.min_by(F.struct("a", "b", "score"), F.struct("score", _key())).alias("w"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size")).join(weak, "cluster", "left")
    return members, sizes.select("cluster", "size", F.coalesce("merges", F.lit(0)).alias("merges"), F.col("w.a").alias("weak_a"), F.col("w.b").alias("weak_b"), F.col("w.score").alias("weak_score"))


def suggest(records: DataFrame, min_score: float = SUGGEST_MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Clusters of more than one among named records; proposes, never merges."""
    named = records.where(F.trim("name") != "")
    pairs = score_pairs(block(named, type_scoped=True, phonetic=True), named)
    members, clusters = cluster(named, pairs, min_score)
    clusters = clusters.where("size > 1")
    return members.join(clusters.select("cluster"), "cluster", "left_semi"), clusters
