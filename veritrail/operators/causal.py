"""Causal chains: maximal simple paths, reports and distance bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schema import BANDS, CHAIN_DEPTH, EDGE_TYPES, MAX_CHAIN_DEPTH


def check_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound edges, rejected with a reason): edge type, weight range, endpoints."""
    w = F.col("weight")
    reason = (
        F.when(~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False)), "unknown_edge_type")
        .when(F.isnan(w) | ~F.coalesce(w.between(0, 1), F.lit(False)), "weight_out_of_range")
        .when(F.col("source").isNull() | F.col("target").isNull(), "endpoint_not_found")
    )
    marked = edges.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def is_decision(kind: Column) -> Column:
    return F.lower(F.trim(kind)) == "decision"


def link_decisions(pairs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (source, target, type, weight) between decisions: (edges, rejected with a reason)."""
    kinds = records.select(F.col("id").alias("_id"), is_decision(F.col("kind")).alias("_ok"))
    both = pairs.join(kinds.select(F.col("_id").alias("source"), F.col("_ok").alias("_s")), "source", "left").join(kinds.select(F.col("_id").alias("target"), F.col("_ok").alias("_t")), "target", "left")
    decided = F.coalesce(F.col("_s"), F.lit(False)) & F.coalesce(F.col("_t"), F.lit(False))
    known, bad = check_edges(both.where(decided).drop("_s", "_t"))
    return known, both.where(~decided).drop("_s", "_t").withColumn("reason", F.lit("not_a_decision")).unionByName(bad)


def find_chains(edges: DataFrame, starts: DataFrame, direction: str = "upstream", max_depth: int = CHAIN_DEPTH) -> DataFrame:
    """start, nodes (in walking order), hops (source, target, type, weight, id), depth.

    ``edges``: id, source, target, type, weight; ``starts``: start.  A path is given
    where it cannot go on to a node that it has not visited, or reaches ``max_depth``.
    Each level is one left join with the edges, of all paths: those that cannot go on
    are carried along, under keys of their own that spread them and match nothing.  So
    the plan has ``max_depth`` equi joins, reads every level once and needs no driver
    loop over data.
    """
    if not 1 <= max_depth <= MAX_CHAIN_DEPTH:
        raise EngineError("invalid_max_depth", str(max_depth))
    if direction not in ("upstream", "downstream"):
        raise ValueError(direction)
    near, far = ("target", "source") if direction == "upstream" else ("source", "target")
    hop = F.struct("source", "target", "type", "weight", "id")
    steps = edges.select(F.col(near).alias("_at"), F.col(far).alias("_next"), hop.alias("_hop"))
    empty = F.array().cast("array<struct<source:string,target:string,type:string,weight:double,id:string>>")
    kind = dict(steps.dtypes)["_hop"]
    paths = starts.select("start", F.col("start").alias("_end"), F.array("start").alias("nodes"), empty.cast(f"array<{kind}>").alias("hops"), F.lit(True).alias("_open"))
    for depth in range(max_depth):
        key = F.when(F.col("_open"), F.col("_end").cast("string")).otherwise(F.concat(F.lit("\x00"), F.xxhash64("start", "nodes").cast("string")))
        keyed = paths.withColumn("_key", key)
        grown = keyed.join(steps, (F.col("_key") == F.col("_at").cast("string")) & F.col("_open") & ~F.array_contains("nodes", F.col("_next")), "left")
        went = F.col("_at").isNotNull()
        if not depth:
            grown = grown.where(went)
        paths = grown.select(
            "start", F.when(went, F.col("_next")).otherwise(F.col("_end")).alias("_end"), F.when(went, F.array_append("nodes", F.col("_next"))).otherwise(F.col("nodes")).alias("nodes"),
            F.when(went, F.array_append("hops", F.col("_hop"))).otherwise(F.col("hops")).alias("hops"), went.alias("_open"),
        )
    out = paths.select("start", "nodes", "hops")
    return out.withColumn("depth", F.size("hops"))


def decision_content(chains: DataFrame, records: DataFrame) -> DataFrame:
    """``chains`` with ``contents``: the content of each node in walking order, null where it has none or is erased.

    ``records``: id, content.  Nodes are joined one by one, so a record that many paths share is no join key of its own.
    """
    nodes = chains.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode("nodes").alias("_at", "_node"))
    held = nodes.join(records.select(F.col("id").alias("_node"), F.col("content").alias("_content")), "_node", "left")
    return held.groupBy("_row", *[F.col(c) for c in chains.columns]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_content"))), lambda x: x["_content"]).alias("contents")).drop("_row")


def distance_band(hops: Column) -> Column:
    out = F.when(hops <= BANDS[0][0], BANDS[0][1])
    for most, name in BANDS[1:]:
        out = out.when(hops <= most, name)
    return out.otherwise("distant")


def report(chains: DataFrame) -> DataFrame:
    """``chains`` with product_confidence, weakest_confidence, weakest_link (the first least hop), hop_count, distance_band."""
    weakest = F.array_min(F.transform("hops", lambda h, i: F.struct(h["weight"].alias("w"), i.alias("i"))))
    out = chains.withColumns(
        {
            "product_confidence": F.aggregate("hops", F.lit(1.0), lambda acc, h: acc * h["weight"]),
            "weakest_confidence": F.coalesce(weakest["w"], F.lit(1.0)),
            "weakest_link": F.get("hops", weakest["i"]),
            "hop_count": F.size("hops"),
        }
    )
    return out.withColumn("distance_band", distance_band(F.col("hop_count")))


def chain_path(direction: str) -> Column:
    """The node sequence in reading order, cause first."""
    return F.reverse("nodes") if direction == "upstream" else F.col("nodes")
