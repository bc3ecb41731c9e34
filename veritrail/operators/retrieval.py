"""Retrieval: lexical and structural channels, rank fusion, and when to abstain."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.text import tokenise
from ..schema import LEXICAL_FLOOR, RESULT_LIMIT, RRF_K, STRUCTURAL_FLOOR
from ..session import durable
from . import postings


class Retrieved(NamedTuple):
    served: DataFrame
    decisions: DataFrame
    margins: DataFrame


def _ranked(scored: DataFrame) -> DataFrame:
    """Rank by score, then id as a string."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def _named(scored: DataFrame) -> DataFrame:
    """Scores are rounded before anything is compared, since sums have no fixed order."""
    return scored.select("query_id", F.col("id").cast("string").alias("id"), F.round("score", 12).alias("score"))


def doc_tokens(docs: DataFrame) -> DataFrame:
    """id, n_tokens (with repeats), token (distinct)."""
    counted = docs.select("id", tokenise(F.col("text")).alias("_t"))
    return counted.select("id", F.size("_t").alias("n_tokens"), F.explode(F.array_distinct("_t")).alias("token"))


def lexical_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score.  ``docs``: id, text; ``queries``: query_id, query.

    Documents are scanned twice, for frequencies of what queries ask for and for scores;
    nothing of them is shuffled or written.
    """
    return _named(postings.scores(docs, queries)).where("score > 0")


def lexical_candidates(docs: DataFrame, queries: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """(scores, seen): query_id, id, score of what reaches the floor; query_id, considered and top_score of all that has a score."""
    found = durable(postings.scores(docs, queries, floor))
    seen = found.where("n is not null").groupBy("query_id").agg(F.sum("n").alias("considered"), F.round(F.max("score"), 12).alias("top_score"))
    return _named(found.where("n is null")).where(F.col("score") >= floor), seen


def lexical_channel(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score, rank of every document that shares a token with a query."""
    return _ranked(lexical_scores(docs, queries))


def structural_scores(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, id, score: edges of a non-seed to seeds, either way, parallel ones counted.

    ``links``: source, target; ``seeds``: query_id, id.
    """
    around = links.select(F.col("source").cast("string").alias("_from"), F.col("target").cast("string").alias("id"))
    around = around.unionByName(links.select(F.col("target").cast("string").alias("_from"), F.col("source").cast("string").alias("id"))).where("_from <> id")
    reached = around.join(seeds.select("query_id", F.col("id").alias("_from")), "_from")
    fresh = reached.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return _named(fresh.groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score")))


def structural_channel(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, id, score, rank."""
    return _ranked(structural_scores(links, seeds))


def fuse(channels: DataFrame, k: int = RRF_K, checked: bool = False) -> DataFrame:
    """query_id, id, fused, contributions, position.  ``channels``: query_id, channel, id, score, rank.

    Rows without an id, or that repeat one in a channel, are refused; ``checked`` tells that there are none.
    """
    if not (isinstance(k, int) and k > 0):
        raise EngineError("invalid_k", str(k))
    if not checked and (bad := fusion_problems(channels).first()) is not None:
        raise EngineError(bad["reason"], f"{bad['query_id']} {bad['channel']} {bad['id']}")
    part = F.struct("channel", "rank", "score", (1.0 / (k + F.col("rank"))).alias("rrf"))
    fused = channels.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(part)).alias("contributions"))
    fused = fused.withColumn("fused", F.round(F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["rrf"]), 15))
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")))


def fusion_problems(channels: DataFrame) -> DataFrame:
    """query_id, channel, id, reason for rows that cannot be fused."""
    missing = channels.where("id is null").select("query_id", "channel", "id", F.lit("missing_id").alias("reason"))
    twice = channels.where("id is not null").groupBy("query_id", "channel", "id").agg(F.count("*").alias("n")).where("n > 1")
    return missing.unionByName(twice.select("query_id", "channel", "id", F.lit("duplicate_id_in_channel").alias("reason")))


def margins(queries: DataFrame, channels: DataFrame, floors: dict[str, float]) -> DataFrame:
    """query_id, channel, considered, top_score, floor, margin; empty channels have a row too."""
    return _bounds(queries, channels.groupBy("query_id", "channel").agg(F.count("*").alias("considered"), F.max("score").alias("top_score")), floors)


def _bounds(queries: DataFrame, seen: DataFrame, floors: dict[str, float]) -> DataFrame:
    named = queries.select("query_id", F.explode(F.create_map(*[F.lit(x) for kv in sorted(floors.items()) for x in kv])).alias("channel", "floor"))
    out = named.join(seen, ["query_id", "channel"], "left")
    return out.select("query_id", "channel", F.coalesce("considered", F.lit(0)).alias("considered"), "top_score", "floor", (F.col("top_score") - F.col("floor")).alias("margin"))


class Candidates(NamedTuple):
    """Ranked rows of both channels that reach their floors (channel, query_id, id, score, rank), and the margins of the channels."""

    passed: DataFrame
    margins: DataFrame


def candidates(lexical: tuple[DataFrame, DataFrame], links: DataFrame, queries: DataFrame, lexical_floor: float = LEXICAL_FLOOR, structural_floor: float = STRUCTURAL_FLOOR) -> Candidates:
    """``lexical``: of ``lexical_candidates``, with the same floor or a lower one.

    Floors apply to each channel before ranks are fused.  A floor cuts a tail off, which
    changes no rank: candidates below it are counted and never sorted.
    """
    seeds = lexical[0].where(F.col("score") >= lexical_floor)
    structural = durable(structural_scores(links, seeds))
    floors = {"lexical": lexical_floor, "structural": structural_floor}
    around = structural.groupBy("query_id").agg(F.count("*").alias("considered"), F.max("score").alias("top_score"))
    seen = lexical[1].withColumn("channel", F.lit("lexical")).unionByName(around.withColumn("channel", F.lit("structural")))
    passed = [_ranked(frame).select(F.lit(name).alias("channel"), "*") for name, frame in (("lexical", seeds), ("structural", structural.where(F.col("score") >= structural_floor)))]
    return Candidates(passed[0].unionByName(passed[1]), _bounds(queries, seen, floors))


def retrieve(docs: DataFrame, links: DataFrame, queries: DataFrame, limit: int = RESULT_LIMIT, lexical_floor: float = LEXICAL_FLOOR, structural_floor: float = STRUCTURAL_FLOOR, k: int = RRF_K) -> Retrieved:
    """A batch of queries; no record is written."""
    return decide(candidates(lexical_candidates(docs, queries, lexical_floor), links, queries, lexical_floor, structural_floor), queries, limit, k)


def decide(found: Candidates, queries: DataFrame, limit: int = RESULT_LIMIT, k: int = RRF_K) -> Retrieved:
    """What is served of the candidates, and why or why not."""
    bounds = found.margins
    served = fuse(found.passed, k, checked=True).where(F.col("position") <= limit)
    hits = served.groupBy("query_id").agg(F.count("*").alias("n_served"), F.array_sort(F.collect_list(F.struct("position", "id"))).alias("_s"))
    considered = bounds.groupBy("query_id").agg(F.sum("considered").alias("considered"))
    decided = queries.join(hits, "query_id", "left").join(considered, "query_id", "left")
    decisions = decided.select(
        "query_id",
        F.when(F.coalesce("n_served", F.lit(0)) > 0, "served").otherwise("abstained").alias("outcome"),
        F.when(F.coalesce("n_served", F.lit(0)) > 0, None).when(F.col("considered") == 0, "no_candidates").otherwise("below_floor").alias("reason"),
        F.substring(F.sha2(F.col("query").cast("binary"), 256), 1, 16).alias("query_hash"),
        (F.octet_length(F.encode("query", "UTF-16BE")) / 2).cast("int").alias("query_chars"),
        F.coalesce(F.transform("_s", lambda s: s["id"]), F.array().cast("array<string>")).alias("served"),
    )
    return Retrieved(served, decisions, bounds)


def contradictions(decisions: DataFrame) -> DataFrame:
    """Decisions that say one thing and hold another; must be empty."""
    served = F.col("outcome") == "served"
    return decisions.where((served != (F.size("served") > 0)) | (served != F.col("reason").isNull())).select("query_id", F.lit("contradictory_decision").alias("code"))
