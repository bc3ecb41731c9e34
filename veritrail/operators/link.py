"""Entity linking: which record a phrase refers to, with a verdict rather than a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import acronyms, block_keys, content_words, expanded, infer_type, jaccard, trigrams
from ..schema import LINK_WEAK_MARGIN
from .resolve import combine


def type_only_match(mention, name):
    """Whether the shared content words all just name the type of the mention."""
    type_ = infer_type(mention)
    shared = F.array_intersect(content_words(mention), content_words(name))
    return F.coalesce(type_.isNotNull() & (F.size(shared) > 0) & F.forall(shared, lambda w: F.regexp_replace(w, r"s$", "") == type_), F.lit(False))


def candidates(mentions: DataFrame, records: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """mention_id, mention, id, name, score, rank of records that share a block key.

    ``mentions``: mention_id, mention (and optionally type); ``records``: id, name,
    type; ``exclude``: mention_id, id.  An acronym is written out only against a
    record whose own name spells it.
    """
    probes = mentions.withColumn("_type", F.coalesce("type", infer_type(F.col("mention"))) if "type" in mentions.columns else infer_type(F.col("mention")))
    asked = probes.select("mention_id", F.explode(block_keys(F.col("mention"), None, True)).alias("key"))
    held = records.select("id", F.explode(block_keys(F.col("name"), None, True)).alias("key"))
    pairs = asked.join(held, "key").select("mention_id", "id").distinct()
    if exclude is not None:
        pairs = pairs.join(exclude, ["mention_id", "id"], "left_anti")
    named = records.select("id", "name", F.coalesce(infer_type(F.col("name")), F.col("type")).alias("_rtype"), F.col("type").alias("_kind"))
    both = pairs.join(probes, "mention_id").join(named, "id")
    if "type" in mentions.columns:
        both = both.where(F.col("type").isNull() | (F.col("type") == F.col("_kind")))
    # the Python step only runs for mentions with an acronym
    text = F.when(F.size(acronyms(F.col("mention"))) > 0, expanded(F.col("mention"), F.col("name"))).otherwise(F.col("mention"))
    ready = both.withColumn("_text", text)
    same = F.when(F.col("_type") == F.col("_rtype"), 1.0).otherwise(0.0)
    score = F.round(combine(jaccard(trigrams(F.col("_text")), trigrams(F.col("name"))), same, F.lit(0.0)), 12)
    scored = ready.select("mention_id", "mention", "id", "name", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "id")))


def link(mentions: DataFrame, records: DataFrame, exclude: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates up to ``limit``, verdicts: mention_id, mention, id, score, margin, verdict, type_only).

    The margin is taken before the limit; mentions without a candidate keep a row.
    """
    found = candidates(mentions, records, exclude)
    top = found.where("rank <= 2").groupBy("mention_id").agg(F.min_by(F.struct("id", "name", "score"), "rank").alias("t"), F.max_by("score", "rank").alias("_next"), F.count("*").alias("_n"))
    both = mentions.select("mention_id", "mention").join(top, "mention_id", "left")
    margin = F.when(F.col("_n") > 1, F.round(F.col("t.score") - F.col("_next"), 12))
    out = both.select("mention_id", "mention", F.col("t.id").alias("id"), F.col("t.score").alias("score"), margin.alias("margin"), type_only_match(F.col("mention"), F.col("t.name")).alias("type_only"))
    verdict = (
        F.when(F.col("id").isNull(), "no_candidates").when(F.col("margin") == 0, "tie").when(F.coalesce("margin", F.lit(1.0)) < LINK_WEAK_MARGIN, "weak").when(F.col("type_only"), "weak").otherwise("ranked")
    )
    return (found if limit is None else found.where(F.col("rank") <= limit)), out.withColumn("verdict", verdict)
