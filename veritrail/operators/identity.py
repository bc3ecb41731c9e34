"""Identity: active merges, redirects and composed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_merges(merges: DataFrame, retractions: DataFrame, at: Column, bound: str = "inclusive", compat: bool = False) -> DataFrame:
    """Merges (id, seq, members, canonical, valid_from, valid_until) that hold at an instant.

    Ends are narrowed by retractions (subject, at).  ``bound`` "after" excludes the end
    itself.  With ``compat`` a merge holds before it begins, too.
    """
    closed = retractions.groupBy(F.col("subject").alias("id")).agg(F.min("at").alias("_closed"))
    rows = merges.join(closed, "id", "left").withColumn("_end", F.least("valid_until", "_closed"))
    holds = F.col("_end").isNull() | ((at < F.col("_end")) if bound == "after" else (at <= F.col("_end")))
    if not compat:
        holds = holds & (F.col("valid_from").isNull() | (F.col("valid_from") <= at))
    return rows.where(holds).drop("_closed", "_end")


def redirects(merges: DataFrame) -> DataFrame:
    """id -> canonical, via: of several merges the first by seq."""
    flat = merges.select(F.explode("members").alias("id"), "canonical", F.col("id").alias("via"), "seq").where("id <> canonical")
    return flat.groupBy("id").agg(F.min_by(F.struct("canonical", "via"), "seq").alias("r")).select("id", "r.canonical", "r.via")


def resolve_ids(ids: DataFrame, merges: DataFrame) -> DataFrame:
    """requested, canonical, via (null where nothing redirects)."""
    asked = ids.select(F.col("id").alias("requested"))
    found = redirects(merges)
    return asked.join(found, asked["requested"] == found["id"], "left").select("requested", F.coalesce("canonical", "requested").alias("canonical"), "via")


def merged_view(merges: DataFrame, fields: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(composed: canonical, field, value; conflicts: canonical, field, holders; unavailable: canonical, member).

    ``fields``: id, field, value (as canonical JSON); ``records``: id of what is live.
    The canonical record comes first, then members by id; the first value of a field wins.
    """
    members = merges.select("canonical", F.explode(F.array_union(F.array("canonical"), F.array_sort("members"))).alias("id"))
    rank = F.when(F.col("id") == F.col("canonical"), F.lit("")).otherwise(F.col("id"))
    held = members.withColumn("_rank", rank).join(fields, "id")
    grouped = held.groupBy("canonical", "field").agg(
        F.min_by("value", "_rank").alias("value"), F.countDistinct("value").alias("_n"), F.array_sort(F.collect_list(F.struct(F.col("_rank").alias("rank"), "id", "value"))).alias("_h")
    )
    conflicts = grouped.where("_n > 1").select("canonical", "field", F.transform("_h", lambda h: F.struct(h["id"].alias("id"), h["value"].alias("value"))).alias("holders"))
    unavailable = members.join(records.select("id"), "id", "left_anti").select("canonical", F.col("id").alias("member"))
    return grouped.select("canonical", "field", "value"), conflicts, unavailable
