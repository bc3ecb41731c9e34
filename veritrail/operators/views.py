"""Views of a log: what is live, what may be searched, the newest rows, and the graph as it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NOT_LIVE
from .chain import is_purged

#: The fields of a content that may name its record, best first, and what an erased one is shown as.
NAME_FIELDS = ("name", "title", "text", "scenario")
PURGED_LABEL = "(purged)"


def live(log: DataFrame) -> DataFrame:
    """Rows with content, without those that only speak of others."""
    return log.where(F.col("content").isNotNull() & ~F.col("kind").isin(*NOT_LIVE))


def string_field(content: Column, name: str) -> Column:
    """A field of a content, where it is a string."""
    value = F.try_variant_get(F.try_parse_json(content), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(content, f"$.{name}"))


def text_of(content: Column) -> Column:
    return string_field(content, "text")


def name_of(content: Column) -> Column:
    """The first name field that is not blank."""
    fields = [string_field(content, n) for n in NAME_FIELDS]
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])


def searchable(log: DataFrame, content_only: bool = False) -> DataFrame:
    """id, text: content as JSON (its keys are words too), or with ``content_only`` its text field."""
    rows = live(log).where("kind <> 'retrieval'")
    return rows.select("id", (text_of(F.col("content")) if content_only else F.col("content")).alias("text"))


def newest(log: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` rows of each workspace."""
    last = F.row_number().over(Window.partitionBy("workspace").orderBy(F.desc("seq")))
    return log.withColumn("_r", last).where(F.col("_r") <= limit).drop("_r")


def content_of(log: DataFrame, ids: DataFrame) -> DataFrame:
    """requested, id (the canonical record that answers), via, content (null where it is erased or unknown).

    ``ids``: requested, canonical, via, as identity.resolve_ids gives them.
    """
    held = log.where(F.col("kind").isin("node", "edge", "decision")).select(F.col("id").alias("canonical"), "content")
    return ids.join(held, "canonical", "left").select("requested", F.col("canonical").alias("id"), "via", "content")


def graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, label, purged, n_edges; edges: id, source, target, type, weight, has_evidence).

    ``nodes``: id, kind, content, purged; ``edges``: id, source, target, type, weight, has_evidence.  A
    record without a name is shown by its id, an erased one as such.
    """
    label = F.when(F.col("purged"), F.lit(PURGED_LABEL)).otherwise(F.coalesce(name_of(F.col("content")), F.col("id")))
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("n_edges"))
    keep = [c for c in ("valid_from", "valid_until", "recorded_at") if c in nodes.columns]
    return nodes.join(ends, "id", "left").select("id", "kind", label.alias("label"), "purged", *keep, F.coalesce("n_edges", F.lit(0)).alias("n_edges")), edges


def purged(log: DataFrame) -> DataFrame:
    return log.select("id", "salt", "content", is_purged().alias("purged"), "digest")
