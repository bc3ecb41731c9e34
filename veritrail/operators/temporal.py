"""Bitemporal windows: effective ends, snapshots, retraction algebra."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant, parse_instant


class Snapshot(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    rejected: DataFrame


def closing_end(current: Column, at: Column) -> Column:
    """The earlier of two ends; an unbounded one gives way."""
    return F.least(current, at)


def effective_until(records: DataFrame, retractions: DataFrame, as_of: str | None = None, compat: bool = False) -> DataFrame:
    """``records`` (id, valid_until) with effective_until: the end narrowed by all retractions.

    ``retractions``: subject, at, recorded_at.  With ``as_of`` only retractions recorded
    by then count, unless ``compat`` asks for all of them.
    """
    counted = retractions if as_of is None or compat else retractions.where(F.col("recorded_at") <= F.lit(instant(as_of)))
    first = counted.groupBy("subject").agg(F.min("at").alias("_closed"))
    joined = records.join(first, records["id"] == first["subject"], "left")
    return joined.withColumn("effective_until", closing_end(F.col("valid_until"), F.col("_closed"))).drop("subject", "_closed")


def resolve(records: DataFrame) -> DataFrame:
    """Raw strings recorded_at, valid_from, valid_until -> the same as instants, and
    ``rejections`` (field, reason, value), empty where the row can be trusted."""
    parsed = {c: parse_instant(F.col(c)) for c in ("recorded_at", "valid_from", "valid_until")}
    rows = records.withColumns({f"_{c}": p for c, p in parsed.items()})

    def bad(column: str, field: str) -> Column:
        reason = F.col(f"_{column}.reason")
        reason = F.when(F.col(column).isNull(), F.lit("malformed_temporal_value")).otherwise(reason) if column == "recorded_at" else reason
        return F.when(reason.isNotNull(), F.struct(F.lit(field).alias("field"), reason.alias("reason"), F.col(column).alias("value")))

    inverted = F.when(
        F.col("_valid_from.ts") > F.col("_valid_until.ts"),
        F.struct(F.lit("window").alias("field"), F.lit("inverted_window").alias("reason"), F.concat("valid_from", F.lit("/"), "valid_until").alias("value")),
    )
    rejections = F.array_compact(F.array(bad("recorded_at", "recordedAt"), bad("valid_from", "validFrom"), bad("valid_until", "validUntil"), inverted))
    out = rows.withColumn("rejections", rejections)
    return out.withColumns({c: F.col(f"_{c}.ts") for c in parsed}).drop(*(f"_{c}" for c in parsed))


def within(at: Column, start: Column, end: Column) -> Column:
    """Inclusive at both ends; null is unbounded."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at <= end))


def state_at(nodes: DataFrame, edges: DataFrame, valid_at: str, as_of: str | None = None, raw: bool = False) -> Snapshot:
    """The world at ``valid_at`` as recorded by ``as_of``.

    ``nodes``: id, valid_from, valid_until, recorded_at; ``edges`` also source, target.
    ``raw`` inputs hold strings, which are parsed; bad rows are excluded and named in
    ``rejected``.  An edge needs its own window and both endpoints active.  The
    filters reach the scan; the endpoint rule is two semi joins on ids.
    """
    at, seen = instant(valid_at), instant(as_of) if as_of is not None else None
    rejected = []

    def admit(df: DataFrame, what: str) -> DataFrame:
        if raw:
            df = resolve(df)
            rejected.append(df.select(F.lit(what).alias("kind"), "id", F.explode("rejections").alias("r")).select("kind", "id", "r.field", "r.reason", "r.value"))
            df = df.where(F.size("rejections") == 0).drop("rejections")
        if seen is not None:
            df = df.where(F.col("recorded_at") <= F.lit(seen))
        return df.where(within(F.lit(at), F.col("valid_from"), F.col("valid_until")))

    active = admit(nodes, "node")
    ids = active.select(F.col("id").alias("_id"))
    held = admit(edges, "edge")
    held = held.join(ids, held["source"] == ids["_id"], "left_semi")
    held = held.join(ids, held["target"] == ids["_id"], "left_semi")
    if raw:
        bad = rejected[0].unionByName(rejected[1])
    else:
        bad = nodes.sparkSession.createDataFrame([], "kind string, id string, field string, reason string, value string")
    return Snapshot(active, held, bad)


def retract_cascade(node: str | Column, edges: DataFrame, already: DataFrame) -> DataFrame:
    """Incident edges to close with a node: id, cascaded_from; those in ``already`` (id) are left alone.

    ``edges``: id, source, target; a column of ids makes it a batch (column ``subject`` of a frame named by ``node``).
    """
    target = F.lit(node) if isinstance(node, str) else node
    incident = edges.where((F.col("source") == target) | (F.col("target") == target)).select("id", target.alias("cascaded_from")).distinct()
    return incident.join(already.select("id"), "id", "left_anti")


def retract_cascade_many(nodes: DataFrame, edges: DataFrame, already: DataFrame) -> DataFrame:
    """The cascade for every id of ``nodes``: two equi joins instead of one with OR."""
    out = edges.join(nodes.select(F.col("id").alias("cascaded_from")), F.col("source") == F.col("cascaded_from"))
    back = edges.join(nodes.select(F.col("id").alias("cascaded_from")), F.col("target") == F.col("cascaded_from"))
    both = out.select("id", "cascaded_from").union(back.select("id", "cascaded_from")).distinct()
    return both.join(already.select("id"), "id", "left_anti")


def supersede_retractions(retractions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Retractions of (subject_kind, subject) that have no tombstone."""
    return retractions.join(tombstones.select("subject_kind", "subject"), ["subject_kind", "subject"], "left_anti")
