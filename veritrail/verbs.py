"""What can be asked of a store by name: the same sixteen verbs for every surface, none with logic of its own."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import EngineError
from .store import Store

#: Rows of one answer; a longer one says so.
ANSWER_ROWS = 1000


class Verb(NamedTuple):
    run: Callable[..., Any]
    says: str
    #: name -> (kind, default); ``...`` where it must be given.
    takes: dict[str, tuple[type, Any]]
    writes: bool = False
    #: name -> (least, most)
    bounds: dict[str, tuple[float, float]] = {}


def rows_of(frame: DataFrame, limit: int = ANSWER_ROWS) -> dict[str, Any]:
    rows = [json.loads(r) for r in frame.limit(limit + 1).toJSON().collect()]
    return {"rows": rows[:limit], "more": len(rows) > limit}


def _record(s: Store, kind: str, id: str, content: dict, validFrom: str | None, validUntil: str | None) -> dict:
    s.append([{"kind": kind, "id": id, "content": content, "meta": {"validFrom": validFrom, "validUntil": validUntil}}])
    return {"id": id}


def _link(s: Store, source: str, target: str, type: str, weight: float) -> dict:
    s.link_records(source, target, type, weight)
    return {"id": f"{source}->{target}:{type}"}


def _retract(s: Store, id: str, reason: str, at: str | None) -> dict:
    s.retract(id, reason, at)
    return {"retracted": id}


def _purge(s: Store, id: str, reason: str) -> dict:
    s.purge(id, reason)
    return {"purged": id}


def _at(s: Store, validAt: str, asOf: str | None) -> dict:
    found = s.state_at(validAt, asOf)
    return {"validAt": validAt, "nodes": rows_of(found.nodes.select("id", "kind")), "edges": rows_of(found.edges.select("id", "source", "target")), "rejected": rows_of(found.rejected)}


def _why(s: Store, id: str, direction: str, depth: int) -> dict:
    return rows_of(s.why([id], direction, depth).select("path", "depth", "product_confidence", "weakest_confidence", "weakest_link", "distance_band"))


def _find(s: Store, query: str, limit: int, record: bool) -> dict:
    found = s.find({"q": query}, limit)
    decided = rows_of(found.decisions.drop("query_id"))["rows"][0]
    if record:
        s.record_retrieval(found)
    return {**decided, "items": rows_of(found.served.drop("query_id").orderBy("position")), "channels": rows_of(found.margins.drop("query_id"))}


def _suggest(s: Store, minScore: float) -> dict:
    members, clusters = s.suggest(minScore)
    return {"clusters": rows_of(clusters), "members": rows_of(members)}


def _merge(s: Store, members: list, canonical: str, reason: str) -> dict:
    s.merge([*members, canonical], canonical, reason)
    return {"canonical": canonical}


def _extract(s: Store, source: str | None) -> dict:
    found, suppressed, ranked = s.propose()
    if source is not None:
        found, suppressed = found.where(F.col("source") == source), suppressed.where(F.col("source") == source)
        ranked = ranked.join(found.select("proposal").distinct(), F.expr("split_part(mention_id, '/', 1) = proposal"), "left_semi")
    return {"proposals": rows_of(found), "suppressed": rows_of(suppressed), "candidates": rows_of(ranked)}


def _confirm(s: Store, proposal: str, source: str, target: str, note: str) -> dict:
    row = s.propose()[0].where(F.col("proposal") == proposal).first()
    if row is None:
        raise EngineError("not_found")
    s.confirm(row.asDict(recursive=True), source, target, note)
    return {"confirmed": proposal}


def _refers(s: Store, mention: str, limit: int) -> dict:
    ranked, verdict = s.link(s.spark.createDataFrame([("m", mention)], "mention_id string, mention string"), limit)
    return {**rows_of(verdict.drop("mention_id"))["rows"][0], "candidates": rows_of(ranked.drop("mention_id").orderBy("rank"))}


def _view(s: Store, id: str, at: str | None) -> dict:
    canonical = s.resolve_ids([id], at).first()["canonical"]
    fields, conflicts, unavailable = (rows_of(part.where(part["canonical"] == canonical)) for part in s.merged_view(at))
    return {"requested": id, "canonical": canonical, "fields": fields, "conflicts": conflicts, "unavailable": unavailable}


def _evidence(s: Store, edge: str | None) -> dict:
    found = s.evidence()
    return rows_of(found if edge is None else found.where(F.col("id") == edge))


def _verify(s: Store) -> dict:
    return rows_of(s.verify().where(F.col("workspace") == s.workspace))


def _log(s: Store, limit: int) -> dict:
    newest = s.read_log(limit).select("seq", "kind", "id", (F.col("salt").isNull() & F.col("content").isNull()).alias("purged"))
    return rows_of(newest.orderBy("seq"), limit)


def graph(s: Store) -> dict:
    nodes, edges = s.graph_view()
    return {"nodes": rows_of(nodes), "edges": rows_of(edges), "chain": _verify(s)["rows"]}


VERBS = {
    "record": Verb(_record, "Write a node or a decision.", {"kind": (str, ...), "id": (str, ...), "content": (dict, ...), "validFrom": (str, None), "validUntil": (str, None)}, True),
    "link": Verb(_link, "Write an edge between two records.", {"source": (str, ...), "target": (str, ...), "type": (str, ...), "weight": (float, 1.0)}, True, {"weight": (0, 1)}),
    "retract": Verb(_retract, "Close the validity of a record; it stays in the log.", {"id": (str, ...), "reason": (str, ...), "at": (str, None)}, True),
    "purge": Verb(_purge, "Erase the content of a record from this store for good.", {"id": (str, ...), "reason": (str, ...)}, True),
    "at": Verb(_at, "What was true at an instant, or believed then.", {"validAt": (str, ...), "asOf": (str, None)}),
    "why": Verb(_why, "Causal chains from a record, with their weakest links.", {"id": (str, ...), "direction": (str, "upstream"), "depth": (int, 5)}, False, {"depth": (1, 20)}),
    "find": Verb(_find, "Records that answer a query, or a refusal with its reason; leaves a ledger row unless record is false.", {"query": (str, ...), "limit": (int, 10), "record": (bool, True)}, True, {"limit": (1, 50)}),
    "suggest": Verb(_suggest, "Records that look like duplicates; merges nothing.", {"minScore": (float, 0.7)}, False, {"minScore": (0, 1)}),
    "merge": Verb(_merge, "State that some records are one.", {"members": (list, ...), "canonical": (str, ...), "reason": (str, ...)}, True),
    "extract": Verb(_extract, "Relations that texts state, with their spans; writes nothing.", {"source": (str, None)}),
    "confirm": Verb(_confirm, "Write a proposed relation between two records.", {"proposal": (str, ...), "source": (str, ...), "target": (str, ...), "note": (str, "")}, True),
    "refers": Verb(_refers, "Which records a phrase may refer to, with a verdict.", {"mention": (str, ...), "limit": (int, 5)}, False, {"limit": (1, 50)}),
    "view": Verb(_view, "The merged view of a record, with conflicts.", {"id": (str, ...), "at": (str, None)}),
    "evidence": Verb(_evidence, "The text that an edge rests on.", {"edge": (str, None)}),
    "verify": Verb(_verify, "Whether the log was altered.", {}),
    "log": Verb(_log, "The newest records in append order, and which have been erased.", {"limit": (int, 50)}, False, {"limit": (1, 500)}),
}


class BadArguments(ValueError):
    """The caller's arguments do not fit the verb."""


def ask(store: Store, name: str, given: Mapping[str, Any]) -> Any:
    """Checks the arguments and runs a verb."""
    if name not in VERBS:
        raise BadArguments(f"no such verb: {name}")
    verb = VERBS[name]
    if unknown := sorted(set(given) - set(verb.takes)):
        raise BadArguments(f"{name} does not take {', '.join(unknown)}")
    args = {}
    for key, (kind, default) in verb.takes.items():
        value = given.get(key, default)
        if value is ...:
            raise BadArguments(f"{name} needs {key}")
        fits = isinstance(value, int | float) and not isinstance(value, bool) if kind is float else isinstance(value, kind) and not (kind is int and isinstance(value, bool))
        if value is not None and not fits:
            raise BadArguments(f"{key} must be of type {kind.__name__}")
        least, most = verb.bounds.get(key, (None, None))
        if value is not None and least is not None and not least <= value <= most:
            raise BadArguments(f"{key} must be between {least} and {most}")
        args[key] = value
    return verb.run(store, **args)
