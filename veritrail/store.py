"""The store: lazy reads over one log, explicit validated writes."""

from __future__ import annotations

import datetime as dt
import json
import secrets
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions.canonical import canonical_json
from .functions.instants import instant, parse_instant
from .operators import causal, chain, extract, identity, link, resolve, retrieval, temporal, views
from .schema import EDGE_TYPES, KINDS, PURGE_SCOPE, SUGGEST_MIN_SCORE
from .sources.log import LogStore


def _now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class Store:
    """``clock`` and ``salt`` are injected, so plans and tests stay deterministic."""

    def __init__(self, spark: SparkSession, path: str, workspace: str, clock: Callable[[], str] = _now, salt: Callable[[], str] = lambda: secrets.token_hex(16)) -> None:
        if not workspace:
            raise EngineError("workspace_unresolved")
        self.spark, self.workspace, self.clock, self.salt = spark, workspace, clock, salt
        self.files = LogStore(spark, path)
        if not self.verify().where(~F.col("valid")).isEmpty():
            raise EngineError("chain_invalid")

    # reads

    @property
    def log(self) -> DataFrame:
        return self.files.read()

    def read_log(self, limit: int = 50) -> DataFrame:
        """The newest rows of this workspace, newest first."""
        return self.log.where(F.col("workspace") == self.workspace).orderBy(F.desc("seq")).limit(limit)

    def verify(self) -> DataFrame:
        return chain.chain_report(self.log, order="seq")

    def _meta(self, *names: str) -> list[Column]:
        return [F.get_json_object("meta", f"$.{n}").alias(_snake(n)) for n in names]

    def live(self) -> DataFrame:
        return views.live(self.log)

    def get(self, id_: str, kind: str | None = None) -> Row | None:
        """A live record (of a kind: node, decision or edge), or None."""
        rows = self.live().where(F.col("id") == id_)
        return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("seq").first()

    def content_of(self, id_: str, at: str | None = None) -> Any | None:
        """The content that answers for a record: its canonical record's, through an active merge; None where erased or unknown."""
        row = self.contents([id_], at).first()
        return None if row is None or row["content"] is None else json.loads(row["content"])

    def contents(self, ids: Iterable[str], at: str | None = None) -> DataFrame:
        """requested, id, via, content."""
        return views.content_of(self.log, self.resolve_ids(ids, at))

    def retractions(self) -> DataFrame:
        rows = self.log.where("kind = 'retraction'").select(*self._meta("subject", "validFrom", "recordedAt"))
        return rows.select("subject", parse_instant(F.coalesce("valid_from", "recorded_at"))["ts"].alias("at"), parse_instant(F.col("recorded_at"))["ts"].alias("recorded_at"))

    def nodes(self) -> DataFrame:
        return self.live().where(F.col("kind").isin("node", "decision"))

    def decisions(self) -> DataFrame:
        return self.live().where("kind = 'decision'")

    def edges(self) -> DataFrame:
        rows = self.live().where("kind = 'edge'").select("id", "seq", *self._meta("source", "target", "edgeType", "weight"))
        return rows.select("id", "seq", "source", "target", F.coalesce("edge_type", F.lit("INFLUENCED")).alias("type"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))

    def named(self) -> DataFrame:
        """id, name, type of live nodes and decisions: the first of four fields that is not blank."""
        return self.nodes().select("id", views.name_of(F.col("content")).alias("name"), F.col("kind").alias("type")).where("name is not null")

    def texts(self) -> DataFrame:
        """id, text, purged of every record that may be cited."""
        return self.log.where(F.col("kind").isin("node", "decision", "edge")).select("id", views.text_of(F.col("content")).alias("text"), chain.is_purged().alias("purged"))

    def searchable(self, content_only: bool = False) -> DataFrame:
        """id, text: content as JSON (its keys are words too), or with ``content_only`` its text field."""
        return views.searchable(self.log, content_only)

    def state_at(self, valid_at: str, as_of: str | None = None, compat: bool = False) -> temporal.Snapshot:
        rows = self.live().select("id", "kind", *self._meta("recordedAt", "validFrom", "validUntil", "source", "target"))
        gone = self.retractions()
        if as_of is not None and not compat:
            gone = gone.where(F.col("recorded_at") <= F.lit(instant(as_of)))
        first = gone.groupBy(F.col("subject").alias("id")).agg(F.min("at").alias("_c"))
        end = parse_instant(F.col("valid_until"))["ts"]
        closed = F.date_format(F.to_timestamp(F.least(end, F.col("_c"))), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        rows = rows.join(first, "id", "left").withColumn("valid_until", F.when(F.col("_c").isNull(), F.col("valid_until")).otherwise(closed)).drop("_c")
        nodes, edges = rows.where("kind in ('node', 'decision')"), rows.where("kind = 'edge' and source is not null and target is not null")
        return temporal.state_at(nodes, edges, valid_at, as_of, raw=True)

    def why(self, ids: Iterable[str], direction: str = "upstream", max_depth: int = 5) -> DataFrame:
        starts = self.spark.createDataFrame([(i,) for i in ids], "start string")
        chains = causal.report(causal.find_chains(self.edges(), starts, direction, max_depth))
        return chains.withColumn("path", causal.chain_path(direction))

    def find(self, queries: Mapping[str, str], limit: int = 10) -> retrieval.Retrieved:
        asked = self.spark.createDataFrame(list(queries.items()), "query_id string, query string")
        return retrieval.retrieve(self.searchable(), self.edges().select("source", "target"), asked, limit)

    def suggest(self, min_score: float = SUGGEST_MIN_SCORE) -> tuple[DataFrame, DataFrame]:
        return resolve.suggest(self.named(), min_score)

    def link(self, mentions: DataFrame, limit: int | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        return link.link(mentions, self.named(), exclude, limit)

    def propose(self, rules=extract.DEFAULT_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(relations stated by live records, what polarity suppressed, who subjects and objects may be); writes nothing."""
        texts = self.texts().where(~F.col("purged") & F.col("text").isNotNull())
        found, suppressed = extract.relations(texts, rules)
        found = found.withColumn("proposal", F.concat_ws("#", "source", "rule", F.col("trigger.start").cast("string")))
        mentions = found.select(F.concat("proposal", F.lit("/subject")).alias("mention_id"), F.col("subject_text").alias("mention"), "source")
        mentions = mentions.unionByName(found.select(F.concat("proposal", F.lit("/object")).alias("mention_id"), F.col("object_text").alias("mention"), "source"))
        ranked, _ = self.link(mentions.select("mention_id", "mention"), 3, mentions.select("mention_id", F.col("source").alias("id")))
        return found, suppressed, ranked

    def merges(self, at: str | None = None, bound: str = "inclusive") -> DataFrame:
        rows = self.log.where("kind = 'merge'").select("id", "seq", F.from_json(F.get_json_object("meta", "$.members"), "array<string>").alias("members"), *self._meta("canonical", "validFrom", "validUntil"))
        rows = rows.withColumns({c: parse_instant(F.col(c))["ts"] for c in ("valid_from", "valid_until")})
        return identity.active_merges(rows, self.retractions(), F.lit(instant(at or self.clock())), bound)

    def resolve_ids(self, ids: Iterable[str], at: str | None = None) -> DataFrame:
        return identity.resolve_ids(self.spark.createDataFrame([(i,) for i in ids], "id string"), self.merges(at))

    def merged_view(self, at: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        pairs = F.explode(F.from_json("content", "map<string,string>"))
        fields = self.nodes().select("id", pairs.alias("field", "value"))
        return identity.merged_view(self.merges(at), fields, self.nodes())

    def evidence(self) -> DataFrame:
        """id, source, start, end, quote, reason of edges that carry a trigger span."""
        spans = self.live().where("kind = 'edge'").select("id", F.from_json(F.get_json_object("meta", "$.triggerSpan"), "source string, start double, end double").alias("s"))
        return extract.resolve_spans(spans.where("s is not null").select("id", "s.*"), self.texts())

    def graph_view(self) -> tuple[DataFrame, DataFrame]:
        """(nodes: id, kind, label, purged, valid_from, valid_until, recorded_at, n_edges; live edges: id, source, target,
        type, weight, has_evidence); ``verify`` has the state of the chain."""
        nodes = self.log.where("kind in ('node', 'decision')").select("id", "kind", "content", chain.is_purged().alias("purged"), *self._meta("validFrom", "validUntil", "recordedAt"))
        spans = self.live().where("kind = 'edge'").select("id", F.get_json_object("meta", "$.triggerSpan").isNotNull().alias("has_evidence"))
        return views.graph(nodes, self.edges().drop("seq").join(spans, "id"))

    def why_contents(self, ids: Iterable[str], direction: str = "upstream", max_depth: int = 5) -> DataFrame:
        """Chains with the content of each of their nodes."""
        return causal.decision_content(self.why(ids, direction, max_depth), self.live())

    # writes

    def _write(self, rows: list[dict[str, Any]], rewrite: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Under the lock: chain ``rows`` to the head and add them, or rewrite the log with them."""
        log = self.log
        head = log.where(F.col("workspace") == self.workspace).agg(F.max_by(F.struct("seq", "digest"), "seq").alias("h")).first()["h"]
        shape = "workspace string, pos long, kind string, id string, content string, meta string, salt string, head_seq long, head_digest string"
        made = []
        for i, r in enumerate(rows):
            if r["content"] is None:
                raise EngineError("null_content")
            if r.get("meta", {}).get("workspace", self.workspace) != self.workspace:
                raise EngineError("workspace_mismatch")
            meta = {"workspace": self.workspace, "recordedAt": self.clock(), **{k: v for k, v in r.get("meta", {}).items() if v is not None}}
            made.append((self.workspace, i, r["kind"], r["id"], canonical_json(r["content"]), canonical_json(meta), self.salt(), head["seq"] if head else None, head["digest"] if head else None))
        fresh = chain.fold(self.spark.createDataFrame(made, shape)) if made else None
        if rewrite is None:
            self.files.append(fresh)
        else:
            self.files.rewrite(rewrite(log).unionByName(fresh))

    def _known(self, ids: Iterable[str]) -> dict[str, dict]:
        ids = list(ids)
        rows = self.log.where(F.col("id").isin(*ids)).select("id", "kind", "seq", "content_digest", chain.is_purged().alias("purged")).orderBy("seq").collect() if ids else []
        return {r["id"]: r.asDict() for r in reversed(rows)}

    def append(self, records: list[dict[str, Any]]) -> None:
        """``records``: kind, id, content, meta.  Ids are unique; edges are checked."""
        with self.files.lock():
            ids = [r["id"] for r in records]
            if len(set(ids)) < len(ids) or self._known(ids):
                raise EngineError("duplicate_id")
            ends = {m.get(e) for r in records if r["kind"] == "edge" for m in [r.get("meta", {})] for e in ("source", "target")}
            known = {*self._known(e for e in ends if e), *ids}
            for r in records:
                if r["kind"] == "edge":
                    meta = r.setdefault("meta", {})
                    if meta.get("edgeType", "INFLUENCED") not in EDGE_TYPES:
                        raise EngineError("unknown_edge_type")
                    if not 0 <= meta.get("weight", 1) <= 1:
                        raise EngineError("weight_out_of_range")
                    if not {meta.get("source"), meta.get("target")} <= known:
                        raise EngineError("endpoint_not_found")
                if r["content"] is None:
                    raise EngineError("null_content")
            self._write(records)

    def append_frame(self, records: DataFrame, order: str = "pos") -> None:
        """``records``: kind, id, content and meta (JSON), ``order``, and optionally workspace.  Checked as ``append`` checks,
        by joins; no row passes through the driver, and what is refused is refused whole."""
        rows = records.withColumn("workspace", F.coalesce("workspace", F.lit(self.workspace)) if "workspace" in records.columns else F.lit(self.workspace))
        meta = F.coalesce("meta", F.lit("{}"))
        field = lambda name: F.get_json_object(meta, f"$.{name}")
        edge = F.col("kind") == "edge"
        weight = F.coalesce(field("weight").cast("double"), F.lit(1.0))
        problem = (
            F.when(F.coalesce(field("workspace"), F.col("workspace")) != self.workspace, "workspace_mismatch")
            .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown_kind")
            .when(F.col("content").isNull() | (F.col("content") == "null"), "null_content")
            .when(edge & ~F.coalesce(field("edgeType"), F.lit("INFLUENCED")).isin(*EDGE_TYPES), "unknown_edge_type")
            .when(edge & ~weight.between(0, 1), "weight_out_of_range")
        )
        with self.files.lock():
            log = self.log
            bad = rows.select(problem.alias("code")).where("code is not null").first()
            if bad is not None:
                raise EngineError(bad["code"])
            ids = rows.select("id")
            if not ids.groupBy("id").count().where("count > 1").isEmpty() or not ids.join(log.select("id"), "id", "left_semi").isEmpty():
                raise EngineError("duplicate_id")
            ends = rows.where(edge).select(F.explode(F.array(field("source"), field("target"))).alias("id"))
            if not ends.where("id is null").isEmpty() or not ends.join(log.select("id").unionByName(ids), "id", "left_anti").isEmpty():
                raise EngineError("endpoint_not_found")
            head = log.where(F.col("workspace") == self.workspace).agg(F.max_by(F.struct("seq", "digest"), "seq").alias("h")).first()["h"]
            own = {"workspace": self.workspace, "recordedAt": self.clock()}
            # one salt for the batch, made different for each record by its id
            salt = F.substring(F.sha2(F.concat(F.lit(self.salt()), "id").cast("binary"), 256), 1, 32)
            stated = F.map_concat(F.from_json(F.lit(json.dumps(own)), "map<string,variant>"), F.map_filter(F.from_json(meta, "map<string,variant>"), lambda k, v: ~k.isin(*own) & ~F.is_variant_null(v)))
            fresh = rows.select(
                "workspace", F.col(order).alias("pos"), "kind", "id", "content", F.to_json(stated).alias("meta"), salt.alias("salt"),
                F.lit(head["seq"] if head else None).cast("long").alias("head_seq"), F.lit(head["digest"] if head else None).cast("string").alias("head_digest"),
            )
            self.files.append(chain.fold(fresh))

    def link_records(self, source: str, target: str, edge_type: str, weight: float = 1.0) -> None:
        self.append([{"kind": "edge", "id": f"{source}->{target}:{edge_type}", "content": {}, "meta": {"source": source, "target": target, "edgeType": edge_type, "weight": weight}}])

    def retract(self, id_: str, reason: str, at: str | None = None) -> None:
        closed = at or self.clock()
        instant(closed)
        with self.files.lock():
            known = self._known([id_])
            if id_ not in known:
                raise EngineError("not_found")
            n = self.log.where(F.col("id").startswith(f"retract:{id_}:")).count()
            self._write([{"kind": "retraction", "id": f"retract:{id_}:{n + 1}", "content": {"reason": reason}, "meta": {"subject": id_, "subjectKind": known[id_]["kind"], "reason": reason, "validFrom": closed}}])

    def purge(self, id_: str, reason: str) -> None:
        with self.files.lock():
            known = self._known([id_])
            if id_ not in known:
                raise EngineError("not_found")
            if known[id_]["purged"]:
                raise EngineError("already_purged")
            if not self.merges(bound="after").where(F.col("canonical") == id_).isEmpty():
                raise EngineError("canonical_of_active_merge")
            tomb = {"kind": "tombstone", "id": f"purge:{id_}", "content": {"reason": reason}, "meta": {"subject": id_, "subjectKind": known[id_]["kind"], "reason": reason, "contentDigest": known[id_]["content_digest"], "scope": PURGE_SCOPE}}
            self._write([tomb], lambda log: chain.purge_content(log, [id_]))

    def merge(self, members: list[str], canonical: str, reason: str) -> None:
        names = sorted(set(members))
        if len(names) < 2:
            raise EngineError("merge_too_small")
        if canonical not in names:
            raise EngineError("canonical_not_a_member")
        with self.files.lock():
            if set(names) - set(self._known(names)):
                raise EngineError("not_found")
            if not self.merges().where(F.arrays_overlap("members", F.array(*map(F.lit, names)))).isEmpty():
                raise EngineError("member_already_merged")
            n = self.log.where("kind = 'merge'").count()
            self._write([{"kind": "merge", "id": f"merge:{'+'.join(names)}:{n + 1}", "content": {"reason": reason}, "meta": {"members": names, "canonical": canonical, "reason": reason, "validFrom": self.clock()}}])

    def confirm(self, proposal: Mapping[str, Any], source: str, target: str, note: str = "") -> None:
        """Write a proposed relation between two records that the caller names."""
        with self.files.lock():
            if {source, target} - set(self._known([source, target])):
                raise EngineError("endpoint_not_found")
            span = {"source": proposal["source"], "start": proposal["trigger"]["start"], "end": proposal["trigger"]["end"]}
            held = extract.resolve_spans(self.spark.createDataFrame([(span["source"], float(span["start"]), float(span["end"]))], "source string, start double, end double"), self.texts()).first()
            if held["reason"] is not None:
                raise EngineError("span_unresolvable", held["reason"])
            spans = {f"{part}Span": {"source": proposal["source"], "start": proposal[part]["start"], "end": proposal[part]["end"]} for part in ("subject", "object", "trigger")}
            id_ = f"{source}->{target}:{proposal['predicate']}@{span['source']}:{span['start']}"
            if self._known([id_]):
                raise EngineError("duplicate_id")
            self._write([{"kind": "edge", "id": id_, "content": {"note": note}, "meta": {"source": source, "target": target, "edgeType": proposal["predicate"], "weight": 1, "rule": proposal["rule"], **spans}}])

    def record_retrieval(self, found: retrieval.Retrieved) -> None:
        """A ledger row for each decision: hashes, ids and margins, never the query."""
        bounds: dict[str, list] = {}
        for r in found.margins.orderBy("channel").collect():
            bounds.setdefault(r["query_id"], []).append({k: r[k] for k in ("channel", "considered", "top_score", "floor", "margin")})
        rows = found.decisions.orderBy("query_id").collect()  # one for each query asked
        with self.files.lock():
            n = self.log.where("kind = 'retrieval'").count()
            self._write([
                {"kind": "retrieval", "id": f"retrieval:{n + i + 1}", "content": {"outcome": r["outcome"], "reason": r["reason"], "queryHash": r["query_hash"], "queryChars": r["query_chars"], "served": list(r["served"]), "channels": json.loads(json.dumps(bounds.get(r["query_id"], [])))}}
                for i, r in enumerate(rows)
            ])


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
