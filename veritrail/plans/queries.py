"""One query per operator over the star mapping, each beside its SQL twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonicalise
from ..functions.instants import parse_instant
from ..functions.text import acronyms, infer_type, name_tokens, phonetic, tokenise
from ..operators import causal, chain, evaluate, extract, identity, link, postings, resolve, retrieval, temporal, views
from ..session import durable, small_batches
from ..streaming import tail
from . import parts, star

AT, AS_OF = "1998-06-01T00:00:00Z", "1998-03-01T00:00:00Z"
_AT, _AS_OF = "TIMESTAMP '1998-06-01'", "TIMESTAMP '1998-03-01'"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' timestamps carry no zone
            small_batches(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


# snapshots

_ACTIVE = f"active AS (SELECT * FROM nodes WHERE (valid_from IS NULL OR valid_from <= {_AT}) AND (valid_until IS NULL OR {_AT} <= valid_until))"


@query(_with(star.NODES, _ACTIVE) + " SELECT id, kind FROM active")
def state_at_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.state_at(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), AT).nodes.select("id", "kind")


@query(
    _with(star.NODES, star.EDGES, _ACTIVE)
    + f" SELECT id, source, target FROM edges WHERE valid_from <= {_AT} AND (valid_until IS NULL OR {_AT} <= valid_until) AND source IN (SELECT id FROM active) AND target IN (SELECT id FROM active)"
)
def state_at_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.state_at(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), AT).edges.select("id", "source", "target")


@query(_with(star.NODES, _ACTIVE) + f" SELECT id, kind FROM active WHERE recorded_at <= {_AS_OF}")
def state_at_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.state_at(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), AT, AS_OF).nodes.select("id", "kind")


@query(_with(star.NODES, _ACTIVE) + f" SELECT id FROM active EXCEPT SELECT id FROM active WHERE recorded_at <= {_AS_OF}")
def belief_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds now and was not yet believed then."""
    nodes, edges = star.nodes(spark, sf_dir), star.edges(spark, sf_dir)
    now, then = (temporal.state_at(nodes, edges, AT, as_of).nodes.select("id") for as_of in (None, AS_OF))
    return now.subtract(then)


_STATED = """CASE k WHEN 1 THEN '' WHEN 2 THEN {day} || 'T10:00:00' WHEN 4 THEN '2024-02-30' WHEN 5 THEN {day} || 'T23:59:59+02:00' WHEN 6 THEN {day} || ' 10:00:00Z' ELSE {day} END AS valid_from,
  CASE k WHEN 3 THEN {before} WHEN 6 THEN '2026-13-45T00:00:00Z' END AS valid_until, CASE k WHEN 7 THEN 'not-a-date' ELSE {day} END AS recorded_at"""


@query(
    "WITH stated AS (SELECT 'o:' || o_orderkey AS id, "
    + _STATED.replace("{day}", "strftime(o_orderdate, '%Y-%m-%d')").replace("{before}", "strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d')")
    + ", k FROM (SELECT *, o_orderkey % 8 AS k FROM orders)) SELECT id, 'validFrom' AS field, 'malformed_temporal_value' AS reason, valid_from AS value FROM stated WHERE k IN (1, 4, 6)"
    " UNION ALL SELECT id, 'validFrom', 'ambiguous_timezone', valid_from FROM stated WHERE k = 2 UNION ALL SELECT id, 'window', 'inverted_window', valid_from || '/' || valid_until FROM stated WHERE k = 3"
    " UNION ALL SELECT id, 'validUntil', 'malformed_temporal_value', valid_until FROM stated WHERE k = 6 UNION ALL SELECT id, 'recordedAt', 'malformed_temporal_value', recorded_at FROM stated WHERE k = 7"
)
def temporal_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose instants are stated in eight ways, most of them wrong."""
    parts_ = [x.strip() for x in _STATED.replace("{day}", "date_format(o_orderdate, 'yyyy-MM-dd')").replace("{before}", "date_format(o_orderdate - interval 1 day, 'yyyy-MM-dd')").split("AS valid_from,")]
    valid_from, (valid_until, recorded_at) = parts_[0], parts_[1].split("AS valid_until,")
    orders = star.table(spark, sf_dir, "orders").selectExpr("*", "o_orderkey % 8 AS k")
    rows = orders.selectExpr("'o:' || o_orderkey AS id", f"{valid_from} AS valid_from", f"{valid_until} AS valid_until", recorded_at)
    none = rows.limit(0).selectExpr("*", "id as source", "id as target")
    return temporal.state_at(rows, none, "2024-03-01", raw=True).rejected.drop("kind")


@query("SELECT o_orderkey::VARCHAR AS key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def parse_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("raw"))
    return raw.select("key", F.date_format(parse_instant(F.col("raw"))["ts"], "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    _with(star.NODES, star.RETRACTIONS)
    + " SELECT n.id, strftime(least(coalesce(valid_until, min_at), coalesce(min_at, valid_until)), '%Y-%m-%d') AS until FROM nodes n LEFT JOIN (SELECT subject, min(at_time) AS min_at FROM retractions GROUP BY subject) r ON r.subject = n.id"
)
def effective_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.effective_until(star.nodes(spark, sf_dir), star.retractions(spark, sf_dir))
    return rows.select("id", F.date_format("effective_until", "yyyy-MM-dd").alias("until"))


@query(
    _with(star.EDGES, star.RETRACTIONS, "already AS (SELECT 'o:' || l_orderkey || '->p:' || l_partkey || '#' || l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R')")
    + " SELECT DISTINCT e.id, r.subject AS cascaded_from FROM edges e JOIN retractions r ON r.subject = e.source OR r.subject = e.target WHERE e.id NOT IN (SELECT id FROM already)"
)
def retract_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = star.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    already = returned.select(F.concat(F.lit("o:"), "l_orderkey", F.lit("->p:"), "l_partkey", F.lit("#"), "l_linenumber").alias("id"))
    return temporal.retract_cascade_many(star.retractions(spark, sf_dir).select(F.col("subject").alias("id")), star.edges(spark, sf_dir), already)


@query("SELECT 'o:' || o_orderkey AS subject FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def supersede_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = star.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("decision").alias("subject_kind"), F.concat(F.lit("o:"), "o_orderkey").alias("subject"))
    gone = star.retractions(spark, sf_dir).withColumn("subject_kind", F.lit("decision"))
    return temporal.supersede_retractions(gone, dead).select("subject")


# chain


def _own() -> Column:
    return F.sha2(F.concat("id", F.lit("|"), "content_digest").cast("binary"), 256)


def _problems(log: DataFrame) -> DataFrame:
    return chain.verify(log, own=_own()).select("workspace", "pos", "id", "seq", "reason")


_VERIFY = """checked AS (SELECT *, lag(digest) OVER w AS before_digest, coalesce(lag(seq) OVER w, 0) + 1 AS next_seq FROM {log} WINDOW w AS (PARTITION BY workspace ORDER BY pos)),
problems AS (
  SELECT workspace, pos, id, seq, 'content_tampered' AS reason FROM checked WHERE content IS NOT NULL AND sha256('2:' || salt || content) <> content_digest
  UNION ALL SELECT workspace, pos, id, seq, 'digest_mismatch' FROM checked WHERE sha256(id || '|' || content_digest) <> digest
  UNION ALL SELECT workspace, pos, id, seq, 'chain_break' FROM checked WHERE prev IS DISTINCT FROM before_digest
  UNION ALL SELECT workspace, pos, id, seq, 'sequence_gap' FROM checked WHERE seq <> next_seq)"""
_PROBLEMS = " SELECT workspace, pos, id, seq, reason FROM problems"


@query(_with(star.EVENT_LOG, _VERIFY.replace("{log}", "log")) + " SELECT workspace, count(*) AS total, 0 AS purged, 0 AS problems, true AS valid FROM log WHERE (SELECT count(*) FROM problems) = 0 GROUP BY workspace")
def chain_verify_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.chain_report(star.event_log(spark, sf_dir), own=_own())


@query(
    _with(star.EVENT_LOG, "bad AS (SELECT * REPLACE (CASE WHEN pos % 97 = 0 THEN content || ' ' ELSE content END AS content, CASE WHEN pos % 101 = 0 THEN reverse(digest) ELSE digest END AS digest) FROM log)", _VERIFY.replace("{log}", "bad"))
    + _PROBLEMS
)
def chain_verify_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = star.event_log(spark, sf_dir)
    bad = {"content": F.when(F.col("pos") % 97 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")), "digest": F.when(F.col("pos") % 101 == 0, F.reverse("digest")).otherwise(F.col("digest"))}
    return _problems(log.withColumns(bad))


@query(_with(star.EVENT_LOG, "gone AS (SELECT * FROM log WHERE event_type <> 'signup')", _VERIFY.replace("{log}", "gone")) + _PROBLEMS)
def chain_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(star.event_log(spark, sf_dir).where("event_type <> 'signup'"))


@query(_with(star.EVENT_LOG) + " SELECT id, CASE WHEN event_type = 'error' THEN NULL ELSE salt END AS salt, CASE WHEN event_type = 'error' THEN NULL ELSE content END AS content, event_type = 'error' AS purged, digest FROM log")
def purge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = star.event_log(spark, sf_dir)
    return views.purged(chain.purge_content(log, log.where("event_type = 'error'").select("id")))


@query(_with(star.EVENT_LOG) + " SELECT workspace, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS purged, count(*) FILTER (WHERE event_type = 'signup') AS problems, count(*) FILTER (WHERE event_type = 'signup') = 0 AS valid FROM log GROUP BY workspace")
def chain_half_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erased rows verify; rows that lost their salt but kept their content do not."""
    log = star.event_log(spark, sf_dir)
    log = chain.purge_content(log, log.where("event_type = 'error'").select("workspace", "id"))
    return chain.chain_report(log.withColumn("salt", F.when(F.col("event_type") != "signup", F.col("salt"))), own=_own())


_FOLD = """pieces AS (
  SELECT user_id::VARCHAR AS workspace, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, 'e:' || event_id AS id,
    sha256('2:s' || (event_id % 10) || '{"type":"' || event_type || '"}') AS content_digest FROM events WHERE user_id % 10 = 0),
folded AS (
  SELECT workspace, seq, id, sha256('{"contentDigest":"' || content_digest || '","id":"' || id || '","kind":"node","meta":{},"prev":null,"seq":1}') AS digest FROM pieces WHERE seq = 1
  UNION ALL SELECT p.workspace, p.seq, p.id, sha256('{"contentDigest":"' || p.content_digest || '","id":"' || p.id || '","kind":"node","meta":{},"prev":"' || f.digest || '","seq":' || p.seq || '}')
  FROM folded f JOIN pieces p ON p.workspace = f.workspace AND p.seq = f.seq + 1)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every tenth user as new rows, chained by the engine's own digests."""
    rows = star.event_log(spark, sf_dir).where("cast(workspace as bigint) % 10 = 0")
    return chain.fold(rows.select("workspace", "pos", "kind", "id", "content", F.lit("{}").alias("meta"), "salt"))


@query("WITH RECURSIVE " + _FOLD + " SELECT workspace, seq, id, digest FROM folded")
def chain_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("workspace", "seq", "id", "digest")


@query("WITH RECURSIVE " + _FOLD + " SELECT workspace, count(*) AS total, 0 AS purged, 0 AS problems, true AS valid FROM folded GROUP BY workspace")
def chain_record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of folded rows, computed anew from their stored fields."""
    return chain.chain_report(_folded(spark, sf_dir), order="seq")


@query("SELECT event_id AS key, '{\"a\":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE (event_id % 7)::VARCHAR END || ',\"b\":[true,\"' || event_type || '\"],\"\u00e9\":' || CASE WHEN event_id % 2 = 0 THEN '1e+21' ELSE '0.000001' END || '}' AS canonical FROM events")
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with blanks, keys out of order, escapes and numbers in other notations, in canonical form."""
    a = F.when(F.col("event_id") % 3 == 0, F.lit("null")).otherwise(F.concat((F.col("event_id") % 7).cast("string"), F.lit(".0")))
    number = F.when(F.col("event_id") % 2 == 0, F.lit("1000000000000000000000")).otherwise(F.lit("1E-6"))
    raw = F.concat(F.lit('{ "\\u00e9": '), number, F.lit(', "b" : [ true, "'), "event_type", F.lit('" ],\n"a":'), a, F.lit(" }"))
    return star.table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), canonicalise(raw).alias("canonical"))


# causal

_WALK = """walk AS (
  SELECT s.start, s.start AS at, [s.start] AS nodes, [] :: VARCHAR[] AS hops, 1.0::DOUBLE AS product, []::DOUBLE[] AS ws FROM starts s
  UNION ALL
  SELECT w.start, e.{far}, list_append(w.nodes, e.{far}), list_append(w.hops, e.id), w.product * e.weight, list_append(w.ws, e.weight)
  FROM walk w JOIN turns e ON e.{near} = w.at WHERE len(w.hops) < {depth} AND NOT list_contains(w.nodes, e.{far})),
chains AS (
  SELECT * FROM walk w WHERE len(hops) > 0 AND (len(hops) = {depth} OR NOT EXISTS (SELECT 1 FROM turns e WHERE e.{near} = w.at AND NOT list_contains(w.nodes, e.{far}))))"""
_ENDS = "starts AS (SELECT DISTINCT conv_id || ':' || {f}(turn) AS start FROM conversations GROUP BY conv_id)"


def _walk(direction: str, depth: int) -> str:
    near, far = ("target", "source") if direction == "upstream" else ("source", "target")
    ends = _ENDS.replace("{f}", "max" if direction == "upstream" else "min")
    return "WITH RECURSIVE " + ",\n".join([star.TURNS, ends, _WALK.replace("{near}", near).replace("{far}", far).replace("{depth}", str(depth))])


def _chains(spark: SparkSession, sf_dir: str, direction: str, depth: int) -> DataFrame:
    end = F.max("turn") if direction == "upstream" else F.min("turn")
    starts = star.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(end.alias("t")).select(F.concat("conv_id", F.lit(":"), "t").alias("start"))
    return causal.find_chains(star.turns(spark, sf_dir), starts, direction, depth)


def _hop_ids() -> Column:
    return F.array_join(F.transform("hops", lambda h: h["id"]), " ")


@query(_walk("upstream", 5) + " SELECT start, array_to_string(hops, ' ') AS hop_ids, len(hops)::INT AS depth FROM chains")
def causal_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir, "upstream", 5).select("start", _hop_ids().alias("hop_ids"), "depth")


@query(_walk("downstream", 5) + " SELECT start, array_to_string(hops, ' ') AS hop_ids, len(hops)::INT AS depth FROM chains")
def causal_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir, "downstream", 5).select("start", _hop_ids().alias("hop_ids"), "depth")


@query(
    _walk("downstream", 7)
    + " SELECT start, array_to_string(hops, ' ') AS hop_ids, round(product, 9) AS product_confidence, list_min(ws) AS weakest_confidence, hops[list_position(ws, list_min(ws))] AS weakest_id,"
    " CASE WHEN len(hops) <= 1 THEN 'direct' WHEN len(hops) <= 3 THEN 'near' WHEN len(hops) <= 6 THEN 'mid-range' ELSE 'distant' END AS distance_band FROM chains"
)
def chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = causal.report(_chains(spark, sf_dir, "downstream", 7))
    return rows.select("start", _hop_ids().alias("hop_ids"), F.round("product_confidence", 9).alias("product_confidence"), "weakest_confidence", F.col("weakest_link.id").alias("weakest_id"), "distance_band")


@query(_walk("downstream", 7) + " SELECT CASE WHEN len(hops) <= 1 THEN 'direct' WHEN len(hops) <= 3 THEN 'near' WHEN len(hops) <= 6 THEN 'mid-range' ELSE 'distant' END AS distance_band, count(*) AS n FROM chains GROUP BY 1")
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal.report(_chains(spark, sf_dir, "downstream", 7)).groupBy("distance_band").agg(F.count("*").alias("n"))


@query(_walk("upstream", 5) + " SELECT start, array_to_string(list_reverse(nodes), '>') AS path FROM chains")
def chain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir, "upstream", 5).select("start", F.array_join(causal.chain_path("upstream"), ">").alias("path"))


@query(
    _with(star.EDGES)
    + " SELECT CASE WHEN type = 'INFLUENCED' AND weight < 0.95 THEN 'INFORMED' ELSE type END AS type, count(*) AS n, CASE WHEN type = 'INFLUENCED' AND weight < 0.95 THEN 'unknown_edge_type' WHEN weight >= 1 AND type = 'INFLUENCED' THEN 'weight_out_of_range' END AS reason FROM edges GROUP BY ALL"
)
def edge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star.edges(spark, sf_dir)
    weak, sure = (F.col("type") == "INFLUENCED") & (F.col("weight") < 0.95), (F.col("type") == "INFLUENCED") & (F.col("weight") >= 1)
    sound, bad = causal.check_edges(e.withColumns({"type": F.when(weak, "INFORMED").otherwise(F.col("type")), "weight": F.when(sure, 1.5).otherwise(F.col("weight"))}))
    return sound.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).groupBy("type", "reason").agg(F.count("*").alias("n"))


# retrieval

_LEX = " SELECT query_id, id, round(score, 6) AS score FROM {t}"


@query(_with(star.retrieval_sql()) + _LEX.replace("{t}", "lexical"))
def lexical_channel(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    return retrieval.lexical_channel(star.docs(spark, sf_dir), star.asked(spark, sf_dir, words)).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_with(star.retrieval_sql()) + " SELECT query_id, id, score, rank FROM structural")
def structural_channel(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    seeds, _ = retrieval.lexical_candidates(star.docs(spark, sf_dir), star.asked(spark, sf_dir, words), 0.3)
    return retrieval.structural_channel(star.doc_links(spark, sf_dir), seeds).select("query_id", "id", "score", "rank")


def _retrieved(spark: SparkSession, sf_dir: str, words: int | None, **options) -> retrieval.Retrieved:
    return retrieval.retrieve(star.docs(spark, sf_dir), star.doc_links(spark, sf_dir), star.asked(spark, sf_dir, words), **options)


@query(_with(star.retrieval_sql()) + " SELECT query_id, id, round(fused, 9) AS fused, position FROM served")
def retrieve_served(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    return _retrieved(spark, sf_dir, words).served.select("query_id", "id", F.round("fused", 9).alias("fused"), "position")


@query(_with(star.retrieval_sql(k=1)) + " SELECT query_id, id, round(fused, 9) AS fused, n_channels, position FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    r = _retrieved(spark, sf_dir, words, k=1, limit=10**9).served
    return r.select("query_id", "id", F.round("fused", 9).alias("fused"), F.size("contributions").cast("long").alias("n_channels"), "position")


@query(
    _with(star.retrieval_sql())
    + " SELECT a.query_id, CASE WHEN s.n > 0 THEN 'served' ELSE 'abstained' END AS outcome, CASE WHEN s.n > 0 THEN NULL WHEN c.n IS NULL THEN 'no_candidates' ELSE 'below_floor' END AS reason, substr(sha256(query), 1, 16) AS query_hash, coalesce(s.n, 0) AS n_served"
    " FROM asked a LEFT JOIN (SELECT query_id, count(*) AS n FROM served GROUP BY 1) s USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM channels GROUP BY 1) c USING (query_id)"
)
def retrieve_decision(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    return _retrieved(spark, sf_dir, words).decisions.select("query_id", "outcome", "reason", "query_hash", F.size("served").cast("long").alias("n_served"))


@query(
    _with(star.retrieval_sql())
    + " SELECT a.query_id, n.channel, coalesce(c.considered, 0) AS considered, round(c.top, 6) AS top_score, round(c.top - n.floor, 6) AS margin FROM asked a, (VALUES ('lexical', 0.3::DOUBLE), ('structural', 1.0::DOUBLE)) n(channel, floor)"
    " LEFT JOIN (SELECT query_id, channel, count(*) AS considered, max(score) AS top FROM channels GROUP BY 1, 2) c ON c.query_id = a.query_id AND c.channel = n.channel"
)
def channel_margins(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    return _retrieved(spark, sf_dir, words).margins.select("query_id", "channel", "considered", F.round("top_score", 6).alias("top_score"), F.round("margin", 6).alias("margin"))


def _truth(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    """Documents that hold the text asked for are relevant to it."""
    asked = star.asked(spark, sf_dir, words)
    lists = postings.holders(star.docs(spark, sf_dir), asked).groupBy("query_id").agg(F.collect_set("id").alias("relevant"))
    none = F.array().cast("array<string>")
    return durable(asked.join(lists, "query_id", "left").select("query_id", F.coalesce("relevant", none).alias("relevant"), none.alias("irrelevant")))


_JUDGED = """truth AS (SELECT a.query_id, list(d.doc_id::VARCHAR) FILTER (WHERE d.doc_id IS NOT NULL) AS relevant FROM asked a LEFT JOIN documents d ON contains(d.text, a.query) GROUP BY a.query_id),
judged AS (
  SELECT t.query_id, coalesce(len(relevant), 0) AS n_relevant, count(s.id) AS n_served, count(s.id) FILTER (WHERE list_contains(relevant, s.id)) AS hits, min(s.position) FILTER (WHERE list_contains(relevant, s.id)) AS first
  FROM truth t LEFT JOIN served s USING (query_id) GROUP BY ALL)"""
_RATES = "CASE WHEN n_served > 0 THEN hits / n_served::DOUBLE ELSE 0 END AS p, CASE WHEN n_relevant > 0 THEN hits / n_relevant::DOUBLE ELSE 1 END AS r, coalesce(1.0 / first, 0)::DOUBLE AS rr"


@query(
    _with(star.retrieval_sql(), _JUDGED)
    + f" SELECT query_id, n_relevant > 0 AS answerable, round(p, 6) AS precision, round(r, 6) AS recall, round(rr, 6) AS reciprocal_rank, n_relevant = 0 AND n_served > 0 AS false_serve, n_relevant > 0 AND n_served = 0 AS false_abstain FROM (SELECT *, {_RATES} FROM judged)"
)
def retrieval_eval(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    judged = evaluate.judge_queries(_truth(spark, sf_dir, words), _retrieved(spark, sf_dir, words).served)
    return judged.select("query_id", "answerable", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")], "false_serve", "false_abstain")


def _score_sql(floor: float, k: int, tag: str) -> str:
    sums = f"SELECT avg(p) FILTER (WHERE n_relevant > 0) AS p, avg(r) FILTER (WHERE n_relevant > 0) AS r, avg(rr) FILTER (WHERE n_relevant > 0) AS mrr, count(*) FILTER (WHERE n_relevant = 0 AND n_served > 0) AS fs, count(*) FILTER (WHERE n_relevant > 0 AND n_served = 0) AS fa FROM (SELECT *, {_RATES} FROM judged)"
    return f"SELECT * FROM ({_with(star.retrieval_sql(floor, k), _JUDGED)} SELECT {tag}, round(p, 6) AS precision, round(r, 6) AS recall, round(mrr, 6) AS mrr, fs AS false_serves, fa AS false_abstains, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END - 0.02 * fs - 0.01 * fa, 6) AS score FROM ({sums}))"


def _scored(truth: DataFrame, served: DataFrame) -> DataFrame:
    score = evaluate.retrieval_score(evaluate.judge_queries(truth, served))
    return score.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "score")], "false_serves", "false_abstains")


@query(" UNION ALL ".join(_score_sql(f, 60, f"{f}::DOUBLE AS floor") for f in (0.2, 0.3, 0.4)))
def sweep_floor(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    """Documents are scored once, down to the least floor, and judged by one truth."""
    asked, links, truth = star.asked(spark, sf_dir, words), star.doc_links(spark, sf_dir), _truth(spark, sf_dir, words)
    lexical = retrieval.lexical_candidates(star.docs(spark, sf_dir), asked, 0.2)
    parts = [_scored(truth, retrieval.decide(retrieval.candidates(lexical, links, asked, f), asked).served).withColumn("floor", F.lit(f)) for f in (0.2, 0.3, 0.4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(" UNION ALL ".join(_score_sql(0.3, k, f"{k} AS k") for k in (1, 60, 300)))
def rrf_sweep(spark: SparkSession, sf_dir: str, words: int | None = 8) -> DataFrame:
    """The constant changes nothing before fusion: both channels are scored once."""
    asked, truth = star.asked(spark, sf_dir, words), _truth(spark, sf_dir, words)
    found = retrieval.candidates(retrieval.lexical_candidates(star.docs(spark, sf_dir), asked, 0.3), star.doc_links(spark, sf_dir), asked)
    parts = [_scored(truth, retrieval.decide(found, asked, k=k).served).withColumn("k", F.lit(k)) for k in (1, 60, 300)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _whole(f: Callable[..., DataFrame]) -> None:
    """Registers a query over whole benchmark items beside that over their first words; it has no SQL twin."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir, words=None)

    run.__name__ = f"{f.__name__}_whole"
    query()(run)


for _f in (lexical_channel, structural_channel, retrieve_served, rrf_fuse, retrieve_decision, channel_margins, retrieval_eval, sweep_floor, rrf_sweep):
    _whole(_f)


@query("SELECT doc_id::VARCHAR AS id, len(ts)::INT AS n_tokens, len(list_distinct(ts))::INT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS ts FROM documents)")
def tokenise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star.docs(spark, sf_dir).select("id", tokenise(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("SELECT token, count(*) AS df, round(ln(1 + n / count(*)) / ln(1 + n), 9) AS idf FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents), (SELECT count(*)::DOUBLE AS n FROM documents) GROUP BY token, n")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.docs(spark, sf_dir)
    df = retrieval.doc_tokens(docs).groupBy("token").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").cast("double").alias("n"))
    return df.join(F.broadcast(total)).select("token", "df", F.round(F.log(1 + F.col("n") / F.col("df")) / F.log(1 + F.col("n")), 9).alias("idf"))  # total is one row


# resolution

_KEYED = f"keyed AS {star.keys_sql('records', 'name', 'type', True)}"
_PAIRS = "pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keyed x JOIN keyed y USING (key) WHERE x.id < y.id)"
_SCORED = f"""scored AS (
  SELECT a, b, round(0.7 * {star.jaccard_sql("x.g", "y.g")} + 0.2 * CASE WHEN x.type = y.type THEN 1 ELSE 0 END + 0.1 * CASE WHEN x.brand = y.brand THEN 1 ELSE 0 END, 12) AS score
  FROM pairs JOIN (SELECT *, {star.grams_sql("name")} AS g FROM records) x ON x.id = a JOIN (SELECT *, {star.grams_sql("name")} AS g FROM records) y ON y.id = b)"""


@query(_with(star.NAMES, _KEYED, _PAIRS) + " SELECT a, b FROM pairs")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block(star.names(spark, sf_dir), True, True)


@query(_with(star.NAMES, _KEYED, _PAIRS) + " SELECT (SELECT count(*) FROM records) AS records, (SELECT count(*) * (count(*) - 1) // 2 FROM records) AS all_pairs, (SELECT count(DISTINCT key) FROM keyed) AS blocks, (SELECT count(*) FROM pairs) AS compared")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block_stats(star.names(spark, sf_dir), True, True)


@query(f"SELECT s_suppkey AS key, {star.sound_sql('w')} AS sound FROM (SELECT s_suppkey, unnest(string_split(lower(n_name), ' ')) AS w FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = star.table(spark, sf_dir, "supplier"), star.table(spark, sf_dir, "nation")
    words = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("key"), F.explode(F.split(F.lower("n_name"), " ")).alias("w"))
    return words.select("key", phonetic(F.col("w")).alias("sound"))


@query("SELECT s_suppkey AS key, array_to_string(list_filter(string_split(trim(regexp_replace(lower(s_name), '[_\\-/.\\s]+', ' ', 'g')), ' '), lambda t: length(t) >= 3), ' ') AS tokens FROM supplier")
def blocking_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.array_join(name_tokens(F.col("s_name")), " ").alias("tokens"))


@query(_with(star.NAMES, _KEYED, _PAIRS, _SCORED) + " SELECT a, b, round(score, 9) AS score FROM scored")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.names(spark, sf_dir)
    return resolve.score_pairs(resolve.block(r, True, True), r).select("a", "b", F.round("score", 9).alias("score"))


@query(
    _with(star.NAMES, _KEYED, _PAIRS, _SCORED, "ends AS (SELECT a AS e, * FROM scored UNION ALL SELECT b, * FROM scored)", "ranked AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, a || ' ' || b) AS r FROM ends)")
    + " SELECT DISTINCT a, b FROM ranked WHERE r <= 3"
)
def cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.names(spark, sf_dir)
    return resolve.cap_by_similarity(resolve.score_pairs(resolve.block(r, True, True), r), 3).select("a", "b")


@query(_with(star.NAMES, _KEYED, _PAIRS) + " SELECT a, b FROM pairs")
def cap_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap of 0 keeps every pair."""
    r = star.names(spark, sf_dir)
    return resolve.cap_by_similarity(resolve.score_pairs(resolve.block(r, True, True), r), 0).select("a", "b")


_WEAK = """strong AS (SELECT *, row_number() OVER (ORDER BY score DESC, a || ' ' || b) AS o FROM scored WHERE score >= {least}),
sides AS (SELECT o, a AS x, b AS y FROM strong UNION ALL SELECT o, b, a FROM strong),
before AS (SELECT o AS e, a AS at FROM strong UNION SELECT r.e, s.y FROM before r JOIN sides s ON s.x = r.at AND s.o < r.e),
forest AS (SELECT s.* FROM strong s WHERE NOT EXISTS (SELECT 1 FROM before r WHERE r.e = s.o AND r.at = s.b)),
weak AS (SELECT cluster, a AS weak_a, b AS weak_b, round(score, 9) AS weak_score FROM (SELECT r.cluster, f.*, row_number() OVER (PARTITION BY r.cluster ORDER BY f.score, f.a || ' ' || f.b) AS n FROM forest f JOIN roots r ON r.id = f.a) WHERE n = 1)"""
_CLUSTERED = " SELECT cluster, count(*) AS size, count(*) - 1 AS merges, any_value(weak_a) AS weak_a, any_value(weak_b) AS weak_b, any_value(weak_score) AS weak_score FROM roots LEFT JOIN weak USING (cluster) GROUP BY cluster"
_REACH = """links AS (SELECT a AS x, b AS y FROM scored WHERE score >= 0.75 UNION ALL SELECT b, a FROM scored WHERE score >= 0.75),
reach AS (SELECT id, id AS root FROM records UNION SELECT r.id, l.y FROM reach r JOIN links l ON l.x = r.root),
roots AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id)"""


@query("WITH RECURSIVE " + ",\n".join([star.NAMES, _KEYED, _PAIRS, _SCORED, _REACH]) + " SELECT id, cluster FROM roots")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.names(spark, sf_dir)
    return resolve.cluster(r, resolve.score_pairs(resolve.block(r, True, True), r), 0.75)[0]


@query("WITH RECURSIVE " + ",\n".join([star.NAMES, _KEYED, _PAIRS, _SCORED, _REACH, _WEAK.replace("{least}", "0.75")]) + _CLUSTERED)
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.names(spark, sf_dir)
    return resolve.cluster(r, resolve.score_pairs(resolve.block(r, True, True), r), 0.75)[1].withColumn("weak_score", F.round("weak_score", 9))


@query(
    "WITH RECURSIVE " + ",\n".join([star.NAMES, _KEYED, _PAIRS, _SCORED, _REACH.replace("0.75", "0.7"), _WEAK.replace("{least}", "0.7")]) + f" SELECT * FROM ({_CLUSTERED}) WHERE size > 1"
)
def suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.suggest(star.names(spark, sf_dir))[1].withColumn("weak_score", F.round("weak_score", 9))


@query(
    _with(star.NAMES, _KEYED, _PAIRS, "truth AS (SELECT x.id AS a, y.id AS b FROM records x JOIN records y ON x.name = y.name AND x.id < y.id)", "n AS (SELECT (SELECT count(*) FROM pairs) AS p, (SELECT count(*) FROM pairs JOIN truth USING (a, b)) AS k, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM records) AS r)")
    + " SELECT p AS pairs, k AS kept, t AS true, round(k / t::DOUBLE, 6) AS completeness, round(k / p::DOUBLE, 6) AS quality, round(1 - p / (r * (r - 1) / 2)::DOUBLE, 6) AS reduction, round(2 * k / (t + p)::DOUBLE, 6) AS f_measure FROM n"
)
def blocking_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star.names(spark, sf_dir)
    x, y = r.select(F.col("id").alias("a"), "name"), r.select(F.col("id").alias("b"), "name")
    q = evaluate.blocking_quality(resolve.block(r, True, True), x.join(y, "name").where("a < b").select("a", "b"), r.count())
    return q.select("pairs", "kept", "true", *[F.round(c, 6).alias(c) for c in ("completeness", "quality", "reduction", "f_measure")])


# resolution over every part: classes of equal records and their members, without SQL twins


@query()
def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.membership(spark, sf_dir)


@query()
def block_pairs_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block(parts.classes(spark, sf_dir), True, True)


@query()
def block_stats_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = parts.classes(spark, sf_dir)
    blocks = resolve.keyed(r, True, True).agg(F.countDistinct("key").alias("blocks"))
    return parts.counted(r).join(F.broadcast(blocks)).select("records", "all_pairs", "blocks", "compared")  # one row each


@query()
def trigram_similarity_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.scored(parts.classes(spark, sf_dir)).select("a", "b", F.round("score", 9).alias("score"))


@query()
def cap_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.capped(parts.classes(spark, sf_dir), parts.membership(spark, sf_dir), 3)


@query()
def clusters_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.clustered(parts.classes(spark, sf_dir), parts.membership(spark, sf_dir), 0.75)[0]


@query()
def cluster_sizes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.clustered(parts.classes(spark, sf_dir), parts.membership(spark, sf_dir), 0.75)[1].select("cluster", "size", "merges")


@query()
def suggest_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.suggested(parts.classes(spark, sf_dir), parts.membership(spark, sf_dir))


@query()
def blocking_eval_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parts.counted(parts.classes(spark, sf_dir))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return c.select(F.col("compared").alias("pairs"), "kept", "true", rate("kept", "true").alias("completeness"), rate("kept", "compared").alias("quality"), (1 - rate("compared", "all_pairs")).alias("reduction"), rate(2 * F.col("kept"), F.col("true") + F.col("compared")).alias("f_measure"))


# identity: suppliers of one nation are one merge each

_MERGES = "merges AS (SELECT 'm:' || s_nationkey AS id, s_nationkey::BIGINT AS seq, list('s:' || s_suppkey ORDER BY 's:' || s_suppkey) AS members, min('s:' || s_suppkey) AS canonical FROM supplier GROUP BY s_nationkey HAVING s_nationkey % 5 <> 0)"


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of nations whose key is a multiple of 5 have been retracted."""
    s = star.table(spark, sf_dir, "supplier").withColumn("sid", F.concat(F.lit("s:"), "s_suppkey"))
    none = F.lit(None).cast("timestamp")
    rows = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("sid")).alias("members"), F.min("sid").alias("canonical"))
    rows = rows.select(F.concat(F.lit("m:"), "s_nationkey").alias("id"), F.col("s_nationkey").cast("long").alias("seq"), "members", "canonical", none.alias("valid_from"), none.alias("valid_until"))
    closed = rows.where("seq % 5 = 0").select(F.col("id").alias("subject"), F.lit("2020-01-01").cast("timestamp").alias("at"))
    return identity.active_merges(rows, closed, F.lit("2024-01-01").cast("timestamp"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star.table(spark, sf_dir, "supplier")
    pairs = F.explode(F.create_map(F.lit("name"), "s_name", F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("rich"), (F.col("s_acctbal") > 5000).cast("string")))
    return s.select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), pairs.alias("field", "value"))


_FIELDS = "fields AS (SELECT 's:' || s_suppkey AS id, u.field, u.value FROM supplier, LATERAL (VALUES ('name', s_name), ('nation', s_nationkey::VARCHAR), ('rich', (s_acctbal > 5000)::VARCHAR)) u(field, value))"


@query(_with(_MERGES) + " SELECT id, canonical, len(members)::INT AS n FROM merges")
def active_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merges(spark, sf_dir).select("id", "canonical", F.size("members").alias("n"))


@query(_with(_MERGES) + " SELECT 's:' || s_suppkey AS requested, coalesce(m.canonical, 's:' || s_suppkey) AS canonical, CASE WHEN m.canonical <> 's:' || s_suppkey THEN m.id END AS via FROM supplier LEFT JOIN merges m ON list_contains(m.members, 's:' || s_suppkey)")
def resolve_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = star.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"))
    return identity.resolve_ids(ids, _merges(spark, sf_dir))


@query(_with(_MERGES, _FIELDS) + " SELECT canonical, field, value FROM (SELECT canonical, field, value, row_number() OVER (PARTITION BY canonical, field ORDER BY CASE WHEN f.id = canonical THEN '' ELSE f.id END) AS r FROM merges m JOIN fields f ON list_contains(m.members, f.id)) WHERE r = 1")
def merged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    return identity.merged_view(_merges(spark, sf_dir), f, f.select("id").distinct())[0]


@query(_with(_MERGES, _FIELDS) + " SELECT canonical, field, count(*)::INT AS holders FROM merges m JOIN fields f ON list_contains(m.members, f.id) GROUP BY canonical, field HAVING count(DISTINCT value) > 1")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    return identity.merged_view(_merges(spark, sf_dir), f, f.select("id").distinct())[1].select("canonical", "field", F.size("holders").alias("holders"))


@query(_with(_MERGES) + " SELECT canonical, u.m AS member FROM merges, unnest(members) u(m) WHERE substr(u.m, 3)::BIGINT % 2 = 1")
def merge_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    return identity.merged_view(_merges(spark, sf_dir), f, f.where("cast(substring(id, 3) as bigint) % 2 = 0").select("id").distinct())[2]


# extraction: one sentence per part, by six templates

_SENTENCES = """CASE p_partkey % 6 WHEN 0 THEN 'the ' || p_brand || ' fault caused the outage' WHEN 1 THEN 'we doubt it, yet the ' || p_brand || ' review led to the rewrite'
  WHEN 2 THEN 'it is unclear whether ' || p_brand || ' caused the spike' WHEN 3 THEN 'no one disputes that the ' || p_brand || ' spike influenced the policy'
  WHEN 4 THEN 'the ' || p_brand || ' decision set a precedent for the contract' ELSE p_brand || ' never resulted in a failure' END"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.expr(_SENTENCES).alias("text"))


_SAID = f"said AS (SELECT 'p:' || p_partkey AS source, p_partkey % 6 AS k, replace(p_brand, '#', '') AS b, p_brand, {_SENTENCES} AS text FROM part)"


@query(
    _with(_SAID)
    + """ SELECT source, CASE k WHEN 0 THEN 'CAUSED' WHEN 1 THEN 'CAUSED' WHEN 3 THEN 'INFLUENCED' ELSE 'PRECEDENT_FOR' END AS predicate,
  substr(text, strpos(text, '#') + 1, strpos(substr(text, strpos(text, '#')), v.verb) - 3) AS subject, substr(text, strpos(text, v.verb) + length(v.verb) + 1) AS object
FROM said JOIN (VALUES (0, 'caused'), (1, 'led to'), (3, 'influenced'), (4, 'set a precedent for')) v(k, verb) USING (k)"""
)
def extract_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = extract.relations(_sentences(spark, sf_dir))
    return found.select("source", "predicate", F.col("subject_text").alias("subject"), F.col("object_text").alias("object"))


@query(_with(_SAID) + " SELECT source, CASE k WHEN 2 THEN 'unclear' ELSE 'never' END AS cue, CASE k WHEN 2 THEN 'CAUSED' ELSE 'CAUSED' END AS predicate FROM said WHERE k IN (2, 5)")
def extract_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, suppressed = extract.relations(_sentences(spark, sf_dir))
    return suppressed.select("source", "cue", "predicate")


_GOLD = """CASE WHEN k = 0 THEN 'CAUSED' WHEN k = 1 THEN CASE WHEN n % 5 = 0 THEN 'INFLUENCED' ELSE 'CAUSED' END WHEN k = 3 THEN 'INFLUENCED' WHEN k = 4 AND n % 5 > 0 THEN 'PRECEDENT_FOR' WHEN k = 2 AND n % 5 = 0 THEN 'CAUSED' END"""
_GOLD_ENDS = """{brand} || CASE k WHEN 0 THEN ' fault' WHEN 1 THEN ' review' WHEN 3 THEN ' spike' WHEN 4 THEN ' decision' ELSE '' END AS subject,
  CASE k WHEN 0 THEN 'the outage' WHEN 1 THEN 'the rewrite' WHEN 2 THEN 'the spike' WHEN 3 THEN 'the policy' ELSE 'the contract' END AS object"""
_EVAL = f"""golden AS (SELECT * FROM (SELECT source AS id, k, {_GOLD} AS predicate, {_GOLD_ENDS.replace("{brand}", "substr(p_brand, strpos(p_brand, '#') + 1)")} FROM (SELECT *, substr(source, 3)::BIGINT AS n FROM said)) WHERE predicate IS NOT NULL),
emitted AS (SELECT source AS id, CASE k WHEN 0 THEN 'CAUSED' WHEN 1 THEN 'CAUSED' WHEN 3 THEN 'INFLUENCED' ELSE 'PRECEDENT_FOR' END AS predicate,
  substr(text, strpos(text, '#') + 1, strpos(substr(text, strpos(text, '#')), v.verb) - 3) AS subject, substr(text, strpos(text, v.verb) + length(v.verb) + 1) AS object
  FROM said JOIN (VALUES (0, 'caused'), (1, 'led to'), (3, 'influenced'), (4, 'set a precedent for')) v(k, verb) USING (k)),
each AS (SELECT s.source, s.k, (SELECT count(*) FROM golden g WHERE g.id = s.source) AS g, (SELECT count(*) FROM emitted e WHERE e.id = s.source) AS f,
  (SELECT count(*) FROM golden g JOIN emitted e USING (id, predicate, subject, object) WHERE g.id = s.source) AS h FROM said s),
sums AS (SELECT {{by}} sum(h)::BIGINT AS hits, sum(f)::BIGINT AS found, sum(g)::BIGINT AS gold, count(*) FILTER (WHERE g = 0) AS silent, count(*) FILTER (WHERE g = 0 AND f = 0) AS kept_silent FROM each {{group}}),
rates AS (SELECT *, CASE WHEN found > 0 THEN hits / found::DOUBLE ELSE 0 END AS p, CASE WHEN gold > 0 THEN hits / gold::DOUBLE ELSE 0 END AS r, CASE WHEN silent > 0 THEN kept_silent / silent::DOUBLE ELSE 0 END AS q FROM sums)"""
_EVAL_OUT = "hits, found, gold, silent, kept_silent, round(p, 6) AS precision, round(r, 6) AS recall, round(q, 6) AS silence_rate, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM rates"


def _extract_quality(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    """Labels are stated by template and part number, and differ from what the rules say for every fifth part of some."""
    texts = _sentences(spark, sf_dir).withColumn("family", F.expr("cast(substring(id, 3) as bigint) % 6"))
    found, _ = extract.relations(texts.select("id", "text"))
    rows = found.select(F.col("source").alias("id"), "predicate", F.col("subject_text").alias("subject"), F.col("object_text").alias("object"))
    parts_ = star.table(spark, sf_dir, "part").selectExpr("'p:' || p_partkey AS id", "p_partkey AS n", "p_partkey % 6 AS k", "substring_index(p_brand, '#', -1) AS brand")
    ends = [e.strip() for e in _GOLD_ENDS.replace("{brand}", "brand").split(",\n")]
    gold = parts_.selectExpr("id", f"{_GOLD} AS predicate", *ends).where("predicate is not null")
    out = evaluate.extraction_quality(gold, rows, texts, by)
    return out.select(*([by] if by else []), "hits", "found", "gold", "silent", "kept_silent", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "silence_rate", "f1")])


@query(_with(_SAID, _EVAL.replace("{by}", "").replace("{group}", "")) + " SELECT " + _EVAL_OUT)
def extract_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract_quality(spark, sf_dir, None)


@query(_with(_SAID, _EVAL.replace("{by}", "k AS family,").replace("{group}", "GROUP BY k")) + " SELECT family, " + _EVAL_OUT)
def extract_eval_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract_quality(spark, sf_dir, "family")


# linking: mentions of nations among regions and nations

_WORDS = ("report", "team", "outage", "map")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = star.table(spark, sf_dir, "nation")
    word = F.get(F.array(*map(F.lit, _WORDS)), F.col("n_nationkey") % 4)
    return n.select(F.concat(F.lit("m"), "n_nationkey").alias("mention_id"), F.concat(F.lit("the "), F.lower("n_name"), F.lit(" "), word).alias("mention"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = star.table(spark, sf_dir, "nation"), star.table(spark, sf_dir, "region")
    word = F.get(F.array(*map(F.lit, _WORDS)), F.col("n_nationkey") % 2)
    rows = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lower("n_name"), F.lit(" "), word).alias("name"))
    return rows.unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lower("r_name").alias("name"))).withColumn("type", F.lit("node"))


_LINK = f"""mentions AS (SELECT 'm' || n_nationkey AS id, 'the ' || lower(n_name) || ' ' || ['report', 'team', 'outage', 'map'][n_nationkey % 4 + 1] AS name, CASE WHEN n_nationkey % 4 < 3 THEN ['report', 'team', 'outage'][n_nationkey % 4 + 1] END AS mtype FROM nation),
places AS (SELECT 'n' || n_nationkey AS id, lower(n_name) || ' ' || ['report', 'team'][n_nationkey % 2 + 1] AS name, ['report', 'team'][n_nationkey % 2 + 1] AS rtype FROM nation UNION ALL SELECT 'r' || r_regionkey, lower(r_name), 'node' FROM region),
mk AS {star.keys_sql("mentions", "name", None, True)}, pk AS {star.keys_sql("places", "name", None, True)},
cands AS (SELECT DISTINCT mk.id AS m, pk.id AS p FROM mk JOIN pk USING (key)),
ranked AS (
  SELECT c.m AS mention_id, x.name AS mention, c.p AS id, y.name, x.mtype, round(0.7 * {star.jaccard_sql("x.g", "y.g")} + 0.2 * CASE WHEN x.mtype = y.rtype THEN 1 ELSE 0 END, 12) AS score
  FROM cands c JOIN (SELECT *, {star.grams_sql("name")} AS g FROM mentions) x ON x.id = c.m JOIN (SELECT *, {star.grams_sql("name")} AS g FROM places) y ON y.id = c.p),
numbered AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS rank, lead(score) OVER (PARTITION BY mention_id ORDER BY score DESC, id) AS next FROM ranked)"""


@query(_with(_LINK) + " SELECT mention_id, id, round(score, 9) AS score, rank FROM numbered")
def link_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.link(_mentions(spark, sf_dir), _places(spark, sf_dir))[0].select("mention_id", "id", F.round("score", 9).alias("score"), "rank")


@query(
    _with(_LINK)
    + """ SELECT m.id AS mention_id, t.id, round(t.score - t.next, 9) AS margin, CASE WHEN t.id IS NULL THEN 'no_candidates' WHEN round(t.score - t.next, 12) = 0 THEN 'tie' WHEN coalesce(t.score - t.next, 1) < 0.1 THEN 'weak'
  WHEN m.mtype IS NOT NULL AND len(list_intersect(string_split(m.name, ' '), string_split(t.name, ' '))) = 1 AND list_intersect(string_split(m.name, ' '), string_split(t.name, ' '))[1] = m.mtype THEN 'weak' ELSE 'ranked' END AS verdict
FROM mentions m LEFT JOIN numbered t ON t.mention_id = m.id AND t.rank = 1"""
)
def link_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.link(_mentions(spark, sf_dir), _places(spark, sf_dir))[1].select("mention_id", "id", F.round("margin", 9).alias("margin"), "verdict")


_LINK_JUDGED = """top AS (
  SELECT m.id AS mention_id, CASE WHEN substr(m.id, 2)::INT % 4 < 3 THEN 'n' || substr(m.id, 2) END AS gold, substr(m.id, 2)::INT % 4 AS family, t.id, t.score, round(t.score - t.next, 12) AS margin,
    m.mtype IS NOT NULL AND len(list_intersect(string_split(m.name, ' '), string_split(t.name, ' '))) = 1 AND list_intersect(string_split(m.name, ' '), string_split(t.name, ' '))[1] = m.mtype AS type_only,
    (SELECT min(r.rank) FROM numbered r WHERE r.mention_id = m.id AND r.id = 'n' || substr(m.id, 2)) AS place
  FROM mentions m LEFT JOIN numbered t ON t.mention_id = m.id AND t.rank = 1),
judged AS (
  SELECT *, gold IS NOT NULL AS real, gold IS NOT NULL AND coalesce(place, 0) = 1 AS right_,
    CASE WHEN id IS NULL THEN 'no_candidates' WHEN margin = 0 THEN 'tie' WHEN coalesce(margin, 1) < 0.1 THEN 'weak' WHEN coalesce(type_only, false) THEN 'weak' ELSE 'ranked' END AS verdict FROM top)"""
_LINK_RATES = """count(*) AS n, count(*) FILTER (WHERE real) AS in_store, round(count(*) FILTER (WHERE real AND place IS NOT NULL) / nullif(count(*) FILTER (WHERE real), 0)::DOUBLE, 6) AS recall_any,
  round(count(*) FILTER (WHERE real AND place <= 3) / nullif(count(*) FILTER (WHERE real), 0)::DOUBLE, 6) AS recall_k, round(count(*) FILTER (WHERE right_) / nullif(count(*) FILTER (WHERE real), 0)::DOUBLE, 6) AS top1,
  round(count(*) FILTER (WHERE NOT real AND verdict IN ('no_candidates', 'weak')) / nullif(count(*) FILTER (WHERE NOT real), 0)::DOUBLE, 6) AS nil_flagged, count(*) FILTER (WHERE right_ AND verdict = 'weak') AS soft_cost,
  round(quantile_cont(margin, 0.5) FILTER (WHERE right_), 6) AS margin_right, round(quantile_cont(margin, 0.5) FILTER (WHERE real AND NOT right_ AND id IS NOT NULL), 6) AS margin_wrong,
  round(quantile_cont(margin, 0.5) FILTER (WHERE right_) - quantile_cont(margin, 0.5) FILTER (WHERE real AND NOT right_ AND id IS NOT NULL), 6) AS separation FROM judged"""


def _link_gold(mentions: DataFrame) -> DataFrame:
    family = F.expr("cast(substring(mention_id, 2) as int) % 4")
    return mentions.select("mention_id", F.when(family < 3, F.concat(F.lit("n"), F.substring("mention_id", 2, 9))).alias("gold"), family.alias("family"))


def _link_quality(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    mentions = _mentions(spark, sf_dir)
    ranked, verdicts = link.link(mentions, _places(spark, sf_dir))
    out = evaluate.linking_quality(verdicts, ranked, _link_gold(mentions), 3, by)
    rates = ("recall_any", "recall_k", "top1", "nil_flagged", "margin_right", "margin_wrong", "separation")
    return out.select(*([by] if by else []), "n", "in_store", "soft_cost", *[F.round(c, 6).alias(c) for c in rates])


@query(_with(_LINK, _LINK_JUDGED) + " SELECT " + _LINK_RATES)
def link_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_quality(spark, sf_dir, None)


@query(_with(_LINK, _LINK_JUDGED) + " SELECT family, " + _LINK_RATES + " GROUP BY family")
def link_eval_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _link_quality(spark, sf_dir, "family")


_NIL_RULES = {"none": "false", "score < 0.30": "score < 0.3", "score < 0.50": "score < 0.5", "margin < 0.05": "coalesce(margin, 1) < 0.05", "margin < 0.10": "coalesce(margin, 1) < 0.1", "margin < 0.10 or type only": "coalesce(margin, 1) < 0.1 or coalesce(type_only, false)"}


@query(
    _with(_LINK, _LINK_JUDGED)
    + " SELECT *, kept + nil_rejected AS total FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE right_ AND NOT d) AS kept, count(*) FILTER (WHERE NOT real AND d) AS nil_rejected, count(*) FILTER (WHERE NOT real AND (id IS NULL OR d)) AS nil_flagged, count(*) FILTER (WHERE right_) AS top1, count(*) FILTER (WHERE right_ AND d) AS soft FROM (SELECT *, coalesce({rule}, false) AS d FROM judged)"
        for name, rule in _NIL_RULES.items()
    )
    + ")"
)
def link_nil_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _mentions(spark, sf_dir)
    _, verdicts = link.link(mentions, _places(spark, sf_dir))
    return evaluate.nil_rules(verdicts, _link_gold(mentions).drop("family"), {name: F.expr(rule) for name, rule in _NIL_RULES.items()})


@query("SELECT p_partkey AS key, CASE p_partkey % 6 WHEN 0 THEN 'outage' WHEN 1 THEN 'rewrite' WHEN 2 THEN 'spike' WHEN 3 THEN 'policy' WHEN 4 THEN 'contract' ELSE 'failure' END AS type FROM part")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select(F.substring("id", 3, 20).cast("long").alias("key"), infer_type(F.col("text")).alias("type"))


@query("SELECT n_nationkey AS key, array_to_string(list_filter(list_transform(regexp_split_to_array('see ' || n_name || ', a B2 and Slo', '\\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: regexp_full_match(w, '[A-Z0-9]{2,}') AND regexp_matches(w, '[A-Z]')), ' ') AS found FROM nation")
def acronyms_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("see "), "n_name", F.lit(", a B2 and Slo"))
    return star.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.array_join(acronyms(text), " ").alias("found"))


# evidence

_SPANS = "CASE k WHEN 4 THEN 0.5 WHEN 5 THEN 5 WHEN 7 THEN -1 WHEN 8 THEN 2 ELSE 0 END"
_SPAN_ENDS = "CASE k WHEN 5 THEN 2 WHEN 6 THEN 9999 WHEN 8 THEN 2 ELSE 4 END"


@query(
    _with(_SAID)
    + """ SELECT source AS id, CASE n WHEN 0 THEN substr(text, 1, 4) WHEN 8 THEN '' END AS quote,
  CASE n WHEN 1 THEN 'source_not_found' WHEN 2 THEN 'source_purged' WHEN 3 THEN 'source_has_no_text' WHEN 4 THEN 'span_not_integral' WHEN 5 THEN 'span_inverted' WHEN 6 THEN 'span_out_of_bounds' WHEN 7 THEN 'span_out_of_bounds' END AS reason
FROM (SELECT *, substr(source, 3)::BIGINT % 9 AS n FROM said)"""
)
def span_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of each part's sentence, sound or wrong in one of seven ways."""
    rows = _sentences(spark, sf_dir).withColumn("k", F.expr("cast(substring(id, 3) as bigint) % 9"))
    spans = rows.selectExpr("id", "IF(k = 1, 'nowhere:' || id, id) AS source", f"cast({_SPANS} as double) AS start", f"cast({_SPAN_ENDS} as double) AS end")
    sources = rows.select("id", F.when(~F.col("k").isin(2, 3), F.col("text")).alias("text"), (F.col("k") == 2).alias("purged"))
    return extract.resolve_spans(spans, sources).select("id", "quote", "reason")


@query("SELECT key, quote FROM (VALUES (1, '👍'), (2, ' d'), (3, 'e\u0301')) v(key, quote)".replace("\\u0301", "\u0301"))
def span_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets count UTF-16 units: signs beyond the basic plane are two."""
    spans = spark.createDataFrame([(1, "a", 4.0, 6.0), (2, "a", 6.0, 8.0), (3, "a", 11.0, 13.0)], "key int, source string, start double, end double")
    sources = spark.createDataFrame([("a", "the 👍 deple\u0301y", False)], "id string, text string, purged boolean")
    return extract.resolve_spans(spans, sources).select("key", "quote")


@query(_with(_SAID) + " SELECT source, substr(text, strpos(text, '#') + 1) AS quote FROM said WHERE k IN (0, 1, 3, 4)")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every asserted relation rests on, read back through its span."""
    texts = _sentences(spark, sf_dir)
    found, _ = extract.relations(texts)
    spans = found.select("source", F.col("trigger.start").cast("double").alias("start"), F.col("trigger.end").cast("double").alias("end"))
    return extract.resolve_spans(spans, texts.withColumn("purged", F.lit(False))).select("source", "quote")


# views and streams


@query(_with(star.NODES, star.EDGES) + " SELECT n.id, n.kind, CASE WHEN any_value(o.o_orderstatus) = 'P' THEN '(purged)' WHEN n.kind = 'node' THEN n.id || ' title' ELSE n.id END AS label, coalesce(any_value(o.o_orderstatus) = 'P', false) AS purged, count(e.id) AS n_edges FROM nodes n LEFT JOIN (SELECT id, source AS end_id FROM edges UNION ALL SELECT id, target FROM edges) e ON e.end_id = n.id LEFT JOIN orders o ON n.id = 'o:' || o.o_orderkey GROUP BY n.id, n.kind")
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a name are shown by their id, those of status P as erased."""
    status = star.table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.col("o_orderstatus"))
    content = F.when(F.col("kind") == "node", F.concat(F.lit('{"name":" ","title":"'), "id", F.lit(' title"}'))).otherwise(F.lit('{"name":7}'))
    nodes = star.nodes(spark, sf_dir).join(status, "id", "left").select("id", "kind", content.alias("content"), F.coalesce(F.col("o_orderstatus") == "P", F.lit(False)).alias("purged"))
    edges = star.edges(spark, sf_dir).select("id", "source", "target", "type", "weight", F.lit(False).alias("has_evidence"))
    return views.graph(nodes, edges)[0]


@query(_with(star.EVENT_LOG) + " SELECT workspace, seq, id FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY seq DESC) AS r FROM log) WHERE r <= 3")
def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.newest(star.event_log(spark, sf_dir), 3).select("workspace", "seq", "id")


@query(_with(star.EVENT_LOG) + " SELECT id, content AS text FROM log WHERE event_type NOT IN ('error', 'signup', 'view')")
def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are erased, sign-ups are retractions, views are retrieval rows."""
    log = star.event_log(spark, sf_dir)
    log = chain.purge_content(log, log.where("event_type = 'error'").select("id"))
    kind = F.when(F.col("event_type") == "signup", "retraction").when(F.col("event_type") == "view", "retrieval").otherwise(F.col("kind"))
    return views.searchable(log.withColumn("kind", kind))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tail.windowed_counts(star.table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream through a watermarked window aggregation to a file sink, summed up."""
    events = star.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    rows = tail.run_to_end(stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "40 days"), "event_type").agg(F.count("*").alias("n")), "complete")
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
