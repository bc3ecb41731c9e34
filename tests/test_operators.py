import itertools
import random

import pytest
from pyspark.sql import functions as F

from veritrail.errors import CODES, EngineError
from veritrail.operators import causal, chain, evaluate, extract, identity, link, resolve, retrieval, temporal


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def log_of(spark, n=4, workspace="w"):
    rows = [(workspace, i, "node", f"n{i}", f'{{"x":{i}}}', '{"recordedAt":"2024-01-01"}', f"s{i}") for i in range(n)]
    return chain.fold(frame(spark, rows, "workspace string, pos long, kind string, id string, content string, meta string, salt string")).withColumn("pos", F.col("seq"))


def problems(df):
    return sorted((r["id"], r["reason"]) for r in chain.verify(df).collect())


def test_chain_detects_what_it_claims(spark):
    log = log_of(spark).cache()
    assert problems(log) == [] and chain.chain_report(log).first()["valid"]
    edited = log.withColumn("content", F.when(F.col("id") == "n1", '{"x":9}').otherwise(F.col("content")))
    assert problems(edited) == [("n1", "content_tampered")]
    assert problems(log.where("id <> 'n1'")) == [("n2", "chain_break"), ("n2", "sequence_gap")]
    swapped = log.withColumn("pos", F.when(F.col("id") == "n1", 3).when(F.col("id") == "n2", 2).otherwise(F.col("pos")))
    assert ("n2", "chain_break") in problems(swapped)
    half = log.withColumn("salt", F.when(F.col("id") != "n0", F.col("salt")))
    assert problems(half) == [("n0", "content_tampered")]
    gone = chain.purge_content(log, ["n2"])
    assert problems(gone) == [] and chain.chain_report(gone).first()["purged"] == 1
    assert problems(log.withColumn("meta", F.when(F.col("id") == "n3", "{}").otherwise(F.col("meta")))) == [("n3", "digest_mismatch")]
    assert problems(log.where("seq <= 2")) == []  # truncation is not detectable
    two = log.unionByName(log_of(spark, 3, "v"))
    assert problems(two) == [] and chain.chain_report(two).count() == 2


def test_snapshot_has_no_dangling_edge(spark):
    rng = random.Random(1)
    day = lambda: f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" if rng.random() > 0.2 else None
    nodes = [(f"n{i}", day(), day(), day() or "2024-01-01") for i in range(60)]
    edges = [(f"e{i}", day(), day(), day() or "2024-01-01", f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for i in range(300)]
    n, e = frame(spark, nodes, "id string, valid_from string, valid_until string, recorded_at string"), frame(spark, edges, "id string, valid_from string, valid_until string, recorded_at string, source string, target string")
    at, seen = "2024-06-15", "2024-05-01"
    got = temporal.state_at(n, e, at, seen, raw=True)

    def ok(r):
        f, u, rec = r[1:4]
        return (f is None or u is None or f <= u) and rec <= seen and (f is None or f <= at) and (u is None or at <= u)

    live = {r[0] for r in nodes if ok(r)}
    assert {r["id"] for r in got.nodes.collect()} == live
    assert {r["id"] for r in got.edges.collect()} == {r[0] for r in edges if ok(r) and r[4] in live and r[5] in live}
    inverted = {r[0] for r in [*nodes, *edges] if r[1] and r[2] and r[1] > r[2]}
    assert {r["id"] for r in got.rejected.collect()} == inverted
    with pytest.raises(EngineError, match="ambiguous_timezone"):
        temporal.state_at(n, e, "2024-01-01T00:00:00")


def test_retractions_narrow_and_cascade(spark):
    ts = lambda c: F.to_timestamp(c)
    recs = frame(spark, [("a", None), ("b", "2024-01-10"), ("c", None)], "id string, u string").select("id", ts("u").alias("valid_until"))
    gone = frame(spark, [("a", "2024-02-01", "2024-06-01"), ("a", "2024-01-20", "2024-01-21"), ("b", "2024-03-01", "2024-01-01")], "subject string, a string, r string").select("subject", ts("a").alias("at"), ts("r").alias("recorded_at"))
    day = lambda **k: {r["id"]: r["d"] for r in temporal.effective_until(recs, gone, **k).select("id", F.date_format("effective_until", "MM-dd").alias("d")).collect()}
    assert day() == {"a": "01-20", "b": "01-10", "c": None}
    assert day(as_of="2024-01-01") == {"a": None, "b": "01-10", "c": None} and day(as_of="2024-01-01", compat=True)["a"] == "01-20"
    edges = frame(spark, [("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "a")], "id string, source string, target string")
    already = frame(spark, [("e3",)], "id string")
    assert [r["id"] for r in temporal.retract_cascade("a", edges, already).collect()] == ["e1"]
    assert [tuple(r) for r in temporal.retract_cascade_many(frame(spark, [("a",)], "id string"), edges, already).collect()] == [("e1", "a")]


def dfs(edges, start, depth, near, far):
    out = []

    def walk(at, nodes, hops):
        onward = [e for e in edges if e[near] == at and e[far] not in nodes] if len(hops) < depth else []
        if not onward and hops:
            out.append(tuple(e[0] for e in hops))
        for e in onward:
            walk(e[far], [*nodes, e[far]], [*hops, e])

    walk(start, [start], [])
    return sorted(out)


def test_chains_equal_a_depth_first_search(spark):
    rng = random.Random(2)
    edges = [(f"e{i}", f"n{rng.randrange(6)}", f"n{rng.randrange(6)}", "CAUSED", rng.random()) for i in range(18)]
    df = frame(spark, edges, "id string, source string, target string, type string, weight double")
    starts = frame(spark, [("n0",), ("n3",), ("ghost",)], "start string")
    for direction, near, far in (("upstream", 2, 1), ("downstream", 1, 2)):
        rows = causal.report(causal.find_chains(df, starts, direction, 4)).collect()
        for start in ("n0", "n3", "ghost"):
            assert sorted(tuple(h["id"] for h in r["hops"]) for r in rows if r["start"] == start) == dfs(edges, start, 4, near, far)
        for r in rows:
            assert r["product_confidence"] <= r["weakest_confidence"] + 1e-12 and r["weakest_link"]["weight"] == min(h["weight"] for h in r["hops"])
    for depth in (0, 21):
        with pytest.raises(EngineError, match="invalid_max_depth"):
            causal.find_chains(df, starts, max_depth=depth)


def test_edges_are_checked(spark):
    rows = [("a", "x", "y", "CAUSED", 0.0), ("b", "x", "y", "caused", 0.5), ("c", "x", "y", "INFLUENCED", 1.1), ("d", None, "y", "CAUSED", 1.0), ("e", "x", "y", "CAUSED", float("nan"))]
    sound, bad = causal.check_edges(frame(spark, rows, "id string, source string, target string, type string, weight double"))
    assert [r["id"] for r in sound.collect()] == ["a"]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {"b": "unknown_edge_type", "c": "weight_out_of_range", "d": "endpoint_not_found", "e": "weight_out_of_range"}


def test_retrieval_serves_and_abstains(spark):
    docs = frame(spark, [("a", "cache stampede after deploy"), ("b", "deploy freeze policy"), ("c", "unrelated words about lunch menus"), ("d", "cache"), ("e", None)], "id string, text string")
    links = frame(spark, [("a", "c"), ("c", "a"), ("b", "b"), ("d", "c")], "source string, target string")
    queries = frame(spark, [("q1", "Cache deploy!"), ("q2", "zebra"), ("q3", ""), ("q4", "👍 lunch")], "query_id string, query string")
    got = retrieval.retrieve(docs, links, queries)
    out = {r["query_id"]: r for r in got.decisions.collect()}
    assert out["q2"]["outcome"] == "abstained" and out["q2"]["reason"] == "no_candidates" and out["q1"]["outcome"] == "served"
    assert set(out["q1"]["served"]) == {"a", "b", "c", "d"} and out["q4"]["query_chars"] == 8 and len(out["q1"]["query_hash"]) == 16
    struct = {(r["query_id"], r["channel"]): r for r in got.margins.collect()}
    assert struct["q1", "structural"]["top_score"] == 3.0 and struct["q2", "lexical"]["considered"] == 0 and struct["q2", "lexical"]["margin"] is None
    assert retrieval.contradictions(got.decisions).count() == 0
    with pytest.raises(EngineError, match="invalid_k"):
        retrieval.retrieve(docs, links, queries, k=0)


def test_fusion_ties_go_to_the_id(spark):
    rows = [("q", "x", "b", 1.0, 1), ("q", "y", "a", 9.0, 1), ("q", "x", "c", 0.5, 2), ("q", "y", "c", 0.5, 2)]
    channels = frame(spark, rows, "query_id string, channel string, id string, score double, rank int")
    fused = retrieval.fuse(channels).orderBy("position").collect()
    assert [r["id"] for r in fused] == ["c", "a", "b"] and abs(fused[0]["fused"] - 2 / 62) < 1e-12
    bad = channels.unionByName(frame(spark, [("q", "x", "b", 1.0, 3), ("q", "x", None, 1.0, 4)], channels.schema))
    assert sorted(r["reason"] for r in retrieval.fusion_problems(bad).collect()) == ["duplicate_id_in_channel", "missing_id"]


def test_blocking_scoring_and_clusters(spark):
    rows = [("1", "payment outage", "node", {"k": "v"}), ("2", "payment outages", "node", {"k": "v"}), ("3", "outage payment", "decision", {}), ("4", "lunch menu", "node", {}), ("5", "", "node", {}), ("6", "--", "node", {})]
    r = frame(spark, rows, "id string, name string, type string, props map<string,string>")
    pairs = {(p["a"], p["b"]) for p in resolve.block(r, True, True).collect()}
    assert pairs == {("1", "2"), ("1", "3"), ("2", "3"), ("5", "6")}
    scored = resolve.score_pairs(resolve.block(r, True, True), r)
    by = {(p["a"], p["b"]): p for p in scored.collect()}
    assert by["1", "2"]["type_score"] == 1.0 and by["1", "2"]["props_score"] == 1.0 and by["1", "3"]["props_score"] == 0.0 and by["5", "6"]["name_score"] == 1.0
    assert {(p["a"], p["b"]) for p in resolve.cap_by_similarity(scored, 1).collect()} >= {("1", "2"), ("5", "6")}
    members, clusters = resolve.suggest(r)
    assert {(m["id"], m["cluster"]) for m in members.collect()} == {("1", "1"), ("2", "1")} and clusters.first()["merges"] == 1


def test_weakest_link_is_that_of_the_spanning_forest(spark):
    pairs = [("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("c", "d", 0.75), ("x", "y", 0.71), ("a", "z", 0.1)]
    members, clusters = resolve.cluster(frame(spark, [(i,) for i in "abcdxyz"], "id string"), frame(spark, pairs, "a string, b string, score double"))
    out = {r["cluster"]: r for r in clusters.collect()}
    assert (out["a"]["weak_a"], out["a"]["weak_b"], out["a"]["size"], out["a"]["merges"]) == ("c", "d", 4, 3)
    assert out["z"]["weak_a"] is None and out["z"]["size"] == 1 and out["x"]["merges"] == 1


TEXTS = [
    ("The cache bug caused the outage.", [("CAUSED", "The cache bug", "the outage")]),
    ("We saw that the review led to a rewrite", [("CAUSED", "the review", "a rewrite")]),
    ("The incident, which lasted hours, influenced the policy", [("INFLUENCED", "The incident", "the policy")]),
    ("It may rain, but the spike caused alarms", [("CAUSED", "but the spike", "alarms")]),
    ("No one disputes that the deploy caused it", [("CAUSED", "the deploy", "it")]),
    ("Nobody believes that the deploy caused it", []),
    ("the deploy never caused it", []),
    ("did the notice caused alarm", [("CAUSED", "did the notice", "alarm")]),
    ("the ruling set a precedent for appeals", [("PRECEDENT_FOR", "the ruling", "appeals")]),
    ("", []),
]


def test_extraction(spark):
    found, suppressed = extract.relations(frame(spark, [(str(i), t) for i, (t, _) in enumerate(TEXTS)] + [("n", None)], "id string, text string"))
    got = {}
    for r in found.collect():
        got.setdefault(r["source"], []).append((r["predicate"], r["subject_text"], r["object_text"]))
    assert got == {str(i): want for i, (_, want) in enumerate(TEXTS) if want}
    assert {r["source"]: r["cue"] for r in suppressed.collect()} == {"5": "nobody", "6": "never"}


def test_spans_are_utf16(spark):
    texts = frame(spark, [("s", "👍 the 👍 bug caused an outage", False)], "id string, text string, purged boolean")
    found, _ = extract.relations(texts)
    spans = found.select("source", F.col("subject.start").cast("double").alias("start"), F.col("subject.end").cast("double").alias("end"))
    assert [r["quote"] for r in extract.resolve_spans(spans, texts).collect()] == [r["subject_text"] for r in found.collect()]


def test_linking_verdicts(spark):
    records = frame(spark, [("r1", "payments service", "node"), ("r2", "payments team", "node"), ("r3", "service level objective doc", "node"), ("r4", "search indexer", "node"), ("r5", "search indexer", "node")], "id string, name string, type string")
    mentions = frame(spark, [("a", "the payments service"), ("b", "the SLO doc"), ("c", "search indexer"), ("d", "zzzz"), ("e", "the service")], "mention_id string, mention string")
    ranked, verdicts = link.link(mentions, records)
    out = {r["mention_id"]: r for r in verdicts.collect()}
    assert out["a"]["id"] == "r1" and out["a"]["verdict"] == "ranked" and out["b"]["id"] == "r3" and out["c"]["verdict"] == "tie" and out["d"]["verdict"] == "no_candidates" and out["e"]["verdict"] == "weak"
    gold = frame(spark, [("a", "r1"), ("b", "r3"), ("d", None), ("e", None)], "mention_id string, gold string")
    q = evaluate.linking_quality(verdicts, ranked, gold).first()
    assert (q["recall_any"], q["top1"], q["nil_flagged"]) == (1.0, 1.0, 1.0)


def test_merged_view(spark):
    merges = frame(spark, [("m1", 5, ["a", "b", "c"], "b"), ("m2", 6, ["c", "d"], "d")], "id string, seq long, members array<string>, canonical string")
    assert {(r["requested"], r["canonical"], r["via"]) for r in identity.resolve_ids(frame(spark, [(i,) for i in "abcdx"], "id string"), merges).collect()} == {("a", "b", "m1"), ("b", "b", None), ("c", "b", "m1"), ("d", "d", None), ("x", "x", None)}
    fields = frame(spark, [("a", "f", "1"), ("b", "f", "2"), ("a", "g", "3"), ("d", "f", "9")], "id string, field string, value string")
    composed, conflicts, missing = identity.merged_view(merges, fields, fields.select("id").distinct())
    assert {(r["canonical"], r["field"], r["value"]) for r in composed.collect()} == {("b", "f", "2"), ("b", "g", "3"), ("d", "f", "9")}
    assert [(r["canonical"], [h["id"] for h in r["holders"]]) for r in conflicts.collect()] == [("b", ["b", "a"])]
    assert {(r["canonical"], r["member"]) for r in missing.collect()} == {("b", "c"), ("d", "c")}


def test_evaluation(spark):
    truth = frame(spark, [("q1", ["a", "b"], ["z"]), ("q2", [], None), ("q3", ["c"], None)], "query_id string, relevant array<string>, irrelevant array<string>")
    served = frame(spark, [("q1", "z", 1), ("q1", "a", 2), ("q2", "x", 1)], "query_id string, id string, position int")
    judged = {r["query_id"]: r for r in evaluate.judge_queries(truth, served).collect()}
    assert (judged["q1"]["precision"], judged["q1"]["recall"], judged["q1"]["reciprocal_rank"], judged["q1"]["forbidden_hits"]) == (0.5, 0.5, 0.5, 1)
    assert judged["q2"]["false_serve"] and judged["q3"]["false_abstain"] and judged["q2"]["recall"] == 1.0
    total = evaluate.retrieval_score(evaluate.judge_queries(truth, served)).first()
    assert abs(total["score"] - (0.25 - 0.02 - 0.01)) < 1e-12


def test_codes_are_closed():
    with pytest.raises(AssertionError):
        EngineError("no_such_code")
    assert len(set(itertools.chain(*CODES.values()))) >= 40
