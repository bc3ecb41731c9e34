"""The published quality figures, over the labelled sets that they were taken on."""

import pytest
from pyspark.sql import functions as F

from tests import golden_values as g
from veritrail.operators import evaluate, extract, link, resolve, retrieval
from veritrail.session import durable


@pytest.fixture(scope="module")
def judged(spark):
    docs = durable(spark.createDataFrame([(i, t, n) for n, (i, _, t) in enumerate(g.CORPUS)], "id string, text string, at int"))
    links = durable(spark.createDataFrame([e[:2] for e in g.EDGES], "source string, target string"))
    queries = durable(spark.createDataFrame([q[:2] for q in g.QUERIES], "query_id string, query string"))
    truth = durable(spark.createDataFrame([(i, list(r), list(x)) for i, _, r, x in g.QUERIES], "query_id string, relevant array<string>, irrelevant array<string>"))

    def score(served):
        return evaluate.retrieval_score(evaluate.judge_queries(truth, served)).first()

    return docs, links, queries, score


def test_retrieval(judged):
    docs, links, queries, score = judged
    got = score(retrieval.retrieve(docs, links, queries).served)
    assert [round(got[c], 3) for c in ("score", "precision", "recall", "mrr")] == [0.922, 0.906, 0.938, 0.938]
    assert got["false_serves"] == got["false_abstains"] == 0


@pytest.mark.parametrize(("options", "want"), [({"lexical_floor": 0.2}, 0.707), ({"lexical_floor": 0.4}, 0.854), ({"structural_floor": 2.0}, 0.693), ({"structural_floor": 4.0}, 0.693)])
def test_floors(judged, options, want):
    docs, links, queries, score = judged
    assert round(score(retrieval.retrieve(docs, links, queries, **options).served)["score"], 3) == want


def test_fusion_constant_is_flat(spark, judged):
    docs, links, queries, score = judged
    rows = [(float(k), score(retrieval.retrieve(docs, links, queries, k=k).served)["score"]) for k in (1, 60, 300)]
    assert evaluate.sweep_verdict(spark.createDataFrame(rows, "value double, score double"), 60.0).first()["verdict"] == "flat"
    other = evaluate.sweep_verdict(spark.createDataFrame([(0.2, 0.707), (0.3, 0.922), (0.4, 0.854)], "value double, score double"), 0.3).first()
    assert (other["verdict"], other["best"]) == ("agrees", 0.3)


def test_baselines(judged):
    docs, links, queries, score = judged
    assert round(score(evaluate.lexical_only(retrieval.lexical_channel(docs, queries)))["score"], 3) == 0.439
    assert round(score(evaluate.return_all(docs, queries))["score"], 3) == 0.119


@pytest.mark.parametrize(("phonetic", "want"), [(False, (21, 0.667, 0.19, 0.935)), (True, (24, 1.0, 0.25, 0.926))])
def test_blocking(spark, phonetic, want):
    records = spark.createDataFrame([r[:3] for r in g.RECORDS], "id string, name string, type string")
    truth = spark.createDataFrame([tuple(sorted(p)) for p in g.DUPLICATES], "a string, b string")
    pairs = resolve.block(records, False, phonetic)
    got = evaluate.blocking_quality(pairs, truth, len(g.RECORDS)).first()
    assert (got["pairs"], *(round(got[c], 3) for c in ("completeness", "quality", "reduction"))) == want
    p, q = got["completeness"], got["quality"]
    assert abs(got["f_measure"] - 2 * p * q / (p + q)) < 1e-12
    assert evaluate.missed_pairs(pairs, truth).count() == round((1 - want[1]) * 6)


def test_blocking_without_duplicates_is_complete(spark):
    none = spark.createDataFrame([], "a string, b string")
    got = evaluate.blocking_quality(none, none, 3).first()
    assert (got["completeness"], got["quality"], got["reduction"], got["f_measure"]) == (1.0, 0.0, 1.0, 0.0)


def test_extraction(spark):
    texts = spark.createDataFrame([(i, t, f) for i, f, t, _ in g.TEXTS], "id string, text string, family string")
    gold = spark.createDataFrame([(i, *r) for i, _, _, rs in g.TEXTS for r in rs], "id string, predicate string, subject string, object string")
    found, _ = extract.relations(texts.select("id", "text"))
    rows = found.select(F.col("source").alias("id"), "predicate", F.col("subject_text").alias("subject"), F.col("object_text").alias("object"))
    got = evaluate.extraction_quality(gold, rows, texts).first()
    assert (got["hits"], got["found"], got["gold"], got["kept_silent"], got["silent"]) == (15, 15, 15, 18, 18)
    families = evaluate.extraction_quality(gold, rows, texts, "family").collect()
    assert len(families) == len({f for _, f, _, _ in g.TEXTS}) and all(r["recall"] == 1 or not r["gold"] for r in families)
    twice = evaluate.extraction_quality(gold, rows.unionByName(rows), texts).first()
    assert (twice["hits"], twice["found"], twice["precision"], twice["recall"]) == (15, 30, 0.5, 1.0)


def test_linking(spark):
    records = spark.createDataFrame(g.LINK_RECORDS, "id string, name string, type string")
    rows = [(f"m{n:02d}", m, gold, family) for n, (m, gold, family) in enumerate(g.MENTIONS)]
    mentions = spark.createDataFrame(rows, "mention_id string, mention string, gold string, family string")
    ranked, verdicts = (durable(x) for x in link.link(mentions.select("mention_id", "mention"), records))
    gold = mentions.select("mention_id", "gold", "family")
    got = evaluate.linking_quality(verdicts, ranked, gold).first()
    assert (got["recall_any"], got["nil_flagged"]) == (1.0, 1.0) and round(got["top1"] * 17) == 16 and got["separation"] is not None
    by = {r["family"]: r for r in evaluate.linking_quality(verdicts, ranked, gold, by="family").collect()}
    assert set(by) == {f for _, _, f in g.MENTIONS} and by["nil-near"]["nil_flagged"] == 1.0 and by["exact"]["top1"] == 1.0
    rules = {"none": F.lit(False), "shipped": (F.coalesce("margin", F.lit(1.0)) < 0.1) | F.col("type_only"), "all": F.lit(True)}
    nil = {r["rule"]: r for r in evaluate.nil_rules(verdicts, gold, rules).collect()}
    assert nil["shipped"]["nil_flagged"] == 7 and nil["none"]["kept"] == nil["shipped"]["top1"] == 16 and (nil["all"]["kept"], nil["all"]["nil_rejected"]) == (0, 7)
