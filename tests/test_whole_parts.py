"""Resolution over every part against the operators on one record per row."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail.operators import resolve
from veritrail.plans import queries as plans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("parts"))
    rows = [(i, rng.choice(["blue bolt", "blue nut", "red bolt", "Blue Bolt", "green plate"]), rng.choice(["ECONOMY", "PROMO"]), rng.choice(["B1", "B2"])) for i in range(1, 61)]
    rows += [(61, "blue bolt", None, "B1"), (62, "blue bolt", None, "B1"), (63, "odd gadget", "PROMO", "B1")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{path}/part.parquet")
    records = spark.createDataFrame(rows, "id long, name string, type string, brand string").select("id", "name", "type", F.create_map(F.lit("brand"), "brand").alias("props"))
    return path, records, resolve.score_pairs(resolve.block(records, True, True), records).cache()


def test_pairs_of_classes_stand_for_all_pairs(spark, tables):
    path, _, pairs = tables
    run = plans.queries()
    of = {r["id"]: r["class"] for r in run["part_classes"](spark, path).collect()}
    assert len(of) == 63 and len(set(of.values())) < 40
    score = {(r["a"], r["b"]): r["score"] for r in run["trigram_similarity_whole"](spark, path).collect()}
    assert {(r["a"], r["b"]) for r in run["block_pairs_whole"](spark, path).collect()} == set(score)
    want = {(r["a"], r["b"]): round(r["score"], 9) for r in pairs.collect()}
    got = {(a, b): 1.0 if of[a] == of[b] else score.get(tuple(sorted((of[a], of[b])))) for a in of for b in of if a < b}
    assert {k: v for k, v in got.items() if v is not None} == want
    stats, quality = run["block_stats_whole"](spark, path).first(), run["blocking_eval_whole"](spark, path).first()
    assert stats["records"] == 63 and stats["all_pairs"] == 63 * 31 and stats["compared"] == quality["pairs"] == len(want)
    names = {r["id"]: r["name"] for r in tables[1].collect()}
    true = {(a, b) for a in of for b in of if a < b and names[a] == names[b]}
    assert quality["true"] == len(true) and quality["kept"] == len(true & set(want))


def test_clusters_and_caps_of_all_parts(spark, tables):
    path, records, pairs = tables
    run = plans.queries()
    members, sizes = resolve.cluster(records, pairs, 0.75)
    assert set(map(tuple, run["clusters_whole"](spark, path).collect())) == set(map(tuple, members.collect()))
    assert set(map(tuple, run["cluster_sizes_whole"](spark, path).collect())) == set(map(tuple, sizes.select("cluster", "size", "merges").collect()))
    suggested = {(r["cluster"], r["size"], r["weak_score"]) for r in run["suggest_whole"](spark, path).collect()}
    assert suggested == {(r["cluster"], r["size"], r["weak_score"]) for r in resolve.suggest(records)[1].collect()}
    ends = {}
    for r in pairs.collect():
        ends.setdefault(r["a"], []).append((-r["score"], r["b"], (r["a"], r["b"])))
        ends.setdefault(r["b"], []).append((-r["score"], r["a"], (r["a"], r["b"])))
    want = {x[2] for e in ends.values() for x in sorted(e)[:3]}
    assert set(map(tuple, run["cap_topk_whole"](spark, path).collect())) == want
