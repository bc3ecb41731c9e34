"""Retrieval over whole benchmark items against a plain restatement."""

import math
import re

from veritrail.plans import queries as plans

TOKEN = re.compile("[a-z0-9]{2,}")


def test_whole_items_are_asked(spark, tmp_path):
    head = "alpha beta gamma delta epsilon zeta eta theta"
    items = [(1, f"{head} iota kappa lambda"), (2, f"{head} omicron sigma tau")]
    texts = [f"{head} iota kappa lambda", f"{head} omicron sigma tau", f"{head} nothing more here", "iota kappa lambda", "omicron words and others"] + [f"filler text number{i}" for i in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokens = [TOKEN.findall(t.lower()) for t in texts]
    n, want = len(texts), {}
    for item, text in items:
        for i, t in enumerate(tokens):
            score = sum(math.log(1 + n / sum(x in u for u in tokens)) / math.log(1 + n) for x in set(TOKEN.findall(text)) & set(t)) / math.sqrt(len(t))
            if score > 0:
                want[f"q{item}", str(i)] = round(score, 6)
    queries = plans.queries()
    got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in queries["lexical_channel_whole"](spark, str(tmp_path)).collect()}
    assert got == want and ("q1", "3") in got
    served = {r["query_id"]: r["id"] for r in queries["retrieve_served_whole"](spark, str(tmp_path)).where("position = 1").collect()}
    assert served == {"q1": "0", "q2": "1"}
    judged = {r["query_id"]: r["recall"] for r in queries["retrieval_eval_whole"](spark, str(tmp_path)).collect()}
    assert judged == {"q1": 1.0, "q2": 1.0}
    assert {r["query_chars"] for r in _decisions(spark, tmp_path)} == {len(t) for _, t in items}


def _decisions(spark, path):
    return plans._retrieved(spark, str(path), None).decisions.collect()
