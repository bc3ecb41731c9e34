"""Retrieval without shuffles of tokens: blocks, ties to the SQL and how often documents are scanned."""

import pytest

from veritrail.operators import postings, retrieval
from veritrail.plans import queries as plans

TEXTS = ["alpha beta gamma", "Alpha, alpha! beta-9 x", "gamma delta épsilon", "no shared words", "alpha beta", None, ""]


@pytest.fixture()
def tables(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "id string, text string").repartition(3)
    queries = spark.createDataFrame([("a", "alpha beta"), ("b", "GAMMA épsilon 9"), ("c", "nowhere to be found"), ("d", None), ("e", "beta 9 x alpha")], "query_id string, query string")
    return docs, queries


def _rows(frame):
    return sorted((r["query_id"], r["id"], r["score"]) for r in frame.collect())


def test_neither_tokens_nor_pairs_are_shuffled(tables):
    plan = retrieval.lexical_scores(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_blocks_and_runs_change_no_score(tables, monkeypatch):
    whole = _rows(retrieval.lexical_scores(*tables))
    assert {r[:2] for r in whole} == {("a", "0"), ("a", "1"), ("a", "4"), ("b", "0"), ("b", "2"), ("e", "0"), ("e", "1"), ("e", "4")}
    monkeypatch.setattr(postings, "BLOCK_BYTES", 30)
    assert _rows(retrieval.lexical_scores(*tables)) == whole
    index = postings._index(tables[0], [("a", b"alpha beta", b"alpha beta"), ("b", b"gamma", b"gamma")])
    texts = [t.lower().encode() if t else None for t in TEXTS]
    sums = [(int(d), int(q), float(s)) for part in postings._sums(texts, index) for d, q, s in zip(*part, strict=True)]
    monkeypatch.setattr(postings, "PAIRS", 1)
    assert [(int(d), int(q), float(s)) for part in postings._sums(texts, index) for d, q, s in zip(*part, strict=True)] == sums


def test_a_floor_counts_what_it_cuts_off(tables):
    every = _rows(retrieval.lexical_scores(*tables))
    kept, seen = retrieval.lexical_candidates(*tables, 0.9)
    assert _rows(kept) == [r for r in every if r[2] >= 0.9] and len(kept.collect()) < len(every)
    want = {q: (sum(r[0] == q for r in every), max(r[2] for r in every if r[0] == q)) for q in "abe"}
    assert {r["query_id"]: (r["considered"], r["top_score"]) for r in seen.collect()} == want


def _written(spark, path):
    head = "one two three four five six seven eigh"
    texts = [f"{head}t nine", "one two three", f"and {head} nine", None, "filler"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, f"{head} more words"), (2, "one"), (3, "Ω")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_truth_is_what_the_sql_says(spark, tmp_path):
    """A query may end inside a word of a document, or hold no inner word at all."""
    db = pytest.importorskip("duckdb").connect()
    path = _written(spark, tmp_path)
    for name in ("documents", "benchmark"):
        db.sql(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    want = db.sql(plans.oracle_sql()["retrieval_eval"]).df().sort_values("query_id").to_dict("records")
    got = plans.queries()["retrieval_eval"](spark, path).toPandas().sort_values("query_id").to_dict("records")
    assert got == want and [r["answerable"] for r in got] == [True, True, False]


@pytest.mark.parametrize("name", ["rrf_sweep", "sweep_floor", "rrf_sweep_whole", "sweep_floor_whole"])
def test_a_sweep_scores_documents_once(spark, tmp_path, monkeypatch, name):
    scans = []
    scan = postings._scan
    monkeypatch.setattr(postings, "_scan", lambda *a: scans.append(1) or scan(*a))
    assert plans.queries()[name](spark, _written(spark, tmp_path)).count() == 3 and len(scans) == 1
