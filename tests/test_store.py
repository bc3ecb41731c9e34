import json
import os

import pytest
from pyspark.sql import functions as F

from veritrail import cli
from veritrail.errors import EngineError
from veritrail.operators import chain
from veritrail.sources.log import LogStore, citations, read_jsonl
from veritrail.store import Store
from veritrail.streaming import tail


class Clock:
    day = 0

    def __call__(self):
        self.day += 1
        return f"2024-01-{self.day:02d}T00:00:00Z"


@pytest.fixture()
def store(spark, tmp_path):
    salts = iter(f"salt{i}" for i in range(1000))
    return Store(spark, str(tmp_path / "store"), "w", Clock(), lambda: next(salts))


def node(id_, text, kind="node", **meta):
    return {"kind": kind, "id": id_, "content": {"text": text}, "meta": meta}


def test_session(spark, store, tmp_path):
    store.append([node("deploy", "the friday deploy", "decision", validFrom="2023-06-01"), node("outage", "the checkout outage", "decision"), node("note", "the friday deploy caused the checkout outage")])
    store.link_records("deploy", "outage", "CAUSED", 0.9)
    assert store.verify().first()["valid"] and store.log.count() == 4
    assert {r["id"] for r in store.state_at("2024-02-01").nodes.collect()} == {"deploy", "outage", "note"}
    assert store.state_at("2023-01-01").nodes.where("id = 'deploy'").count() == 0
    why = store.why(["outage"]).collect()
    assert [(r["path"], r["product_confidence"]) for r in why] == [(["deploy", "outage"], 0.9)]
    found = store.find({"q": "checkout outage"})
    assert found.decisions.first()["outcome"] == "served"
    store.record_retrieval(found)
    assert "checkout" not in store.log.where("kind = 'retrieval'").first()["content"]

    relations, _, ranked = store.propose()
    proposal = relations.first().asDict(recursive=True)
    assert proposal["source"] == "note" and ranked.where("mention_id like '%subject' and rank = 1").first()["id"] == "deploy"
    store.confirm(proposal, "deploy", "outage")
    assert [(r["quote"], r["reason"]) for r in store.evidence().collect()] == [("the friday deploy caused the checkout outage", None)]
    with pytest.raises(EngineError, match="duplicate_id"):
        store.confirm(proposal, "deploy", "outage")

    store.retract("outage", "was planned", "2024-01-20")
    assert store.state_at("2024-02-01").nodes.where("id = 'outage'").count() == 0 and store.state_at("2024-01-15").nodes.where("id = 'outage'").count() == 1
    assert store.state_at("2024-02-01").edges.where("target = 'outage'").count() == 0

    store.merge(["deploy", "note"], "deploy", "same thing")
    assert store.resolve_ids(["note"]).first()["canonical"] == "deploy"
    for ids, canonical, code in ((["deploy"], "deploy", "merge_too_small"), (["note", "outage"], "deploy", "canonical_not_a_member"), (["note", "outage"], "note", "member_already_merged"), (["outage", "ghost"], "outage", "not_found")):
        with pytest.raises(EngineError, match=code):
            store.merge(ids, canonical, "x")
    with pytest.raises(EngineError, match="canonical_of_active_merge"):
        store.purge("deploy", "x")
    store.purge("note", "private")
    assert store.verify().first().asDict() | {"problems": 0} == {"workspace": "w", "total": store.log.count(), "purged": 1, "problems": 0, "valid": True}
    kept = "".join(open(os.path.join(d, f), errors="replace").read() for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet"))
    assert "friday deploy caused" not in kept and [r["reason"] for r in store.evidence().collect()] == ["source_purged"]
    assert store.merged_view()[2].first()["member"] == "note"
    for call, code in ((lambda: store.purge("note", "x"), "already_purged"), (lambda: store.purge("ghost", "x"), "not_found"), (lambda: store.retract("ghost", "x"), "not_found"), (lambda: store.retract("deploy", "x", "2024-99-01"), "malformed_temporal_value")):
        with pytest.raises(EngineError, match=code):
            call()
    again = Store(spark, store.files.path, "w")
    assert again.log.count() == store.log.count() and again.graph_view()[0].where("purged").first()["id"] == "note"


@pytest.mark.parametrize(
    ("record", "code"),
    [
        (node("a", "again"), "duplicate_id"), ({"kind": "node", "id": "n", "content": None}, "null_content"), ({"kind": "edge", "id": "e", "content": {}, "meta": {"source": "a", "target": "ghost"}}, "endpoint_not_found"),
        ({"kind": "edge", "id": "e", "content": {}, "meta": {"source": "a", "target": "a", "edgeType": "LIKES"}}, "unknown_edge_type"), ({"kind": "edge", "id": "e", "content": {}, "meta": {"source": "a", "target": "a", "weight": 2}}, "weight_out_of_range"),
    ],
)
def test_bad_records_are_refused(store, record, code):
    store.append([node("a", "first")])
    with pytest.raises(EngineError, match=code):
        store.append([record])
    assert store.log.count() == 1


def test_lock_and_damage(spark, store):
    store.append([node("a", "x"), node("b", "y")])
    other = LogStore(spark, store.files.path)
    with store.files.lock(), pytest.raises(EngineError, match="lock_timeout"), other.lock(wait=0.2):
        pass
    with store.files.lock():
        store.files.rewrite(spark.createDataFrame(store.log.withColumn("content", F.lit('{"text":"forged"}')).collect(), store.log.schema))
    with pytest.raises(EngineError, match="chain_invalid"):
        Store(spark, store.files.path, "w")


def test_json_lines(spark, store, tmp_path):
    store.append([node("a", "é 👍"), node("b", "y")])
    rows = store.log.orderBy("seq").collect()
    lines = [json.dumps({"kind": r["kind"], "id": r["id"], "seq": r["seq"], "prev": r["prev"], "digest": r["digest"], "contentDigest": r["content_digest"], "salt": r["salt"], "content": json.loads(r["content"]), "meta": json.loads(r["meta"])}, ensure_ascii=False) for r in rows]
    path = tmp_path / "log.jsonl"
    path.write_text("\n\n".join(lines) + "\n", encoding="utf-8")
    log = read_jsonl(spark, str(path))
    assert chain.verify(log).count() == 0 and log.count() == 2
    path.write_text(lines[0] + "\n{oops\n", encoding="utf-8")
    with pytest.raises(EngineError, match="malformed_line"):
        read_jsonl(spark, str(path))
    path.write_text(lines[0].replace('"node"', '"gnome"'), encoding="utf-8")
    assert [r["problem"] for r in read_jsonl(spark, str(path), strict=False).collect()] == ["unknown_kind"]


def test_citations(spark, tmp_path):
    for n, text in ((1, "first"), (2, "because of DEC-001 and DEC-999"), (3, "Supersedes DEC-002.")):
        (tmp_path / f"DEC-00{n}-x.md").write_text(text)
    notes, edges = citations(spark, str(tmp_path))
    assert notes.count() == 3
    assert sorted((r["source"], r["target"], r["type"]) for r in edges.collect()) == [("DEC-001", "DEC-002", "INFLUENCED"), ("DEC-002", "DEC-003", "CAUSED"), ("DEC-002", "DEC-003", "INFLUENCED")]


def test_command_line(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "s"), "--workspace", "w"]
    for argv in (["record", "decision", "a", '{"text": "the deploy"}'], ["record", "node", "b", '{"text": "the deploy caused an outage"}'], ["link", "a", "b", "CAUSED"]):
        assert cli.run(spark, [*at, *argv]) == 0
    capsys.readouterr()
    for verb in (["verify"], ["log"], ["why", "b"], ["find", "deploy"], ["at", "2030-01-01"], ["suggest"], ["extract"], ["refers", "the deploy"], ["view", "a"], ["evidence"]):
        assert cli.run(spark, [*at, *verb]) == 0
    assert '"valid":true' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.run(spark, [*at, "nonsense"])


def test_stream_finds_breaks(spark, store, tmp_path):
    store.append([node(f"n{i}", "x") for i in range(5)])
    log = store.log.where("id <> 'n2'")
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    rows = tail.run_to_end(tail.chain_breaks(stream)).collect()
    assert sorted((r["id"], r["reason"]) for r in rows) == [("n3", "chain_break"), ("n3", "sequence_gap")]
