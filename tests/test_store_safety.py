"""The store under crashes and two writers, whole tables appended, and reads by id."""

import json
import threading
import time

import pytest

from veritrail.errors import EngineError
from veritrail.operators import causal
from veritrail.sources import log as logs
from veritrail.store import Store


@pytest.fixture()
def store(spark, tmp_path):
    days = iter(range(1, 29))
    return Store(spark, str(tmp_path / "store"), "w", lambda: f"2024-01-{next(days):02d}T00:00:00Z", lambda: "salt")


def node(id_, text):
    return {"kind": "node", "id": id_, "content": {"text": text}}


def test_a_rewrite_that_stops_half_way_changes_nothing(store, monkeypatch):
    store.append([node("a", "first"), node("b", "second")])
    put = logs.LogStore._put

    def fail(self, name, text, overwrite):
        if name == "v2.ready":
            raise OSError("gone")
        put(self, name, text, overwrite)

    monkeypatch.setattr(logs.LogStore, "_put", fail)
    with pytest.raises(OSError, match="gone"):
        store.purge("a", "private")
    assert store.files.version() == 1 and store.content_of("a") == {"text": "first"}
    monkeypatch.undo()
    store.append([node("c", "third")])  # sweeps what was left
    assert {n for n in store.files._names() if n.startswith("v")} == {"v1", "v1.ready"} and store.verify().first()["valid"]


def test_old_versions_left_by_a_crash_go_with_the_next_write(store, monkeypatch):
    store.append([node("a", "first")])
    monkeypatch.setattr(logs.LogStore, "_sweep", lambda self, current: None)
    store.purge("a", "private")
    assert store.files.version() == 2 and "v1" in store.files._names()
    monkeypatch.undo()
    store.append([node("b", "second")])
    assert {n for n in store.files._names() if n.startswith("v")} == {"v2", "v2.ready"} and store.content_of("a") is None


def test_locks_are_waited_for_owned_and_broken_when_stale(store, monkeypatch):
    files = store.files
    with files.lock():
        with pytest.raises(EngineError, match="lock_timeout"), files.lock(wait=0.1):
            pass
        assert files._holder()
    monkeypatch.setattr(logs, "LOCK_BEAT_S", 60.0)
    with files.lock():
        files._fs.setTimes(files._at("LOCK"), int((time.time() - 3600) * 1000), -1)
        with files.lock(wait=0.5):
            mine = files._holder()
        files._put("LOCK", "another", overwrite=False)
        assert mine != "another"
    assert files._holder() == "another"  # the first holder did not remove another's lock


def test_two_writers_take_turns(store):
    failed = []

    def write(k):
        try:
            with store.files.lock(wait=60):
                pass
            store.append([node(f"n{k}", "x")])
        except Exception as e:  # reported below
            failed.append(e)

    logs_wait = logs.LOCK_WAIT_S
    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    kept = store.log.count()
    assert kept + len(failed) == 2 and all(getattr(e, "code", "") == "lock_timeout" for e in failed) and logs_wait
    assert store.verify().first()["valid"]


def rows_of(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "pos long, kind string, id string, content string, meta string")


def test_tables_are_appended_whole(spark, store):
    store.append([node("a", "first")])
    store.append_frame(rows_of(spark, [("decision", "b", '{"text":"second"}', None), ("node", "c", '{"text":"third"}', '{"validFrom":"2023-01-01"}'), ("edge", "a->b", "{}", '{"source":"a","target":"b","edgeType":"CAUSED","weight":0.5}')]))
    report = store.verify().first()
    assert report["valid"] and report["total"] == 4
    again = Store(spark, store.files.path, "w")
    assert [(r["path"], r["product_confidence"]) for r in again.why(["b"]).collect()] == [(["a", "b"], 0.5)]
    assert again.state_at("2022-01-01").nodes.where("id = 'c'").count() == 0 and len({r["salt"] for r in again.log.collect()}) == 4
    assert json.loads(again.log.where("id = 'c'").first()["meta"])["validFrom"] == "2023-01-01"


@pytest.mark.parametrize(
    ("row", "code"),
    [
        (("node", "a", "{}", None), "duplicate_id"), (("node", "z", None, None), "null_content"), (("thing", "z", "{}", None), "unknown_kind"),
        (("edge", "z", "{}", '{"source":"a","target":"ghost"}'), "endpoint_not_found"), (("edge", "z", "{}", '{"source":"a","target":"a","weight":2}'), "weight_out_of_range"),
        (("edge", "z", "{}", '{"source":"a","target":"a","edgeType":"X"}'), "unknown_edge_type"), (("node", "z", "{}", '{"workspace":"other"}'), "workspace_mismatch"),
    ],
)
def test_tables_are_refused_whole(spark, store, row, code):
    store.append([node("a", "first")])
    with pytest.raises(EngineError, match=code):
        store.append_frame(rows_of(spark, [("node", "fine", "{}", None), row]))
    assert store.log.count() == 1


def test_reads_by_id(store):
    store.append([node("a", "first"), node("b", "second"), {"kind": "decision", "id": "d", "content": {"text": 7, "name": " ", "title": "a title"}}])
    store.link_records("a", "b", "CAUSED", 0.5)
    assert store.get("a")["kind"] == "node" and store.get("a", "decision") is None and store.get("ghost") is None
    store.merge(["a", "b"], "a", "same")
    assert store.content_of("b") == {"text": "first"} and store.contents(["b"]).first()["via"].startswith("merge:") and store.content_of("ghost") is None
    labels = {r["id"]: r["label"] for r in store.graph_view()[0].collect()}
    assert labels == {"a": "first", "b": "second", "d": "a title"} and {r["id"]: r["text"] for r in store.texts().collect()}["d"] is None
    assert store.graph_view()[1].first()["has_evidence"] is False
    contents = store.why_contents(["b"]).first()["contents"]
    assert [json.loads(c) for c in contents] == [{"text": "second"}, {"text": "first"}]
    with pytest.raises(EngineError, match="workspace_mismatch"):
        store.append([{"kind": "node", "id": "x", "content": {}, "meta": {"workspace": "other"}}])


def test_chain_plans_grow_by_one_join_a_level(spark):
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "CAUSED", 0.5) for i in range(30)] + [("x", "n2", "m", "CAUSED", 0.25)], "id string, source string, target string, type string, weight double")
    starts = spark.createDataFrame([("n0",), ("n29",), ("lonely",)], "start string")
    joins = [causal.find_chains(edges, starts, "downstream", d)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for d in (5, 10, 20)]
    assert joins == [5, 10, 20]
    got = sorted((r["start"], tuple(r["nodes"])) for r in causal.find_chains(edges, starts, "downstream", 4).collect())
    assert got == [("n0", ("n0", "n1", "n2", "m")), ("n0", ("n0", "n1", "n2", "n3", "n4")), ("n29", ("n29", "n30"))]
