"""The store over HTTP and as tools."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from veritrail import serve, verbs
from veritrail.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    days = iter(range(1, 29))
    s = Store(spark, str(tmp_path_factory.mktemp("served") / "store"), "w", lambda: f"2024-01-{next(days):02d}T00:00:00Z", lambda: "salt")
    s.append([{"kind": "decision", "id": i, "content": {"text": t}} for i, t in (("deploy", "the friday deploy"), ("outage", "the checkout outage"), ("note", "the friday deploy caused the checkout outage"))])
    s.link_records("deploy", "outage", "CAUSED", 0.9)
    return s


def call(store, name, **arguments):
    out = serve.respond(store, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
    text = out["content"][0]["text"]
    return text if out["isError"] else json.loads(text)


def test_tools_are_listed_with_their_arguments(store):
    found = {t["name"]: t for t in serve.respond(store, {"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert set(found) == set(verbs.VERBS) and len(found) == 16
    assert found["why"]["inputSchema"]["properties"]["depth"] == {"type": "integer", "default": 5, "minimum": 1, "maximum": 20} and found["why"]["inputSchema"]["required"] == ["id"]
    assert found["verify"]["annotations"]["readOnlyHint"] and not found["purge"]["annotations"]["readOnlyHint"]


def test_tools_answer(store):
    assert call(store, "record", kind="node", id="extra", content={"text": "nothing of note"}) == {"id": "extra"}
    assert {r["id"] for r in call(store, "at", validAt="2024-02-01")["nodes"]["rows"]} == {"deploy", "outage", "note", "extra"}
    assert call(store, "why", id="outage")["rows"][0]["path"] == ["deploy", "outage"]
    before = store.log.count()
    found = call(store, "find", query="checkout outage", record=False)
    assert found["outcome"] == "served" and store.log.count() == before
    assert call(store, "find", query="checkout outage")["items"]["rows"] and store.log.count() == before + 1
    proposal = call(store, "extract")["proposals"]["rows"][0]["proposal"]
    assert call(store, "confirm", proposal=proposal, source="deploy", target="outage") == {"confirmed": proposal}
    assert call(store, "evidence")["rows"][0]["quote"] == "the friday deploy caused the checkout outage"
    assert call(store, "refers", mention="the friday deploy")["candidates"]["rows"][0]["id"] == "deploy"
    assert call(store, "verify")["rows"][0]["valid"] and [r["seq"] for r in call(store, "log", limit=2)["rows"]] == [6, 7]
    assert call(store, "retract", id="extra", reason="no") == {"retracted": "extra"} and call(store, "purge", id="extra", reason="no") == {"purged": "extra"}
    assert call(store, "merge", members=["note", "deploy"], canonical="deploy", reason="one") == {"canonical": "deploy"}
    assert call(store, "view", id="note")["canonical"] == "deploy" and "clusters" in call(store, "suggest")


def test_tools_refuse(store):
    assert call(store, "why", id="x", depth=21) == "depth must be between 1 and 20" and call(store, "why") == "why needs id" and "does not take" in call(store, "log", x=1)
    assert call(store, "retract", id="ghost", reason="x") == "not_found" and call(store, "nothing") == "no such verb: nothing" and "must be of type" in call(store, "log", limit=True)
    sink = io.StringIO()
    serve.tools(store, io.StringIO('{"jsonrpc":"2.0","method":"notifications/initialized"}\n\n{"id":1,"method":"ping"}\nnot json\n{"id":2,"method":"other"}\n[]\n'), sink)
    out = [json.loads(line) for line in sink.getvalue().splitlines()]
    assert [o.get("error", {}).get("code") for o in out] == [None, -32700, -32601, -32600]
    assert serve.respond(store, {"id": 3, "method": "initialize", "params": {}})["result"]["serverInfo"]["name"] == "veritrail"


def test_http_reads(store):
    server = serve.http(store, serve.Access(), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"
    get = lambda path: json.load(urllib.request.urlopen(top + path))
    try:
        assert get("/api/health") == {"ok": True}
        shown = get("/api/graph")
        assert {r["id"] for r in shown["nodes"]["rows"]} >= {"deploy", "outage"} and shown["chain"][0]["valid"] and shown["edges"]["rows"]
        assert get("/api/why?id=outage&direction=upstream")["rows"] and get("/api/view?id=deploy")["canonical"] == "deploy"
        for path, code in (("/api/at", 400), ("/api/at?validAt=never", 400), ("/api/nothing", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path)
            assert e.value.code == code
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(top + "/api/graph", method="POST", data=b""))
        assert e.value.code == 405
    finally:
        server.shutdown()


def test_http_fails_closed_beyond_the_loopback(store):
    ask = lambda access, shown=None: serve.answer(store, access, "GET", "/api/health", shown)[0]
    assert ask(serve.Access("0.0.0.0")) == 503 and ask(serve.Access("0.0.0.0", "k")) == 401 and ask(serve.Access("0.0.0.0", "k"), "no") == 401
    assert ask(serve.Access("0.0.0.0", "k"), "k") == 200 and ask(serve.Access("0.0.0.0", None, True)) == 200 and ask(serve.Access("localhost")) == 200
    assert "WARNING" in serve.Access("0.0.0.0").warning() and serve.Access().warning() is None
