"""More sources than one level schedules."""

import pytest

from veritrail.llm import mixing


def frame(spark, n_sources, rows):
    return spark.createDataFrame([(i, f"d{i % n_sources}" if i % n_sources else None) for i in range(rows)], "doc_id long, source string")


@pytest.mark.parametrize("weights", [None, {"d1": 0.5, "d2": 0.25, None: 0.125}])
def test_any_number_of_sources_is_placed(spark, weights):
    rows = mixing.mix_sources(frame(spark, 1300, 4000), weights, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(4000)) and len({(r["slot"], r["in_block"]) for r in rows}) == 4000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows) and any(r["within"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["block"], r["in_block"], r["slot"]))
    assert len(by) == 1300
    for got in by.values():
        got.sort()
        assert [x[:2] for x in got] == [(i // 2, i % 2) for i in range(len(got))] and [x[2] for x in got] == sorted(x[2] for x in got)
    # within ends where the first source runs out: until then no slot is left free
    inside = {r["slot"] for r in rows if r["within"]}
    assert inside == set(range(len(inside)))


def test_three_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 4)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = mixing.mix_sources(frame(spark, 30, 900), block_rows=2).collect()
    assert len({(r["slot"], r["in_block"]) for r in rows}) == 900 and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    inside = {r["slot"] for r in rows if r["within"]}
    assert inside == set(range(len(inside))) and inside
