"""Workspaces, the cost of a store, and forests of large components."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail import measure
from veritrail.errors import EngineError
from veritrail.operators import resolve
from veritrail.sources import workspace


def test_workspaces_are_named_or_found_and_never_guessed(tmp_path):
    inner = tmp_path / "project" / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / "project" / "pyproject.toml").write_text("")
    assert workspace.resolve({}, inner) == ((tmp_path / "project").resolve(), "marker")
    assert workspace.resolve({workspace.VARIABLE: str(tmp_path)}, inner) == (tmp_path.resolve(), "variable")
    for env, start in (({}, None), ({workspace.VARIABLE: ""}, None)):
        with pytest.raises(EngineError, match="workspace_unresolved"):
            workspace.resolve(env, start)
    path = workspace.prepare(workspace.resolve({}, inner))
    assert path.parent.joinpath(".gitignore").read_text() == "*\n" and path.name == "store"


def test_costs_are_measured(spark, tmp_path):
    (row,) = measure.measure(spark, str(tmp_path), [20])
    assert row["n"] == 20 and min(row["append_ms"], row["load_ms"], row["purge_ms"], row["log_kb"]) > 0


def test_forests_of_large_components_equal_those_of_one_task(spark):
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}
    pairs |= {(100 + i, 101 + i) for i in range(20)}
    frame = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", rng.choice([0.7, 0.75, 0.8, 0.9])) for a, b in sorted(pairs)], "a string, b string, score double")
    ids = spark.createDataFrame([(f"n{i:03d}",) for i in [*range(60), *range(100, 130)]], "id string")
    small, large = (sorted(map(tuple, resolve.cluster(ids, frame, 0.7, n)[1].collect())) for n in (10**6, 5))
    assert small == large and any(r[2] > 15 for r in small)
    assert resolve.cap_by_similarity(frame, 0).count() == frame.count() == resolve.cap_by_similarity(frame, None).count()
    assert resolve.cap_by_similarity(frame.withColumn("score", F.lit(0.5)), 1).count() < frame.count()
