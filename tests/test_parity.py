"""Registered queries against their SQL twins on the smallest tables."""

import glob
import os

import pytest

from veritrail.plans import queries as plans

DATA = "/root/testdata/sf0.001"
NAMES = (
    "state_at_edges", "belief_diff", "temporal_rejected", "effective_until", "retract_cascade", "chain_verify_tampered", "purge_view", "chain_report", "retrieve_served", "channel_margins",
    "block_pairs", "trigram_similarity", "phonetic_keys", "resolve_id", "merge_conflicts", "extract_relations", "extract_suppressed", "link_verdict", "span_reasons", "window_counts",
)


def plain(frame):
    def cell(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(cell(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    assert plain(plans.queries()[name](spark, DATA).toPandas()) == plain(db.sql(plans.oracle_sql()[name]).df())


def test_every_sql_twin_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
