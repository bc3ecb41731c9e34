"""Extraction of whole tables: repeated texts, and texts that sit in one partition."""

import pyarrow as pa

from veritrail.operators import extract

TEXTS = ["the fault caused the outage", None, "", "we never led to a failure, yet the spike influenced the policy", "nothing here", "the Fault CAUSED 𝒜 the outage", "the decision set a precedent for the contract"]


def test_a_text_that_repeats_in_a_batch_is_read_once(monkeypatch):
    read = []
    plain = extract.extract_text
    monkeypatch.setattr(extract, "extract_text", lambda t, rules: read.append(t) or plain(t, rules))
    got = extract.found_in(pa.array(TEXTS * 50, pa.string())).to_pylist()
    assert sorted(read) == sorted(t for t in TEXTS if t is not None)
    assert [[tuple(r.values()) for r in rows or []] for rows in got[:7]] == [
        [tuple({"start": x[0], "end": x[1]} if isinstance(x, tuple) else x for x in r) for r in plain(t)] for t in TEXTS
    ]
    assert got == got[:7] * 50


def test_one_partition_is_dealt_to_all_cores(spark):
    records = spark.createDataFrame([(str(i), TEXTS[0]) for i in range(400)], "id string, text string").coalesce(1)
    asserted, suppressed = extract.relations(records)
    assert asserted.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and asserted.count() == 400 and suppressed.count() == 0
