import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.errors import EngineError
from veritrail.functions import text
from veritrail.functions.canonical import UNDEFINED, canonical_json, canonicalise, content_digest, content_digest_column, record_digest, record_digest_column
from veritrail.functions.instants import instant, parse_instant


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"b": 1, "a": None}, '{"a":null,"b":1}'), ([1.0, 1e21, 1e-7, 0.1, -0.0, 123456789012345680000.0], "[1,1e+21,1e-7,0.1,0,123456789012345680000]"),
        ({"é": " \n\"", "\U0001f44d": 1, "דּ": 2}, '{"é":" \\n\\"","\U0001f44d":1,"דּ":2}'), (True, "true"), ({"gone": UNDEFINED}, "{}"), (1.5e300, "1.5e+300"), (0.000001, "0.000001"),
    ],
)
def test_canonical_form(value, want):
    assert canonical_json(value) == want


@pytest.mark.parametrize(("value", "code"), [(math.nan, "non_finite_number"), ([math.inf], "non_finite_number"), (UNDEFINED, "undefined_root"), ([UNDEFINED], "unsupported_type"), ({"a": b"x"}, "unsupported_type")])
def test_canonical_refuses(value, code):
    with pytest.raises(EngineError) as e:
        canonical_json(value)
    assert e.value.code == code


@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3)))
def test_canonical_round_trip(value):
    assert canonical_json(json.loads(canonical_json(value))) == canonical_json(value)


def test_digest_columns_equal_the_functions(spark):
    rows = [("node", "i\"d", 1, None, {"a": [1, 2.5]}, {"recordedAt": "x\n"}, "salt"), ("edge", "é", 2, "ab", "text", {}, "s2")]
    made = [(k, i, s, p, canonical_json(c), canonical_json(m), salt) for k, i, s, p, c, m, salt in rows]
    df = spark.createDataFrame(made, "kind string, id string, seq long, prev string, content string, meta string, salt string").withColumn("cd", content_digest_column(F.col("salt"), F.col("content")))
    got = df.select("cd", record_digest_column(*(F.col(c) for c in ("kind", "id", "seq", "prev", "cd", "meta"))).alias("d")).collect()
    for r, (k, i, s, p, c, m, salt) in zip(got, rows, strict=True):
        assert r["cd"] == content_digest(salt, c) and r["d"] == record_digest(k, i, s, p, r["cd"], m)
    assert [r[0] for r in spark.createDataFrame([('{"b":1e0,"a":[ ]}',), ("nope",), (None,)], "t string").select(canonicalise("t")).collect()] == ['{"a":[],"b":1}', None, None]


INSTANTS = [
    ("2024-01-01", None), ("", "malformed_temporal_value"), ("not-a-date", "malformed_temporal_value"), ("2026-13-45T00:00:00Z", "malformed_temporal_value"), ("2024-02-30", "malformed_temporal_value"),
    ("2024-02-29", None), ("2026-02-29", "malformed_temporal_value"), ("2024-01-01T10:00:00", "ambiguous_timezone"), (" 2024-01-01T10:00:00.123Z ", None), ("2024-01-01T10:00:00+05:30", None),
    ("2024-01-01 10:00:00Z", "malformed_temporal_value"), ("2024-01-01T25:00:00Z", "malformed_temporal_value"), ("2024-01-01T24:00:00Z", None), ("2024-01-01Tnoon:Z", "malformed_temporal_value"),
]


def test_instants(spark):
    df = spark.createDataFrame([(v,) for v, _ in INSTANTS], "v string").select("v", parse_instant(F.col("v")).alias("p"))
    for r, (v, reason) in zip(df.select("v", "p.reason", F.unix_millis("p.ts").alias("ms")).collect(), INSTANTS, strict=True):
        assert r["reason"] == reason, v
        if reason is None:
            assert r["ms"] == round(instant(v).timestamp() * 1000), v
        else:
            with pytest.raises(EngineError) as e:
                instant(v)
            assert e.value.code == reason


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names))).first()[0]


def test_text_keys(spark):
    assert one(spark, text.phonetic, "pfister") == "P123" and one(spark, text.phonetic, "Tymczak") == "T520" and one(spark, text.phonetic, "lloyd") == "L430" and one(spark, text.phonetic, "12") == ""
    assert one(spark, text.name_tokens, "Re_do the-API/v2 x") == ["the", "api"] and one(spark, text.name_tokens, "a b") == ["ab"] and one(spark, text.name_tokens, " ") == []
    assert one(spark, lambda c: text.block_keys(c, F.lit("Node"), True), "Deploy gate") == ["tok:depl", "tok:gate", "type:node:depl", "pho:D140", "pho:G300"]
    assert one(spark, text.block_keys, "") == ["nameless:"]
    assert one(spark, text.trigrams, "ab") == [" ab", "ab "] and one(spark, text.trigrams, "!") == []
    assert one(spark, text.infer_type, "the payment Services of ours") == "service" and one(spark, text.infer_type, "nothing") is None
    assert one(spark, text.acronyms, "the SLO, a CDN2 and The X") == ["SLO", "CDN2"]


def test_acronyms_are_written_out_only_where_spelled():
    assert text.initialism("SLO", "service level objective doc") == ["service", "level", "objective"] and text.initialism("SLO", "some other thing") is None
    assert text.expand_against("the SLO doc", "service level objective doc") == "the service level objective doc" and text.expand_against("the SLO doc", "cdn") == "the SLO doc"
