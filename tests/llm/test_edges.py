"""Awkward inputs of operators and of the whole pipeline."""

import collections
import math
import random
import re

import numpy as np
import pytest

from veritrail.llm import minhash, mixing, secrets, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long, _data string, same string, row int, hits int, key string, found string, found_ string, _new string, _live string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * 2, 1, 2, *["x"] * 5) for i, t, s in rows], DOC)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_vectors_of_extreme_size_and_clashing_names(spark):
    base = np.random.default_rng(1).normal(size=16)
    rows = [(1, (base * 1e200).tolist()), (2, (base * 1e-200).tolist()), (3, base.tolist()), (4, (-base).tolist()), (5, (base * 1e300).tolist())]
    shape = "vec_id long, embedding array<double>, label int, same string, cid long, root long, n long, dim int, v string, links long, component_id string"
    frame = spark.createDataFrame([(i, v, 0, "x", 1, 1, 1, 1, "x", 1, "x") for i, v in rows], shape)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(frame).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4)}


def test_rows_of_one_id_are_spread_and_kept(spark):
    frame = docs_of(spark, [(None if i % 3 else i, f"t{i}", "hot") for i in range(3000)])
    rows = mixing.mix_sources(frame, block_rows=4, bucket_rows=20).collect()
    assert sorted(r["text"] for r in rows) == sorted(f"t{i}" for i in range(3000))
    assert len({(r["slot"], r["in_block"]) for r in rows}) == 3000 and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)


def test_written_mix_is_in_order(spark):
    mixed = mixing.write_order(mixing.mix_sources(docs_of(spark, [(i, "t", f"s{i % 3}") for i in range(500)])), rows_per_part=100)
    assert [(r["slot"], r["in_block"]) for r in mixed.collect()] == sorted((r["slot"], r["in_block"]) for r in mixed.collect()) and mixed.rdd.getNumPartitions() > 1


def test_shingle_frequencies_are_exact(spark):
    rng = random.Random(2)
    common = prose(rng, 12)
    texts = [prose(rng, 40) + (" " + common if i % 2 else "") for i in range(400)] + [None, ""]
    frame = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    df = collections.Counter(h for t in texts for h in set(minhash.weighted_sets([(t or "").encode()], None)[0].tolist()))
    share = max(minhash.SHARE, sum(df.values()) / len(texts) / minhash.HEAVY)
    got = minhash.fit_idf(frame)
    want = {h: 1 + math.log(len(texts) / n) / math.log(1 / share) for h, n in df.items() if n > share * len(texts)}
    assert dict(zip(got["hashes"].tolist(), got["weights"].tolist(), strict=True)) == pytest.approx(want) and len(want) >= 8
    weights = minhash.idf_of(np.array([*got["hashes"][:3], 7], np.uint64), got)
    assert weights.tolist() == pytest.approx([*got["weights"][:3], 2.0])


def test_samples_agree_as_often_as_sets_are_alike():
    """Over many pairs the share of equal samples is the weighted Jaccard similarity, in long texts too."""
    rng = np.random.default_rng(3)
    gaps = []
    for n in (50, 500, 60_000):
        for alike in (0.5, 0.8):
            size = max(1, 3_000 // n)
            for _ in range(size):
                k = int(n * 2 * alike / (1 + alike))
                both, a, b = (rng.integers(1, 1 << 63, m, dtype=np.uint64) for m in (k, n - k, n - k))
                sets = [np.unique(np.concatenate([both, x])) for x in (a, b)]
                weights = {h: w for h, w in zip(np.unique(np.concatenate(sets)).tolist(), rng.uniform(1, 2, 2 * n), strict=False)}
                pair = [(s, np.array([weights[h] for h in s.tolist()])) for s in sets]
                rows = minhash.samples(np.concatenate(sets), np.concatenate([w for _, w in pair]), np.array([len(s) for s in sets]))
                gaps.append(((rows[0] == rows[1]).mean(), minhash.weighted_jaccard(*pair)))
    gaps = np.array(gaps)
    assert abs((gaps[:, 0] - gaps[:, 1]).mean()) < 0.02 and np.abs(gaps[:, 0] - gaps[:, 1]).max() < 0.45


def test_every_pair_of_a_band_is_checked_on_demand(spark):
    """A band of many texts that are all alike but for a word: one class with and without the bound on equal samples."""
    rng = random.Random(4)
    base = prose(rng, 200).split()
    texts = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"e{i}"
        texts.append(" ".join(w))
    frame = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for least in (minhash.AGREE, 0):
        got = minhash.near_duplicate_classes(frame, least_agree=least).collect()
        assert {r["class_id"] for r in got} == {0} and {r["n_class"] for r in got} == {300}


def test_extra_kinds_of_secrets_against_a_restatement(spark):
    values = {"github": "ghp_" + "aB3" * 12, "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "slack": "xoxb-1234567890-abcdef", "pem": "-----BEGIN EC PRIVATE KEY-----"}
    texts = [f"é {k} 👍 {v} end" for k, v in values.items()] + [f"x {values['slack']} y"] * 3 + ["plain"]
    frame = docs_of(spark, [(i, t, f"s{i}") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(frame).collect()}
    for i, (kind, value) in enumerate(values.items()):
        at = re.search(re.escape(value), texts[i]).start()
        want = "" if kind == "slack" else f"{kind}:{at}:{at + len(value)}"  # four owners hold the slack value: an example
        assert got[i] == want
    assert got[7] == ""


@pytest.fixture()
def folder(spark, tmp_path):
    def write(rows, labels):
        docs_of(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, None), (None, "")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_pipeline_on_awkward_documents(spark, folder):
    import corpus_pipeline

    rng = random.Random(5)
    odd = [None, "", " \n", "é", "word " * 30_000, "x" * 100_000, "\U0001f44d " * 40]
    rows = [(i, t, None if i % 2 else "s") for i, t in enumerate(odd)] + [(5, "tied", "s"), (5, "tied", "s"), (None, "nameless", "s"), (None, None, None)]
    rows += [(100 + i, prose(rng, 60, 5000), "s") for i in range(30)]
    labels = [(i, 1, 0) for i in range(140)] + [(None, 0, 0), (3, None, None)]
    got = corpus_pipeline.run(spark, folder(rows, labels)).collect()  # one class of labels: every text is good
    texts = collections.Counter(r["text"] for r in got)
    assert texts == collections.Counter({t for _, t, _ in rows}) and all(r["key"] == "x" for r in got)


def test_pipeline_on_empty_tables(spark, folder):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, folder([], [])).count() == 0
