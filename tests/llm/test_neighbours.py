"""Scores depend on a text alone: not on its neighbours, its order or its partition; and equal plain restatements."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from veritrail.llm import langid, quality


def texts_of(rng, n):
    words = ["alpha", "beta", "Gamma!", "déjà", "日本", "x", "12,5", "\U0001f44d", "über-lang" * 3]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 200))) for _ in range(n)] + ["", "a", "ab", "abc", " \n"]


def model_of(rng):
    width = quality.HASHED + quality.SURFACE
    p = {"W": rng.normal(0, 1, (width, quality.HIDDEN)), "b": rng.normal(0, 1, quality.HIDDEN), "V": rng.normal(0, 1, (quality.HIDDEN, quality.GATE)), "U": rng.normal(0, 1, (quality.HIDDEN, quality.GATE)), "w": rng.normal(0, 1, quality.GATE), "c": rng.normal(0, 1, quality.HIDDEN), "d": np.asarray(0.1)}
    return {"p": p, "mean": np.full(width, 0.1, np.float32), "std": np.full(width, 0.3, np.float32), "shift": 0.2}


def features(text):
    """The passages of one text, byte by byte."""
    words, at = [], None
    padded = text + b"\n\n"
    space = {9, 10, 11, 12, 13, 32}
    for i, b in enumerate(padded):
        if b not in space and at is None:
            at = i
        if b in space and at is not None:
            words.append((at, i))
            at = None
    rows = []
    for k in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
        counts, seen = np.zeros(quality.HASHED), []
        for a, b in words[k : k + quality.PASSAGE_WORDS]:
            for i in range(a, b):
                two = (padded[i] * 0x01000193 & 0xFFFFFFFF) ^ padded[i + 1]
                counts[(two * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
                counts[(((two * 0x01000193 & 0xFFFFFFFF) ^ padded[i + 2]) * 0x85EBCA6B & 0xFFFFFFFF) >> 24] += 1
                seen.append(padded[i])
        total, inked = max(counts.sum(), 1), max(len(seen), 1)
        kinds = [lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: 33 <= b < 127 and not chr(b).isalnum(), lambda b: b >= 128]
        surface = [sum(map(kind, seen)) / inked for kind in kinds] + [((counts / total) ** 2).sum(), len(words[k : k + quality.PASSAGE_WORDS]) / inked]
        rows.append(np.concatenate([np.sqrt(counts / total), surface]) if seen else np.zeros(quality.HASHED + quality.SURFACE))
    return np.array(rows)


def forward(text, m):
    p = m["p"]
    h = np.tanh((features(text) - m["mean"]) / m["std"] @ p["W"] + p["b"])
    gate = np.array([sum(np.tanh(x @ p["V"])[j] / (1 + math.exp(-(x @ p["U"])[j])) * p["w"][j] for j in range(quality.GATE)) for x in h])
    share = np.exp(gate - gate.max())
    z = (share / share.sum()) @ h
    return 1 / (1 + math.exp(-(z @ p["c"] + p["d"] + m["shift"])))


def test_quality_scores_are_those_of_each_text():
    rng = random.Random(1)
    texts = [t.encode() for t in texts_of(rng, 60)]
    m = model_of(np.random.default_rng(2))
    together = quality.score_texts(texts, m)
    assert together.tolist() == [quality.score_texts([t], m)[0] for t in texts]
    order = rng.sample(range(len(texts)), len(texts))
    assert quality.score_texts([texts[i] for i in order], m).tolist() == together[order].tolist()
    assert np.allclose(together, [forward(t, m) for t in texts], atol=1e-5)


def test_quality_query_is_the_same_under_any_partitioning(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(texts_of(rng, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    one, many = ({r["doc_id"]: r["score"] for r in quality.score_quality(frame, labels).collect()} for frame in (docs.coalesce(1), docs.repartition(13)))
    assert one == many


def random_bayes(rng, buckets=1 << 10):
    logp = np.log(rng.dirichlet(np.ones(buckets), 3))
    return {"langs": ["aa", "bb", "cc"], "logp": logp, "prior": np.log([0.5, 0.3, 0.2])}


def bucket(points, buckets):
    h = len(points) * 0x27D4EB2F & 0xFFFFFFFF
    for p in points:
        h = (h ^ p) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
    return h % buckets


def brute_posterior(text, m):
    points = [ord(c) for c in text]
    total = m["prior"].copy()
    for order in langid.ORDERS:
        for i in range(len(points)):
            gram = (points[i : i + order] + [0] * order)[:order]
            total = total + m["logp"][:, bucket(gram, m["logp"].shape[1])]
    share = np.exp(total - total.max())
    return int(total.argmax()), share.max() / share.sum()


def test_languages_are_those_of_each_text(monkeypatch):
    rng = random.Random(4)
    texts = [t.lower() for t in texts_of(rng, 40)] + [c for c in "abcdefgh"]
    m = random_bayes(np.random.default_rng(5))
    best, share = langid.score_texts(texts, m)
    for i, t in enumerate(texts):
        (b,), (s,) = langid.score_texts([t], m)
        want = brute_posterior(t, m)
        assert (best[i], round(share[i], 9)) == (b, round(s, 9)) and b == want[0] and abs(s - want[1]) < 1e-6
    monkeypatch.setattr(langid, "CHUNK", 7)
    again = langid.score_texts(texts, m)
    assert again[0].tolist() == best.tolist() and np.allclose(again[1], share)


def test_language_model_is_the_counts_of_the_learned_rows(spark):
    """Without a sample bound the fit is plain multinomial Bayes over the rows outside the held-out fold."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdé " if i % 2 else "uvwxy ") for _ in range(30)), ("aa", "bb")[i % 2] if i % 5 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    buckets = 1 << 8
    counts, sizes = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            sizes[lang] += 1
            points = [ord(c) for c in text.lower()]
            for order in langid.ORDERS:
                counts[lang].update(bucket((points[k : k + order] + [0] * order)[:order], buckets) for k in range(len(points)))
    langs = sorted(sizes)
    logp = np.array([[math.log(counts[x][b] + 0.1) - math.log(sum(counts[x].values()) + 0.1 * buckets) for b in range(buckets)] for x in langs])
    m = {"langs": langs, "logp": logp, "prior": np.log([sizes[x] / sum(sizes.values()) for x in langs])}
    for r in langid.identify_languages(docs, buckets=buckets, rows_per_lang=10**6).collect():
        best, share = brute_posterior(rows[r["doc_id"]][1].lower(), m)
        assert r["lang_pred"] == langs[best] and abs(r["score"] - share) < 1e-5
