"""Quotation linking against a plain restatement, on generated conversations."""

import random
import re

from veritrail.llm import quotes

SHAPE = "conv_id long, turn long, role string, text string, own string, p string, part int, base int"
SAY = [f"{a} {b} {c}." for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "three") for c in ("red", "blue", "green")]


def conversations(rng, n):
    rows = []
    for conv in range(n):
        turns = sorted(rng.sample(range(60), rng.randrange(1, 14)))
        said = []
        for t in turns:
            lines = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                source = rng.choice(said) if said and rng.random() < 0.8 else rng.choice(SAY)
                lines.append(">" * rng.randrange(1, 3) + " " + source.upper())
            own = [rng.choice(SAY) for _ in range(rng.randrange(0, 3))]
            said += own
            rows.append((conv, t, "user", "\n".join(lines + [" ".join(own)]), "x", "y", 1, 2))
    return rows


def norm(sentence):
    return " ".join(re.findall(r"[a-z0-9]+", sentence.lower()))


def read(text):
    own, quoted = [], []
    for line in text.split("\n"):
        marks = re.match(r"(>*) ?(.*)", line)
        quoted += [(len(marks[1]), norm(marks[2]))] if marks[1] else []
        own += [] if marks[1] else [norm(s) for s in line.split(".") if norm(s)]
    return own, quoted


def brute(rows):
    parsed = {(c, t): read(text) for c, t, _, text, *_ in rows}
    out = {}
    for (c, t), (_, quoted) in sorted(parsed.items()):
        links = []
        for level, what in quoted:
            here = [u for (d, u), (own, _) in parsed.items() if d == c and what in own]
            firsts = sorted((d, min(u for (e, u), (own, _) in parsed.items() if e == d and what in own)) for d in {d for (d, _), (own, _) in parsed.items() if what in own})
            if here and min(here) < t:
                links.append((level, (c, min(here))))
            else:
                links.append((level, next(((d, u) for d, u in firsts if d != c), None)))
        votes = [spot[1] for level, spot in links if spot and level == 1 and spot[0] == c and spot[1] < t]
        earlier = [u for d, u in parsed if d == c and u < t]
        parent = max(set(votes), key=lambda u: (votes.count(u), u)) if votes else max(earlier, default=None)
        thread, depth = (t, 0) if parent is None else (out[c, parent][3], out[c, parent][4] + 1)
        out[c, t] = (len(quoted), sum(spot is not None for _, spot in links), parent, thread, depth)
    return out


def test_links_and_threads_equal_the_restatement(spark):
    rng = random.Random(11)
    rows = conversations(rng, 25)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {}
    for parts in (before, "5"):  # long conversations over several ranges too
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            linked = quotes.link_conversations(spark.createDataFrame(rows + rows[:3], SHAPE)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(linked) == len(rows) + 3
        got[parts] = {(r["conv_id"], r["turn"]): (r["n_quoted"], r["n_linked"], r["parent_turn"], r["thread_turn"], r["depth"]) for r in linked}
        assert not any(line.startswith(">") for r in linked for line in r["text"].split("\n"))
    assert got[before] == got["5"] == brute(rows)
    assert any(v[4] < len([1 for c, _ in got["5"] if c == k[0]]) - 1 and v[1] for k, v in got["5"].items())


def test_gaps_and_long_texts(spark):
    long_ = "word " * 40_000
    rows = [(1, 10, "a", "first message of all", *"xy", 1, 2), (1, 30, "b", long_, *"xy", 1, 2), (1, 90, "a", "> first message of all\nand an answer", *"xy", 1, 2), (1, 95, "b", "thanks", *"xy", 1, 2)]
    linked = quotes.link_conversations(spark.createDataFrame(rows, SHAPE))
    got = {r["turn"]: r for r in linked.collect()}
    assert {t: r["parent_turn"] for t, r in got.items()} == {10: None, 30: 10, 90: 10, 95: 90}
    assert {t: r["depth"] for t, r in got.items()} == {10: 0, 30: 1, 90: 1, 95: 2} and got[30]["text"] == long_
    stretches = quotes.assemble(linked, span=50).orderBy("stretch").collect()
    assert [[m["turn"] for m in r["messages"]] for r in stretches] == [[10, 30], [90, 95]] and stretches[1]["messages"][0]["text"] == "and an answer"
    assert [r["turn"] for r in quotes.reply_ordered(linked).collect()] == [10, 30, 90, 95]
