"""Quoted passages of few words, or of scripts without spaces."""

from veritrail.llm import quotes


def test_short_quotes_link_inside_their_conversation(spark):
    rows = [
        (1, 0, "user", "Shall we ship it? Why not?"), (1, 1, "user", "今天天气很好。我们走吧。"), (1, 2, "user", "👍"), (1, 3, "user", "Something else to talk about."),
        (1, 4, "user", "> Why not?\nIt is late."), (1, 5, "user", "> 今天天气很好。\n好的"), (1, 6, "user", "> 👍\n> \nfine then"),
        (2, 0, "user", "Nothing is said about it here."), (2, 1, "user", "A second turn of this talk."), (2, 2, "user", "> Why not?\nSeen elsewhere."), (2, 3, "user", "> 今天天气很好。\nthat too"),
    ]
    got = quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["turn"]): (r["n_quoted"], r["n_linked"], r["parent_turn"]) for r in got}
    assert by[1, 4] == (1, 1, 0) and by[1, 5] == (1, 1, 1) and by[1, 6] == (1, 1, 2)
    # a short passage stays in its conversation, a longer one of a script without spaces does not
    assert by[2, 2] == (1, 0, 1) and by[2, 3] == (1, 1, 2)


def test_longer_passages_decide_before_short_ones(spark):
    rows = [(1, 0, "user", "Yes. Thanks. Good."), (1, 1, "user", "Yes. Thanks. Good. The cache was never warmed."), (1, 2, "user", "Well."), (1, 3, "user", "> Yes. Thanks. Good. The cache was never warmed.\nagreed")]
    got = {r["turn"]: r for r in quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[3]["n_quoted"] == 4 and got[3]["n_linked"] == 4 and got[3]["parent_turn"] == 1
