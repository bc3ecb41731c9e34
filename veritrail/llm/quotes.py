"""Chat formatting: quotation linking and reply-ordered conversations.

A line that begins with ``>`` marks is quoted; its level is the number of marks.
Runs of lines of one level form a block, blocks are cut into sentences, and the
normalised sentences (lower case, letters and digits only; as they are where they
have none) are the passages that are hashed.  The original of a quoted passage is the
first message of the same conversation that says it itself (unquoted, in an
earlier turn), else the first message of the corpus that does, the quoting
message excepted.  Short passages (fewer than ``MIN_WORDS`` words, and fewer than
``MIN_SIGNS`` letters of a script without spaces) say too little to be followed into other
conversations and are linked inside their own.  First occurrences are minima by hash, so
a passage that many messages share is pre-aggregated and never paired with itself.

A message answers the earlier message of its conversation from which most of its
level-1 passages come (short ones decide between equals, then the latest); without one, the latest
earlier message; without that, it begins a thread.  Messages are dealt by ranges of
(conv_id, turn), so a conversation of any length is spread out, and what a range has to know
of those before it is a row for each of its two border conversations.  Runs of
messages that answer the one before them are counted through; only those that answer another by a
quote are followed to their first message by pointer doubling.  A conversation in reply order is its
rows by (conv_id, thread_turn, turn): turns of a thread follow what they answer.
``reply_ordered`` deals them so, ``assemble`` makes rows of whole stretches of a thread.

Defined cases
    null and empty texts are empty messages without quotes; a text without quoted
    lines stays as it is; attribution lines ("... wrote:") go with the quote that
    follows them; rows that repeat a (conv_id, turn) are one message for links and
    stay rows of their own; a null conv_id or turn has no links and begins a thread;
    passages that only occur quoted have no original; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, lookup, releasing

MIN_WORDS = 3
MIN_SIGNS = 6
_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_WROTE = re.compile(r"^.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])(?![。！？])")
_WORD = re.compile(r"[^\W_]+")
#: Thai to Myanmar, Khmer, kana and Han: letters of scripts that put no spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def passages(block: str) -> list[tuple[bytes, bool]]:
    """(hash, short or not) of the normalised sentences of a block."""
    out = []
    for sentence in _SENTENCE.split(block):
        words = _WORD.findall(sentence.lower())
        said = " ".join(words or sentence.split())
        if said:
            short = len(words) < MIN_WORDS and len(_UNSPACED.findall(said)) < MIN_SIGNS
            out.append((hashlib.md5(said.encode("utf-8", "surrogatepass")).digest(), short))
    return out


def parse(text: str | None) -> tuple[str, list[tuple[bytes, bool]], list[tuple[int, bytes, bool]], int]:
    """(text without quotes, its passages, quoted (level, *passage), quoted lines)."""
    if not text:
        return "", [], [], 0
    if ">" not in text:
        return text, passages(" ".join(text.split("\n"))), [], 0
    kept, quoted, blocks, n = [], [], [], 0
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        if marks is None:
            kept.append(line)
            continue
        n += 1
        level = marks[1].count(">")
        if kept and _WROTE.match(kept[-1]):
            kept.pop()
        if blocks and blocks[-1][0] == level and blocks[-1][2] == len(kept):
            blocks[-1][1].append(line[marks.end() :])
        else:
            blocks.append((level, [line[marks.end() :]], len(kept)))
    for level, lines, _ in blocks:
        quoted += [(level, *p) for p in passages(" ".join(lines))]
    own = "\n".join(kept).strip("\n") if n else text
    return own, passages(" ".join(kept)), quoted, n


_PASSAGE = [("hash", pa.binary()), ("short", pa.bool_())]
_SHAPE = pa.struct([("own", pa.string()), ("said", pa.list_(pa.struct(_PASSAGE))), ("quoted", pa.list_(pa.struct([("level", pa.int32()), *_PASSAGE]))), ("lines", pa.int64())])
_PARSED = "struct<own:string,said:array<struct<hash:binary,short:boolean>>,quoted:array<struct<level:int,hash:binary,short:boolean>>,lines:bigint>"


def _parser(text: Column) -> Column:
    @F.arrow_udf(_PARSED)
    @releasing
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = []
            for text in column:
                own, said, quoted, lines = parse(text.as_py())
                rows.append({"own": own, "said": [{"hash": h, "short": s} for h, s in said], "quoted": [{"level": a, "hash": h, "short": s} for a, h, s in quoted], "lines": lines})
            yield pa.array(rows, _SHAPE)

    return run(text)


def _quotes() -> Column:
    """Whether the text may hold a quoted line; the others need no parser."""
    return F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))


def link_quotes(said: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, short, from_conv, from_turn of every quoted passage (null without an original).

    ``said``: conv_id, turn, hash, short; ``asked``: the same and level.
    """
    wanted = said.where("not short").join(asked.where("not short").select("hash").distinct(), "hash", "left_semi").select("conv_id", "turn", "hash", "short")
    inner = said.where("short").join(asked.where("short").select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    wanted = wanted.unionByName(inner)
    here = durable(wanted.groupBy("conv_id", "hash").agg(F.min("turn").alias("here_turn"), F.first("short").alias("_short")))
    # the two first conversations: the second serves where the first is the quoting message itself
    spots = here.where("not _short").select("hash", F.struct(F.col("conv_id").alias("c"), F.col("here_turn").alias("t")).alias("spot"))
    first = durable(spots.groupBy("hash").agg(F.min("spot").alias("first")))
    second = spots.join(first, "hash").where("spot <> first").groupBy("hash").agg(F.min("spot").alias("second"))
    linked = asked.join(here.drop("_short"), ["conv_id", "hash"], "left")
    linked = lookup(linked, first.join(second, "hash", "left"), ["hash"])
    inside = F.col("here_turn") < F.col("turn")
    other = F.when(~F.col("first.c").eqNullSafe(F.col("conv_id")), F.col("first")).otherwise(F.col("second"))
    spot = F.when(inside, F.struct(F.col("conv_id").alias("c"), F.col("here_turn").alias("t"))).otherwise(other)
    return linked.select("conv_id", "turn", "level", "hash", "short", spot["c"].alias("from_conv"), spot["t"].alias("from_turn"))


def _placed(messages: DataFrame) -> DataFrame:
    """``messages``: conv_id, turn (distinct), answered -> also before (the latest earlier turn), rank, and the
    turn and rank of the latest message from here backwards that answers by a quote or has none before it."""
    ranges = messages.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    dealt = durable(ranges.select("*", F.spark_partition_id().alias("part")))
    inside = Window.partitionBy("part", "conv_id").orderBy("turn")  # a range at most
    rows = dealt.withColumns({"_lag": F.lag("turn").over(inside), "_n": F.row_number().over(inside)})
    through = inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(F.col("answered").isNotNull(), F.struct("turn", "_n"))
    rows = rows.withColumn("_mark", F.max(marked).over(through))
    ends = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("_size"), F.max("turn").alias("_last"), F.min("turn").alias("_first"), F.max(F.when(F.col("answered").isNotNull(), F.col("turn"))).alias("_marked"))
    long = ends.groupBy("conv_id").agg(F.count("*").alias("_parts")).where("_parts > 1").select("conv_id")
    # two conversations of each range at most
    ends = durable(ends.join(long, "conv_id", "left_semi"))
    upto = Window.partitionBy("conv_id").orderBy("part")
    last_marks = ends.select("conv_id", "part", F.col("_marked").alias("turn")).where("turn is not null")
    mark_rank = rows.join(F.broadcast(last_marks), ["conv_id", "part", "turn"], "left_semi").select("conv_id", "part", F.col("_n").alias("_mark_n"))
    ends = ends.join(F.broadcast(mark_rank), ["conv_id", "part"], "left")
    ends = ends.withColumn("_offset", F.coalesce(F.sum("_size").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spot = F.when(F.col("_marked").isNotNull(), F.struct(F.col("_marked").alias("turn"), (F.col("_offset") + F.col("_mark_n")).alias("rank")))
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "part", "_offset", F.max("_last").over(before).alias("_carry_last"), F.max(spot).over(before).alias("_carry_mark"), F.min("_first").over(before).alias("_carry_first"))
    rows = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    offset = F.coalesce("_offset", F.lit(0))
    first = F.coalesce("_carry_first", F.min("turn").over(Window.partitionBy("part", "conv_id")))
    own = F.when(F.col("_mark").isNotNull(), F.struct(F.col("_mark.turn").alias("turn"), (offset + F.col("_mark._n")).alias("rank")))
    base = F.coalesce(own, F.col("_carry_mark"), F.struct(first.alias("turn"), F.lit(1).cast("long").alias("rank")))
    return rows.select("conv_id", "turn", "answered", F.coalesce("_lag", "_carry_last").alias("before"), (offset + F.col("_n")).alias("rank"), base.alias("base"))


def _threads(placed: DataFrame) -> DataFrame:
    """conv_id, turn, parent, thread_turn, depth of the placed messages."""
    steps = placed.select("conv_id", "turn", F.col("base.turn").alias("base"), (F.col("rank") - F.col("base.rank")).alias("steps"), "answered", "before")
    marks = steps.where("answered is not null").select("conv_id", F.col("turn").alias("mark"), F.col("answered").alias("turn"))
    # where a quote leads: to the base of the answered message, one step and its own steps away
    met = steps.select("conv_id", "turn", "base", "steps")
    now = durable(marks.join(met, ["conv_id", "turn"]).select("conv_id", "mark", F.col("base").alias("up"), (F.col("steps") + 1).alias("depth")))
    while not now.join(now.select("conv_id", F.col("mark").alias("up")), ["conv_id", "up"], "left_semi").isEmpty():
        ahead = now.select("conv_id", F.col("mark").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        moved = now.join(ahead, ["conv_id", "up"], "left")
        now = durable(moved.select("conv_id", "mark", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")))
    out = steps.join(now.select("conv_id", F.col("mark").alias("base"), F.col("up").alias("_up"), F.col("depth").alias("_depth")), ["conv_id", "base"], "left")
    return out.select("conv_id", "turn", F.coalesce("answered", "before").alias("parent_turn"), F.coalesce("_up", "base").alias("thread_turn"), (F.col("steps") + F.coalesce("_depth", F.lit(0))).alias("depth"))


def link_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted_lines, n_quoted, n_linked, max_level,
    parent_turn, thread_turn, depth of every row."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    named = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = durable(rows.where(_quotes()).select("conv_id", "turn", "text").distinct().select("conv_id", "turn", _parser(F.col("text"))["quoted"].alias("quoted")))
    asked = quoting.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*")
    said = named.select("conv_id", "turn", F.explode(_parser(F.col("text"))["said"]).alias("p")).select("conv_id", "turn", "p.*")
    links = durable(link_quotes(said if not asked.isEmpty() else said.limit(0), asked))
    votes = links.where((F.col("level") == 1) & (F.col("from_conv") == F.col("conv_id")) & (F.col("from_turn") < F.col("turn"))).groupBy("conv_id", "turn", "from_turn").agg(F.count_if(~F.col("short")).alias("n"), F.count_if("short").alias("n_short"))
    answered = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "n_short", "from_turn"))["from_turn"].alias("answered"))
    messages = named.select("conv_id", "turn").distinct().join(answered, ["conv_id", "turn"], "left")
    placed = durable(_placed(messages.select("conv_id", "turn", F.col("answered").cast(conversations.schema["turn"].dataType).alias("answered"))))
    linked = links.groupBy("conv_id", "turn").agg(F.count("from_turn").alias("n_linked"))
    table = _threads(placed).join(linked, ["conv_id", "turn"], "left")
    parsed = rows.select("conv_id", "turn", "role", "text", _parser(F.when(_quotes(), F.col("text"))).alias("p"))
    out = lookup(parsed, table, ["conv_id", "turn"])
    quoted = F.col("p.lines") > 0
    return out.select(
        "conv_id", "turn", "role", F.when(quoted, F.col("p.own")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.col("p.lines").alias("n_quoted_lines"),
        F.size("p.quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_max(F.transform("p.quoted", lambda q: q["level"])), F.lit(0)).alias("max_level"),
        "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def reply_ordered(linked: DataFrame) -> DataFrame:
    """Linked rows in reply order, dealt by ranges: written, they are conversations from end to end."""
    return linked.repartitionByRange("conv_id", "thread_turn", "turn").sortWithinPartitions("conv_id", "thread_turn", "turn")


def assemble(linked: DataFrame, span: int = 256) -> DataFrame:
    """conv_id, thread_turn, stretch, messages (turn, role, parent_turn, text, copies; by turn): the reply-ordered
    conversations, read by (conv_id, thread_turn, stretch).

    A stretch holds ``span`` turn numbers of a thread, so no row grows with its conversation;
    equal rows are one message with a number of copies.  Rows without a conversation or turn are in none.
    """
    known = linked.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    each = known.groupBy("conv_id", "thread_turn", "turn", "role", "parent_turn", "text").agg(F.count("*").alias("copies"))
    told = F.array_sort(F.collect_list(F.struct("turn", "role", "parent_turn", "text", "copies")))
    return each.groupBy("conv_id", "thread_turn", F.expr(f"turn div {span}").alias("stretch")).agg(told.alias("messages"))
