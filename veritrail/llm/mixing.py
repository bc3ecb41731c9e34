"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

The rows of a source, in a fixed pseudo-random order, form blocks of ``block_rows``.
Target weights become whole slots per period of ``Q``; block ``i`` of a source with
``W`` slots is released at slot ``floor(i Q / W)`` and due by ``ceil((i + 1) Q / W)``.
Earliest deadline first over the released blocks fills one period (a SQL fold over
its slots); as releases and deadlines repeat with the period, block ``i`` goes to
slot ``(i div W) Q + slot of block (i mod W)``.  At every slot each source is less
than one block away from its target.

More than ``MAX_SOURCES`` sources are scheduled in levels: in the order of their
weights, ``FAN`` of them each form a group that is a source of the level above, with the
sum of their weights, and block ``i`` of a source is block ``slot`` of its group.  Windows
compose as slots do, and each level is less than one of its blocks away from its target.

No row is dropped: sources last until their own end, and ``within`` tells whether a
slot lies before the first slot at which some source had run out.

Ranks inside a source come from hash buckets of bounded size (counts per bucket,
running offsets, ranks inside a bucket), so a source of any size is spread out.  A bucket
that is far too large, as rows of one id make it, is split by a hash of the whole row.

Defined cases
    null sources are a source of their own; sources without a given weight, or with
    weight 0, get one slot of each period (of their group); repeated rows are kept and placed one by one,
    rows of equal id in the order of a hash of their columns; null ids are ordered as an empty id;
    an empty table gives an empty result; other columns stay as they are, but those named
    as one of ``ADDED`` give way.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import durable

#: Sources that one level schedules at most, and sources of one group where there are more.
MAX_SOURCES = 1024
FAN = 128
BLOCK_ROWS = 32
BUCKET_ROWS = 4096
#: Columns of the result; input columns of these names are replaced.
ADDED = ("block", "release", "deadline", "slot", "in_block", "within")


def period_for(n_sources: int) -> int:
    return max(1000, 16 * n_sources)


def _order_hash() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def quotas(sources: DataFrame, period: int) -> DataFrame:
    """``sources``: _src, gain (whole number) -> _src, ix from 0, slots per period (one at least)."""
    everywhere = Window.partitionBy(F.lit(0))  # at most MAX_SOURCES rows
    g = F.greatest(F.sum("gain").over(everywhere), F.lit(1))
    spare = F.lit(period) - F.count("*").over(everywhere)
    sized = sources.select("_src", (F.row_number().over(everywhere.orderBy("_src")) - 1).alias("ix"), F.expr("1").alias("one"), (F.col("gain") * spare).alias("p"), g.alias("g"))
    floor = sized.select("_src", "ix", (F.expr("p div g") + 1).alias("floor"), F.expr("p % g").alias("left"))
    rank = F.row_number().over(everywhere.orderBy(F.desc("left"), "ix"))
    missing = F.lit(period) - F.sum("floor").over(everywhere)
    return floor.select("_src", "ix", (F.col("floor") + (rank <= missing).cast("long")).cast("long").alias("slots"))


def _fold(period: int) -> str:
    """The sources ``w`` picks slot by slot, as SQL."""
    return f"""aggregate(sequence(0, {period - 1}),
        named_struct('done', transform(w, x -> 0L), 'picked', cast(array() as array<int>)),
        (st, t) -> transform(array(array_min(filter(transform(w, (x, i) -> named_struct(
                'due', if((st.done[i] * {period}L) div x <= t, ((st.done[i] + 1) * {period}L + x - 1) div x, null), 'i', i)), y -> y.due is not null))),
            pick -> named_struct('done', transform(st.done, (d, i) -> d + if(i = pick.i, 1L, 0L)), 'picked', concat(st.picked, array(pick.i))))[0],
        st -> st.picked)"""


def schedule(quota: DataFrame, period: int) -> DataFrame:
    """One period: ix, slots, k (block of the period), slot.  Earliest deadline first over released blocks."""
    packed = quota.agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "slots"))), lambda x: x["slots"]).alias("w"))
    slots = packed.select("w", F.posexplode(F.expr(_fold(period))).alias("slot", "ix"))
    k = F.row_number().over(Window.partitionBy("ix").orderBy("slot")) - 1
    return slots.select(F.col("ix").cast("long").alias("ix"), k.cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


def _group_quotas(nodes: DataFrame, period: int) -> DataFrame:
    """``nodes``: ix, gain -> node, group, at (from 0), slots of the group's period (one at least)."""
    nodes = nodes.select(F.col("ix").alias("node"), F.expr(f"ix div {FAN}").alias("group"), F.expr(f"ix % {FAN}").alias("at"), "gain")
    mates = Window.partitionBy("group")  # at most FAN rows
    sized = nodes.withColumns({"p": F.col("gain") * (F.lit(period) - F.count("*").over(mates)), "g": F.greatest(F.sum("gain").over(mates), F.lit(1))})
    floor = sized.select("node", "group", "at", (F.expr("p div g") + 1).alias("floor"), F.expr("p % g").alias("left"))
    missing = F.lit(period) - F.sum("floor").over(mates)
    return floor.select("node", "group", "at", (F.col("floor") + (F.row_number().over(mates.orderBy(F.desc("left"), "at")) <= missing).cast("long")).cast("long").alias("slots"))


def _group_schedules(quota: DataFrame, period: int) -> DataFrame:
    """One period of every group: node, k, slot."""
    packed = quota.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "slots"))), lambda x: x["slots"]).alias("w"))
    slots = packed.select("group", F.posexplode(F.expr(_fold(period))).alias("slot", "at"))
    k = F.row_number().over(Window.partitionBy("group", "at").orderBy("slot")) - 1
    return slots.select((F.col("group") * FAN + F.col("at")).alias("node"), k.cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


def _levels(sources: DataFrame, n: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, int]]]:
    """(_src, node of the lowest level; the levels upwards: quota by node and group, schedule by node and k, period)."""
    parts = -(-n // BUCKET_ROWS)
    placed = durable(sources.repartitionByRange(parts, "gain", "_src").sortWithinPartitions("gain", "_src").select("_src", "gain", F.monotonically_increasing_id().alias("id")))
    placed = placed.select("_src", "gain", F.expr("id div 8589934592").alias("part"), F.expr("id % 8589934592").alias("inside"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row of each part
    before = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", ahead.alias("before"))
    nodes = durable(placed.join(F.broadcast(before), "part").select("_src", (F.col("before") + F.col("inside")).alias("ix"), "gain"))
    named, levels = nodes.select("_src", F.col("ix").alias("node")), []
    while n > MAX_SOURCES:
        period = period_for(FAN)
        quota = durable(_group_quotas(nodes, period))
        levels.append((quota.select("node", "group", "slots"), durable(_group_schedules(quota, period)), period))
        nodes = durable(nodes.groupBy(F.expr(f"ix div {FAN}").alias("ix")).agg(F.sum("gain").alias("gain")))
        n = -(-n // FAN)
    period = period_for(n)
    quota = durable(quotas(nodes.select(F.lpad(F.col("ix").cast("string"), 6, "0").alias("_src"), "gain"), period))
    levels.append((quota.select(F.col("ix").cast("long").alias("node"), F.lit(0).cast("long").alias("group"), "slots"), schedule(quota, period).withColumnRenamed("ix", "node"), period))
    return named, levels


def _climb(blocks: DataFrame, named: DataFrame, levels: list[tuple[DataFrame, DataFrame, int]]) -> DataFrame:
    """``blocks``: _src, block -> with release, deadline, slot."""
    now = blocks.select("block", "_src").join(named, "_src", "left").withColumns({"release": F.col("block"), "deadline": F.col("block") + 1, "slot": F.col("block")})
    now = now.select("slot", "block", "_src", "node", "release", "deadline")
    for quota, plan, period in levels:
        now = now.join(quota, "node", "left").withColumn("k", F.expr("slot % slots"))
        now = now.join(plan.withColumnRenamed("slot", "at"), ["node", "k"], "left")
        now = now.select(
            F.expr(f"(slot div slots) * {period} + at").alias("slot"), "block", "_src", F.col("group").alias("node"),
            F.expr(f"(release * {period}) div slots").alias("release"), F.expr(f"(deadline * {period} + slots - 1) div slots").alias("deadline"),
        )
    return now.drop("node")


def _mix_many(docs: DataFrame, keyed: DataFrame, weights: Mapping[str, float] | None, block_rows: int, bucket_rows: int) -> DataFrame:
    """As ``mix_sources`` for more sources than one level holds; no table of sources reaches the driver."""
    counts = durable(keyed.groupBy("_src").agg(F.count("*").alias("n")))
    if weights is None:
        sources = counts.select("_src", "n", F.floor(F.sqrt("n") * 1000).cast("long").alias("gain"))
    else:
        given = [("n" if s is None else f"s{s}", int(round(float(w) * 10**6))) for s, w in weights.items()]
        given = keyed.sparkSession.createDataFrame(given, "_src string, gain long")
        sources = counts.join(given, "_src", "left").select("_src", "n", F.coalesce("gain", F.lit(0)).cast("long").alias("gain"))
    size = counts.agg(F.count("*").alias("sources"), F.sum("n").alias("rows")).first()
    named, levels = _levels(sources, size["sources"])
    ranked = _ranked(keyed, size["rows"], block_rows, bucket_rows)
    last = counts.select("_src", F.expr(f"(n + {block_rows - 1}) div {block_rows}").alias("blocks"))
    gap = _climb(last.select("_src", F.col("blocks").alias("block")), named, levels).agg(F.min("slot").alias("gap")).first()["gap"]
    blocks = last.select("_src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    at = _climb(blocks, named, levels).select("_src", F.col("block").alias("_block"), "release", "deadline", "slot")
    return ranked.join(at, ["_src", "_block"]).select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], F.col("_block").alias("block"), "release", "deadline", "slot", F.col("_in_block").alias("in_block"),
        (F.col("slot") < F.lit(gap)).alias("within"),
    )


def _ranked(keyed: DataFrame, total: int, block_rows: int, bucket_rows: int) -> DataFrame:
    """``keyed`` with the place of each row in its source, as _block and _in_block."""
    buckets = max(1, -(-total // bucket_rows))
    keyed = keyed.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long"))
    # far too large ones: a thousandth of all rows each, so 1,024 of them at most, and none where ids are distinct
    large = keyed.groupBy("_src", "_bucket").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= max(8 * bucket_rows, total // 1024))
    large = large.select("_src", "_bucket", F.ceil(F.col("_rows") / bucket_rows).alias("_parts"))
    keyed = keyed.join(F.broadcast(large), ["_src", "_bucket"], "left").withColumn("_sub", F.coalesce(F.pmod("_tie", "_parts"), F.lit(0)))
    sized = keyed.groupBy("_src", "_bucket", "_sub").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_src").orderBy("_bucket", "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sized.select("_src", "_bucket", "_sub", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_src", "_bucket", "_sub").orderBy("_order", "row.doc_id", "_tie")) - 1
    ranked = keyed.withColumn("_inside", inside).join(offsets.hint("shuffle_merge"), ["_src", "_bucket", "_sub"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_inside"))
    return ranked.withColumns({"_block": F.expr(f"_rank div {block_rows}"), "_in_block": F.expr(f"_rank % {block_rows}")})


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` plus block, release, deadline, slot, in_block, within.

    ``weights`` gives target weights by source; without it the target of a source is
    the square root of its number of rows.  Order by (slot, in_block) to read the mix.
    """
    spark = docs.sparkSession
    tie = F.xxhash64(*docs.columns)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_src"), _order_hash().alias("_order"), tie.alias("_tie"))
    counts = {r["_src"]: r["n"] for r in keyed.groupBy("_src").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        return _mix_many(docs, keyed, weights, block_rows, bucket_rows)
    total = sum(counts.values())
    period = period_for(len(counts))
    if weights is None:
        gains = {s: int((n**0.5) * 1000) for s, n in counts.items()}
    else:
        gains = {s: int(round(float(weights.get(s[1:], 0.0) if s != "n" else weights.get(None, 0.0)) * 10**6)) for s in counts}
    shape = T.StructType([T.StructField("_src", T.StringType()), T.StructField("gain", T.LongType()), T.StructField("n", T.LongType())])
    sources = spark.createDataFrame([(s, gains[s], counts[s]) for s in sorted(counts)], shape)
    quota = quotas(sources, period)
    plan = schedule(quota, period).join(quota, "ix")
    # the first slot at which a source lacks the block that the schedule wants
    last = sources.select("_src", F.expr(f"(n + {block_rows - 1}) div {block_rows}").alias("blocks"))
    gap = plan.join(last, "_src").where(F.expr("k = blocks % slots")).agg(F.min(F.expr(f"(blocks div slots) * {period} + slot")).alias("gap"))
    gap = gap.select(F.coalesce("gap", F.lit(0)).alias("gap")).first()["gap"]

    ranked = _ranked(keyed, total, block_rows, bucket_rows)
    # one period of the schedule has at most 16 x MAX_SOURCES rows
    ranked = ranked.join(F.broadcast(quota.select("_src", "slots")), "_src").withColumn("_k", F.expr("_block % slots"))
    placed = ranked.join(F.broadcast(plan.select("_src", F.col("k").alias("_k"), F.col("slot").alias("_slot"))), ["_src", "_k"])
    return placed.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], F.col("_block").alias("block"),
        F.expr(f"(_block * {period}) div slots").alias("release"), F.expr(f"((_block + 1) * {period} + slots - 1) div slots").alias("deadline"),
        F.expr(f"(_block div slots) * {period} + _slot").alias("slot"), F.col("_in_block").alias("in_block"),
        F.expr(f"(_block div slots) * {period} + _slot < {gap}").alias("within"),
    )


def write_order(mixed: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """The mix dealt by ranges of slots, in order from part to part and inside each."""
    parts = max(1, -(-mixed.count() // rows_per_part))
    return mixed.repartitionByRange(parts, "slot").sortWithinPartitions("slot", "in_block")


ORACLE = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce('s' || source, 'n') AS src, count(*) AS n, floor(sqrt(count(*)) * 1000)::BIGINT AS gain FROM documents GROUP BY 1),
size AS (SELECT count(*) AS s, greatest(1000, 16 * count(*))::BIGINT AS q, greatest(sum(gain), 1)::BIGINT AS g FROM counts),
share AS (
  SELECT src, n, row_number() OVER (ORDER BY src) - 1 AS ix, 1 + (gain * (q - s)) // g AS fl, (gain * (q - s)) % g AS rest, q FROM counts, size),
quota AS (
  SELECT src, n, ix, q, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, ix) <= q - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS slots FROM share),
weights AS (SELECT list(slots ORDER BY ix) AS w, any_value(q) AS q FROM quota),
run AS (
  SELECT -1::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS done, -1::BIGINT AS pick, w, q FROM weights
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i - 1 = p THEN 1 ELSE 0 END), p, w, q
  FROM (
    SELECT r.*, (list_min(list_filter(list_transform(range(len(w)), lambda i: CASE WHEN (done[i + 1] * q) // w[i + 1] <= t + 1
        THEN (((done[i + 1] + 1) * q + w[i + 1] - 1) // w[i + 1]) * 100000 + i END), lambda y: y IS NOT NULL)) % 100000)::BIGINT AS p
    FROM run r WHERE t + 1 < q)),
sched AS (SELECT pick AS ix, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM run WHERE t >= 0),
gap AS (
  SELECT min((((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) // slots) * q + slot) AS gap
  FROM quota JOIN sched USING (ix) WHERE k = ((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS}) % slots),
ranked AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
    row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM documents),
blocks AS (SELECT doc_id, source, src, rank // {BLOCK_ROWS} AS block, rank % {BLOCK_ROWS} AS in_block FROM ranked)
SELECT doc_id, source, block::BIGINT AS block, ((block * q) // slots)::BIGINT AS release, (((block + 1) * q + slots - 1) // slots)::BIGINT AS deadline,
  ((block // slots) * q + slot)::BIGINT AS slot, in_block::BIGINT AS in_block, ((block // slots) * q + slot) < gap AS within
FROM blocks JOIN quota USING (src) JOIN sched ON sched.ix = quota.ix AND sched.k = block % slots, gap"""
