"""Evaluation aggregates: retrieval, blocking, extraction and linking quality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FALSE_ABSTAIN_PENALTY, FALSE_SERVE_PENALTY, RESULT_LIMIT


def judge_queries(truth: DataFrame, served: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """query_id, answerable, precision, recall, reciprocal_rank, false_serve, false_abstain, forbidden_hits.

    ``truth``: query_id, relevant, irrelevant (arrays of ids); ``served``: query_id, id, position.
    """
    lists = served.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("_s"))
    rows = truth.join(lists, "query_id", "left").withColumn("_ids", F.coalesce(F.transform("_s", lambda s: s["id"]), F.array().cast("array<string>")))
    top = F.slice("_ids", 1, k)
    hits = F.size(F.filter(top, lambda x: F.array_contains("relevant", x)))
    firsts = F.array_min(F.filter(F.transform("_ids", lambda x, i: F.when(F.array_contains("relevant", x), i + 1)), lambda i: i.isNotNull()))
    answerable = F.size("relevant") > 0
    return rows.select(
        "query_id", answerable.alias("answerable"), F.when(F.size(top) > 0, hits / F.size(top)).otherwise(0.0).alias("precision"),
        F.when(answerable, hits / F.size("relevant")).otherwise(1.0).alias("recall"), F.coalesce(1.0 / firsts, F.lit(0.0)).alias("reciprocal_rank"),
        (~answerable & (F.size("_ids") > 0)).alias("false_serve"), (answerable & (F.size("_ids") == 0)).alias("false_abstain"),
        F.size(F.array_intersect("_ids", F.coalesce("irrelevant", F.array().cast("array<string>")))).alias("forbidden_hits"),
    )


def retrieval_score(judged: DataFrame) -> DataFrame:
    """One row: precision, recall, mrr (over answerable queries), false_serves, false_abstains, forbidden_hits, score."""
    over = lambda c: F.avg(F.when(F.col("answerable"), F.col(c)))
    sums = judged.agg(
        over("precision").alias("precision"), over("recall").alias("recall"), over("reciprocal_rank").alias("mrr"), F.count_if("false_serve").alias("false_serves"),
        F.count_if("false_abstain").alias("false_abstains"), F.sum("forbidden_hits").alias("forbidden_hits"),
    )
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return sums.withColumn("score", f1 - FALSE_SERVE_PENALTY * F.col("false_serves") - FALSE_ABSTAIN_PENALTY * F.col("false_abstains"))


def lexical_only(ranked: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """Baseline: the best ``k`` of the lexical channel, without floor, graph or abstention (query_id, id, position)."""
    return ranked.where(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("position"))


def return_all(docs: DataFrame, queries: DataFrame, k: int = RESULT_LIMIT) -> DataFrame:
    """Baseline: the same first ``k`` documents (by ``at``, their place) for every query; shows that a score discriminates."""
    first = docs.orderBy("at").limit(k).withColumn("position", F.row_number().over(Window.orderBy("at")))  # k rows
    return queries.select("query_id").join(F.broadcast(first.select("id", "position")))


def sweep_verdict(scores: DataFrame, shipped: float) -> DataFrame:
    """One row for a sweep (value, score): best, best_score, shipped_score, spread and verdict (flat, agrees or prefers).

    Equal scores are no preference: a flat sweep cannot calibrate its constant.
    """
    sums = scores.agg(
        F.max_by(F.struct("value", "score"), F.struct("score", -F.col("value"))).alias("top"), F.max(F.when(F.col("value") == shipped, F.col("score"))).alias("shipped_score"),
        (F.max("score") - F.min("score")).alias("spread"),
    )
    best = sums.select(F.col("top.value").alias("best"), F.col("top.score").alias("best_score"), "shipped_score", "spread")
    return best.withColumn("verdict", F.when(F.col("spread") < 1e-9, "flat").when(F.col("best_score") - F.col("shipped_score") > 1e-9, "prefers").otherwise("agrees"))


def _ratio(part: Column | str, whole: Column | str) -> Column:
    """0 where there is nothing to measure; the counts beside it tell."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _f1(p: str, r: str) -> Column:
    return _ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))


def blocking_quality(pairs: DataFrame, truth: DataFrame, n_records: int) -> DataFrame:
    """One row: completeness, quality, reduction, f_measure (of completeness and quality).

    ``pairs`` and ``truth``: a, b with a < b.  Without a true pair completeness is 1.
    """
    kept = pairs.join(truth, ["a", "b"], "left_semi").agg(F.count("*").alias("kept"))
    totals = pairs.agg(F.count("*").alias("pairs")).join(F.broadcast(kept)).join(F.broadcast(truth.agg(F.count("*").alias("true"))))  # one row each
    every = n_records * (n_records - 1) / 2
    rates = totals.select(
        "pairs", "kept", "true", F.coalesce(F.try_divide("kept", "true"), F.lit(1.0)).alias("completeness"), _ratio("kept", "pairs").alias("quality"),
        (F.when(F.lit(every) > 0, 1 - F.try_divide(F.col("pairs"), F.lit(every))).otherwise(0.0)).alias("reduction"),
    )
    return rates.withColumn("f_measure", _f1("completeness", "quality"))


def missed_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The true pairs that blocking lost."""
    return truth.join(pairs, ["a", "b"], "left_anti").select("a", "b")


def extraction_quality(gold: DataFrame, found: DataFrame, texts: DataFrame, by: str | None = None) -> DataFrame:
    """hits, found, gold, precision, recall, silent, kept_silent, silence_rate, f1: one row, or one for each value of ``by``.

    A triple counts if it is exactly the gold one, and once: what repeats it is found
    in vain.  ``gold`` and ``found``: id, predicate, subject, object; ``texts``: id (and ``by``).
    """
    keys = ["id", "predicate", "subject", "object"]
    wanted = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    said = found.groupBy(*keys).agg(F.count("*").alias("_f"))
    each = wanted.join(said, keys, "full").groupBy("id").agg(F.count_if(F.col("_g").isNotNull() & F.col("_f").isNotNull()).alias("hits"), F.coalesce(F.sum("_f"), F.lit(0)).alias("found"), F.count("_g").alias("gold"))
    rows = texts.select("id", *([by] if by else [])).join(each, "id", "left").na.fill(0, ["hits", "found", "gold"])
    sums = rows.groupBy(*([by] if by else [])).agg(
        F.sum("hits").alias("hits"), F.sum("found").alias("found"), F.sum("gold").alias("gold"), F.count_if(F.expr("gold = 0")).alias("silent"), F.count_if(F.expr("gold = 0 and found = 0")).alias("kept_silent"),
    )
    out = sums.withColumns({"precision": _ratio("hits", "found"), "recall": _ratio("hits", "gold"), "silence_rate": _ratio("kept_silent", "silent")})
    return out.withColumn("f1", _f1("precision", "recall"))


def _linked(verdicts: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each mention: gold, its rank among the candidates, the top one, verdict and margin."""
    reached = ranked.join(gold.select("mention_id", "gold"), "mention_id").where(F.col("id") == F.col("gold")).groupBy("mention_id").agg(F.min("rank").alias("gold_rank"))
    rows = gold.join(verdicts.select("mention_id", "id", "margin", "verdict"), "mention_id", "left").join(reached, "mention_id", "left")
    real = F.col("gold").isNotNull()
    return rows.withColumns({"real": real, "right": real & (F.coalesce("gold_rank", F.lit(0)) == 1), "flagged": F.coalesce(F.col("verdict").isin("no_candidates", "weak"), F.lit(True)), "soft": F.coalesce(F.col("verdict") == "weak", F.lit(False))})


def linking_quality(verdicts: DataFrame, ranked: DataFrame, gold: DataFrame, k: int = 3, by: str | None = None) -> DataFrame:
    """n, in_store, recall_any, recall_k, top1, nil_flagged, soft_cost, margin_right, margin_wrong, separation: one row,
    or one for each value of ``by``.

    ``gold``: mention_id, gold (null where nothing is meant; and ``by``).  A NIL is flagged where
    there is no candidate or a weak one; soft_cost counts right answers flagged as weak.
    """
    rows = _linked(verdicts, ranked, gold)

    def share(what: Column, of: Column) -> Column:
        return F.try_divide(F.count_if(F.coalesce(what & of, F.lit(False))), F.count_if(of))

    real = F.col("real")
    out = rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("n"), F.count_if("real").alias("in_store"), share(F.col("gold_rank").isNotNull(), real).alias("recall_any"), share(F.col("gold_rank") <= k, real).alias("recall_k"),
        share(F.col("right"), real).alias("top1"), share(F.col("flagged"), ~real).alias("nil_flagged"), F.count_if(F.expr("right and soft")).alias("soft_cost"),
        F.expr("percentile(case when right then margin end, 0.5)").alias("margin_right"), F.expr("percentile(case when real and not right and id is not null then margin end, 0.5)").alias("margin_wrong"),
    )
    return out.withColumn("separation", F.col("margin_right") - F.col("margin_wrong"))


def nil_rules(verdicts: DataFrame, gold: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, kept, nil_rejected, total (as a rule that rejects), nil_flagged, top1, soft (as one that only flags).

    ``rules``: conditions over score, margin and type_only under which an answer is doubted;
    ``verdicts``: mention_id, id, score, margin, type_only; ``gold``: mention_id, gold.
    """
    rows = gold.join(verdicts.select("mention_id", "id", "score", "margin", "type_only"), "mention_id", "left")
    real, right = F.col("gold").isNotNull(), F.coalesce(F.col("id") == F.col("gold"), F.lit(False))
    cases = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(doubt, F.lit(False)).alias("doubt")) for name, doubt in rules.items()]))
    flat = rows.select(real.alias("real"), right.alias("right"), F.col("id").isNull().alias("none"), cases.alias("c")).select("real", "right", "none", "c.*")
    out = flat.groupBy("rule").agg(
        F.count_if(F.expr("real and right and not doubt")).alias("kept"), F.count_if(F.expr("not real and doubt")).alias("nil_rejected"), F.count_if(F.expr("not real and (none or doubt)")).alias("nil_flagged"),
        F.count_if(F.expr("real and right")).alias("top1"), F.count_if(F.expr("real and right and doubt")).alias("soft"),
    )
    return out.withColumn("total", F.col("kept") + F.col("nil_rejected"))
