"""Resolution over every row of part.

Parts of equal name, type and brand are one class; its id is its least p_partkey.
Pairs are made and scored between classes, and pairs inside a class, whose score is 1,
are told by the membership, so a name that many parts share needs no list of them.
A part without a name, type or brand is a class of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resolve
from ..schema import SUGGEST_MIN_SCORE
from .star import table

_ALIKE = ("p_name", "p_type", "p_brand")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in _ALIKE]) == 1, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), *_ALIKE, alone.cast("long").alias("alone"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, props, n (parts of the class), first (its four least parts)."""
    # parts of a class beyond the fourth never rank among the three best of another part
    c = _parts(spark, sf_dir).withColumn("_r", F.row_number().over(Window.partitionBy(*_ALIKE, "alone").orderBy("id")))
    c = c.groupBy(*_ALIKE, "alone").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_r") <= 4, F.col("id")))).alias("first"))
    return c.select("id", F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.create_map(F.lit("brand"), "p_brand").alias("props"), "n", "first")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class of every part."""
    p = _parts(spark, sf_dir)
    least = p.groupBy(*_ALIKE, "alone").agg(F.min("id").alias("class")).select(*[F.col(c).alias(f"_{c}") for c in (*_ALIKE, "alone")], "class")
    same = F.lit(True)
    for c in (*_ALIKE, "alone"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return p.join(least, same).select("id", "class")


def scored(records: DataFrame) -> DataFrame:
    return resolve.score_pairs(resolve.block(records, True, True), records.select("id", "name", "type", "props"))


def _sized(pairs: DataFrame, records: DataFrame) -> DataFrame:
    n = records.select("id", "n", "name")
    a, b = (n.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("name").alias(f"name_{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b")


def counted(records: DataFrame) -> DataFrame:
    """One row in pairs of parts: records, all_pairs, compared, kept (of one name), true (all of one name)."""
    choose = "n * (n - 1) div 2"
    between = _sized(resolve.block(records, True, True), records)
    between = between.agg(F.coalesce(F.sum(F.expr("n_a * n_b")), F.lit(0)).alias("far"), F.coalesce(F.sum(F.when(F.col("name_a") == F.col("name_b"), F.expr("n_a * n_b"))), F.lit(0)).alias("near"))
    keyed = records.join(resolve.keyed(records, True, True).select("id").distinct(), "id", "left_semi").agg(F.coalesce(F.sum(F.expr(choose)), F.lit(0)).alias("inside"))
    every = records.agg(F.sum("n").alias("n")).select(F.col("n").alias("records"), F.expr(choose).alias("all_pairs"))
    true = records.where("name is not null").groupBy("name").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.expr(choose)), F.lit(0)).alias("true"))
    row = every.join(F.broadcast(between)).join(F.broadcast(keyed)).join(F.broadcast(true))  # one row each
    return row.select("records", "all_pairs", F.expr("far + inside").alias("compared"), F.expr("near + inside").alias("kept"), "true")


def capped(records: DataFrame, member: DataFrame, most: int = 3) -> DataFrame:
    """a, b: pairs of parts that either end ranks among its ``most`` (three at most) best, by score, then by the other's id.

    All parts of a class rank others alike: by the best ``most + 1`` of its own class and of those near it.
    """
    pairs = scored(records).select("a", "b", "score")
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other"), "score"))
    ends = ends.unionByName(records.select(F.col("id").alias("class"), F.col("id").alias("other"), F.lit(1.0).alias("score")))
    best = Window.partitionBy("class").orderBy(F.desc("score"), "other")
    near = ends.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most + 1)
    rows = near.join(records.select(F.col("id").alias("other"), "first"), "other").select("class", "score", F.explode("first").alias("other"))
    rows = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most + 1)
    each = member.join(rows.select("class", "score", "other"), "class").where("id <> other")
    each = each.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("_r") <= most)
    return each.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def clustered(records: DataFrame, member: DataFrame, min_score: float) -> tuple[DataFrame, DataFrame]:
    """(id, cluster of every part; cluster, size, merges, weak_a, weak_b, weak_score in parts)."""
    found, sizes = resolve.cluster(records, scored(records), min_score)
    rows = member.join(found.select(F.col("id").alias("class"), "cluster"), "class").select("id", "cluster")
    # a cluster of one class is held together by pairs of score 1; its least pair is named
    parts = found.join(records.select("id", "n", "first"), "id").groupBy("cluster").agg(F.sum("n").alias("size"), F.min(F.struct("id", "first"))["first"].alias("_f"))
    both = parts.join(sizes.select("cluster", "weak_a", "weak_b", "weak_score"), "cluster")
    one = F.col("weak_score").isNull() & (F.col("size") > 1)
    return rows, both.select(
        "cluster", "size", (F.col("size") - 1).alias("merges"), F.when(one, F.col("_f")[0]).otherwise(F.col("weak_a")).alias("weak_a"),
        F.when(one, F.get("_f", F.lit(1))).otherwise(F.col("weak_b")).alias("weak_b"), F.when(one, 1.0).otherwise(F.col("weak_score")).alias("weak_score"),
    )


def suggested(records: DataFrame, member: DataFrame) -> DataFrame:
    named = records.where(F.trim("name") != "")
    return clustered(named, member, SUGGEST_MIN_SCORE)[1].where("size > 1")
