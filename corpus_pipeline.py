"""A training-corpus pipeline of five stages, each one operator of ``veritrail.llm``.

Every stage reads all rows that its predecessor kept and returns the columns of
``documents``; the last adds where each row stands in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritrail.llm.common import durable, read_table, small_batches
from veritrail.llm.decontaminate import decontaminate
from veritrail.llm.minhash import drop_near_duplicates
from veritrail.llm.mixing import mix_sources, write_order
from veritrail.llm.quality import keep_good
from veritrail.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    small_batches(spark)
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; stray windows are cut out of the others."""
    small_batches(spark)
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by their kind."""
    small_batches(spark)
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are interleaved to their target weights; order by (slot, in_block)."""
    return write_order(durable(mix_sources(docs)))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", benchmark), ("secrets", secrets), ("mix", mix)]

#: The classifier and the samples are not SQL; tests/llm holds run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
