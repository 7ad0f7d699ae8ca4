"""Corpus preparation: language, near-duplicates, contamination, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor
kept; all but the last return the columns of ``documents``. Every row is judged
by itself: a row whose id is null or repeated gets a number of its own while a
stage runs, so that what another row with its id holds does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwatch.llm import bin_completion, hdc_langid, postings, secret_scan, setsketch
from bookwatch.llm.common import table, written
from bookwatch.llm.queries import tokenizer

KEY = "__row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that is not null and tells all rows apart: the id, or,
    where that is null or repeated, a number above all ids."""
    ids = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    odd = written(ids.where("__id is null or __n > 1"), "odd-ids")
    if not odd.take(1):
        return docs.withColumn(KEY, F.col("doc_id"))
    above = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    rows = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    own = F.when(F.col("__n").isNull(), F.col("doc_id")).otherwise(F.monotonically_increasing_id() + above)
    return written(rows.withColumn(KEY, own).select(*docs.columns, KEY), "keyed")


def without(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], rejected: Column) -> DataFrame:
    """``docs`` without the rows that ``judge``, an operator over documents, gives
    a verdict of ``rejected``."""
    rows = keyed(docs)
    verdicts = judge(rows.withColumn("doc_id", F.col(KEY)).drop(KEY))
    gone = verdicts.where(rejected).select(F.col("doc_id").alias(KEY))
    return rows.join(gone, KEY, "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text, no letter) go."""
    return without(docs, hdc_langid.identify, F.col("lang_pred") == hdc_langid.UND)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return without(docs, setsketch.link, ~F.col("kept"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages beyond the threshold go."""
    items = table(spark, sf_dir, "benchmark")
    return without(docs, lambda d: postings.decontaminate(d, items), F.col("contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go."""
    return without(docs, secret_scan.scan, F.col("n_spans") > 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, packed into sequences."""
    return bin_completion.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination),
          ("secrets", secrets), ("packing", packing)]

#: Learned predictions and tokenizer ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
