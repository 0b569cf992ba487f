"""The corpus pipeline: five stages, each the full work of one operator on what the stage before it kept.

1. ``language_id`` drops documents without a letter and documents no language of which holds half;
2. ``near_duplicates`` keeps one row of each component of near duplicates: that of least id, of rows without an id
   only if the component has no other, and of rows that share this id the first;
3. ``decontamination`` drops documents that hold a window of a benchmark item;
4. ``personal_data`` replaces personal data in the texts and counts their characters anew;
5. ``packing`` packs what is left into sequences and returns its pieces.

All stages but the last return the columns of ``documents``, also those that have the name of an operator's result.
SQL cannot express the learned stages, so
``ORACLE_SQL`` is None and the tests compare with a brute-force version.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folio_spark.llm import decontam, jaccard, langid, packing, pii
from folio_spark.llm.common import numbered, shared_folder, spare_name, written
from folio_spark.llm.queries import CAPACITY, END_ID, fold, word_tokenizer

#: Share of a document's letters that its language has at least.
LEAST_SHARE = 0.5


def kept_apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The needed columns beside one that holds all others, and a function that brings them back.

    An operator replaces columns that have the name of a result; a document's own columns of such names stay.
    """
    others = [c for c in docs.columns if c not in needed]
    if not others:
        return docs, lambda made: made.select(*docs.columns)
    held = spare_name(docs, "others")
    rows = docs.select(*needed, F.struct(*others).alias(held))
    columns = [F.col(c) if c in needed else F.col(held)[c].alias(c) for c in docs.columns]
    return rows, lambda made: made.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, restored = kept_apart(docs, "doc_id", "text", "lang")
    model = langid.learn(rows, fold(F.col("doc_id"), 4) != 2)
    judged = langid.label(rows, model, spans=False)
    return restored(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Ids may be missing, repeated or shared by different texts, so rows are told apart by numbers.
    rows, number = numbered(docs)
    groups = jaccard.near_components(rows, id_col=number).select(F.col("doc_id").alias(number), "component_id")
    # A minimum combines before the shuffle, so a large component doesn't meet in one task.
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col(number).alias("number"))
    placed = written(rows.select(number, "doc_id").join(groups, number), "placed")
    first = placed.groupBy("component_id").agg(F.min(order).alias("first"))
    # Most components are single rows; only the rows to drop meet the texts again. Their number grows with the
    # table, so they are merged at every size and never broadcast.
    dropped = placed.join(first.select(F.col("first.number").alias(number)), number, "left_anti").select(number)
    return rows.join(dropped.hint("merge"), number, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    rows, restored = kept_apart(docs, "doc_id", "text")
    return restored(decontam.find_contamination(rows, items).where("n_hit = 0"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, restored = kept_apart(docs, "doc_id", "text", "n_chars")
    spans = pii.annotate(rows, pii.learn(rows))
    text = pii.redacted(F.col("text"), F.col("pii_spans"))
    return restored(
        spans.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    )


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer(), END_ID, CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
