"""The corpus pipeline: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result to the shared folder as Parquet and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, near_dedup, packing, suffix_dedup
from .store import Scratch, by_ids

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in no learned language, go; rows without an id stay.

    ``docs`` must have the column ``lang``, from which the classifier learns.
    """
    scratch = Scratch(spark, "stage1")
    found = langid.identified(docs, langid.train(docs), refuse=True)
    rejected = scratch.table(found.where(F.col("lang_pred") == "und").select("doc_id").where("doc_id is not null").distinct(), "rejected")
    return by_ids(docs, rejected, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays; rows that share its id stay with it."""
    scratch = Scratch(spark, "stage2")
    gone = scratch.table(near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return by_ids(docs, gone, "left_anti").select(*docs.columns)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay at their first place only; n_chars follows the text."""
    scratch = Scratch(spark, "stage3")
    spans = scratch.table(suffix_dedup.repeated_spans(docs), "spans")
    cut = suffix_dedup.without_repeats(docs, spans)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without_contaminated(docs, leaks).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences, a row for each piece."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_array", suffix_array),
    ("decontamination", decontamination),
    ("best_fit", best_fit),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        after = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs
