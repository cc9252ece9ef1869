"""Corpus pipeline: language, quality, near-duplicates, repeated spans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of documents. ``run`` writes each stage's result to the shared checkpoint folder and
reads it again, so that no stage repeats the work of another one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexsense.llm import language, neardup, packing, quality, substrings
from lexsense.llm.scratch import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs.select(*COLUMNS))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs.select(*COLUMNS))


def _repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs.select(*COLUMNS))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", _language), ("quality", _quality), ("near_duplicates", _near_duplicates),
          ("repeated_spans", _repeated_spans), ("packing", _packing)]

ORACLE_SQL = None  # learned models and a tokenizer: tested against a step-by-step version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
