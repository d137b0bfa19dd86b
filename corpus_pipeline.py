"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Results of each stage, for rows that are special (details are in the operators' docstrings):

* ``language``: null texts and texts without a letter go, long texts are scored whole.  Without any labelled row nothing can be judged
  and all rows stay.  Repeated rows are judged alike, so all stay or all go.
* ``near_duplicates``: of each group of like texts the row with the smallest id stays (null ids last; of equal ids, by text hash), of
  repeated rows one.  Empty texts are one group.
* ``decontaminate``: rows are judged by their own text, also where ids repeat or are null; null and empty texts stay.
* ``pii``: null and empty texts stay as they are; ``n_chars`` follows the text.
* ``mix``: the documents with ``size`` (words), ``source_size``, ``target``, ``taken`` (words that the mix takes, repeats counted) and
  ``whole`` (full repetitions).  A null source is a source, ranked last; an empty text takes nothing.

All stages but the last return the columns they got, in order, whatever further columns there are; the last replaces columns named like its
results.  An empty table runs through every stage and stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm import op1_language, op4_mixing, op8_decontaminate, op9_pii, op10_simhash
from medspan.session import remove, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = op1_language.train(docs.where(~op1_language.held_out(F.col("doc_id"))))
    return op1_language.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash over shingles of five words, similarity of 0.8 or more."""
    return op10_simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return op8_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` follows the text."""
    return op9_pii.redacted(docs, op9_pii.learn(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with how many words of each the mix takes."""
    return op4_mixing.mixed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pii", redact), ("mix", mix)]

#: Trained models, SimHash components and EM are beyond SQL; tests/llm/test_pipeline.py compares run() with plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is removed once the next one is written, the last one stays."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
