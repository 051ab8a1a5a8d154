"""A corpus made ready for training: five stages over ``documents``, each one of the llm operators.

Every stage reads all that the one before kept, written as Parquet; all but the
last return the columns of ``documents``. Columns beyond ``doc_id`` and ``text`` travel
along whatever their names; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siglex.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from siglex.llm.queries import tokenizer_path
from siglex.llm.scratch import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go.

    Null and empty texts have the score of the bias alone; equal texts, repeated rows
    among them, stay or go together; null ids count like others.
    """
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; the documents stay.

    Null texts stay null, an empty text has one empty line, whose key is too short to
    go. Rows of equal id and text count as one document, others as one each.
    """
    return line_dedup.without_repeated_lines(docs, min_documents=10, min_chars=1)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    It is the one of least id, ties by a hash of the text; null ids come last. Of
    repeated rows one stays. Null texts and texts without a word are near nothing: the
    rows stay.
    """
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Repeated rows stay or go together; null and empty texts hold no passage, and null or
    empty items are found nowhere.
    """
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: one row for each piece of each document.

    Null and empty texts are the end id alone; repeated rows are packed each.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier and the tokeniser are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
