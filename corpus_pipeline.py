"""A training-data pipeline over ``documents``: five stages, each an operator of ``cellforge.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of ``documents``, whatever other columns there are and however they are
named. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm.common import stored, table
from cellforge.llm.language_id import keep_recognised
from cellforge.llm.mixing import mixed
from cellforge.llm.ngram_jaccard import keep_one_each
from cellforge.llm.packing import cut, pack
from cellforge.llm.secret_scan import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises. A text that is null, empty or without a letter goes; repeated rows stay or go together."""
    return keep_recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect, the one with the smallest id. Rows that share an id stay or go together; rows without an id, and texts without words, stay."""
    return keep_one_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked credentials cut out of the texts; n_chars follows. A null text stays null."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target rates, in a global shuffle. A null source is a source; rows with equal ids are repeated alike."""
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place; repeated documents are packed each for itself, and a null text as an empty one."""
    return pack(cut(docs))


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("secret_scan", secrets), ("source_mix", mixture), ("best_fit_packing", packed)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
