"""The corpus pipeline: five stages over documents, each (spark, docs, sf_dir) -> DataFrame.

Every stage but the last returns the columns of documents.  Between stages the caller may write and read the rows; ``run``
chains them directly; both give the same rows.

Edge cases of the whole run: an empty table gives an empty plan; null and blank texts have no language and go first; rows
with a null id pass as long as their text does, and count as one document, the last, where duplicates are sought; rows of one
id stay or go together there, and each is packed; a null source conflicts with nothing; labels may be empty, then nothing is
toxic.  Columns beyond those of documents stay until the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casevane.llm import langid, neardup, packing, repeats, toxicity
from casevane.llm.common import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.known_language(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out."""
    columns = docs.columns
    kind = docs.schema["n_chars"].dataType
    return repeats.remove_repeats(docs).withColumn("n_chars", F.length("text").cast(kind)).select(*columns)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of training sequences: a row for each piece of each document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("best_fit_packing", packing_plan),
]

#: SQL cannot express the fitted models, hence the rows after them; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
