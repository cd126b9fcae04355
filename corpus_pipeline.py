"""The corpus pipeline: documents to packed token ids, in five stages, each calling one operator.

Each stage takes (spark, docs, sf_dir) and works on all of ``docs``, whatever other columns it has. All but the last
return rows of the columns of ``docs``. Null columns, repeated rows and empty tables are allowed in every stage; an
empty table gives no rows. What a stage does with them is said below, and in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import cut
from lodestrata.llm.decontaminate import drop_contaminated
from lodestrata.llm.host_quality import keep_good
from lodestrata.llm.mixing import mixed_documents
from lodestrata.llm.near_dedup import keep_one
from lodestrata.llm.token_pack import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their host's verdict rejects go.

    A null text has no words and goes; a null source is a host of its own; rows of equal text and source stay or go
    together.
    """
    return keep_good(docs, F.col("source"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one of the least doc_id, of rows that repeat one.

    A null text is an empty one; rows without doc_id stay only where a class has no other; one id with unrelated texts
    keeps each.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and all rows of the same text with them.

    A null text holds nothing and stays, as does a text without words; items without words match nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated or cut to the words it takes.

    A document without words is taken 0 times; a null source is a source of its own, the last; rows that tie are
    interchangeable, so repeated rows are taken in any order.
    """
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the packed format, read back: a row a document of the stage before, in ascending doc_id order.

    Rows that share an id, as the mix's copies do, are ordered by their text's digest; those without one stand first.
    """
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: SQL can't express the sampling, the seeded selection and the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
