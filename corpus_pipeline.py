"""A corpus pipeline of five stages: language, toxicity, near duplicates, repeated passages, packing.

Every stage but the last returns rows of its input with all their columns, whatever these are called; an empty table stays one. Rows are judged
one by one: rows that repeat, in part or whole, and rows with one doc_id or none stand for themselves except where a stage says otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlmill.llm import langid, packing, recompress, simhash, toxicity
from crawlmill.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (a null or empty text has none) or like no language of the corpus; without any labelled row, all."""
    return langid.identified(docs, langid.learn(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from the labels of the documents that are left. Without toxic and clean labels none goes; null
    and empty texts are scored as texts without any term."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest doc_id, nulls last, and of several such the first by hash of text.

    Null, empty and blank texts are one group. Of rows that are equal in doc_id and text one stays."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that also occur in a document with a smaller id; n_chars follows the text.

    A null doc_id counts as larger than any; rows with one doc_id cut nothing from each other; a null text stays null, and a text of which
    nothing is left stays as an empty one."""
    return recompress.cut_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining texts, each a sequence of a power of two tokens. A null or empty text is the end token alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents, each but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
