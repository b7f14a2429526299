"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.llm import langid, media, nbest, packing, quality, recompress, sharding, simhash, toxicity, urlmodel
from crawlmill.llm.common import table


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.featured(media.kept(table(spark, sf_dir, "documents")), tiles=True).drop("error")


def op3_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.removed(table(spark, sf_dir, "documents"))


def op6_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.judge(table(spark, sf_dir, "pages"))


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = langid.remainder(F.col("doc_id"), 4)
    return langid.predict(docs, langid.learn(docs.where(part != 2)), part == 2)


def op8_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = langid.remainder(F.col("doc_id"), 5)
    return toxicity.scored(docs, toxicity.learn(docs, labels, part != 0), part == 0)


def op9_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_distribution_divergence, op2_media_columns, op3_nbest_segmentation, op4_power_of_two_packing, op5_recompression_dedup, op6_url_language_model, op7_hyperdimensional_language, op8_deobfuscated_toxicity, op9_simhash_balls, op10_rendezvous_sharding)}
