"""Sharding by rendezvous hashing: each record goes to the shard whose score, from the record's key and the shard's number, is highest.

A new shard takes only the records on which its score beats the others', so no record moves between old shards. Weights follow the
logarithmic method: score = -weight / ln(u) with u uniform in (0, 1). DataFrame functions only.

Defined results: a null text has size 1 and the checksum of no bytes; a null key is the key '' ; repeated rows go to one shard and take
slots one after another. Slots follow a hash of the key, then the key (null last), then checksum and size, of which SQL says nothing: they
depend on nothing else, neither on the order of the rows nor on how they lie in files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.llm.common import written

SHARDS = 8
#: Repeated rows that are dealt out by one task at once.
BLOCK = 1 << 16
#: 13 hexadecimal digits of MD5: a whole number under 2^52, exact as a double.
DIGITS = 13


def hashed(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the shard with the highest score; of equal scores the lowest number."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(s: int) -> Column:
        u = (hashed(F.concat(text, F.lit(f"/{s}"))) + F.lit(0.5)) / F.lit(float(1 << 4 * DIGITS))
        return -F.lit(float(weights[s])) / F.log(u)

    best = F.greatest(*(F.struct(score(s).alias("score"), F.lit(-s).alias("shard")) for s in range(len(weights)))) if len(weights) > 1 else F.struct(F.lit(0).alias("shard"))
    return (-best["shard"]).cast("int")


def shards(docs: DataFrame, weights: list[float] | None = None, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight 1).

    Rows alike in key, size and checksum are counted before they are shuffled and dealt out again at the end, so a key repeated without end
    loads no task. The rest is cut into ranges of the order that slots follow, down to checksum and size, so one key with many texts is cut
    too; slots are counted within the rows of a shard in a range, behind those of the ranges before. parts: how many ranges (None: as many as Spark shuffles to)."""
    weights = weights or [1.0] * SHARDS
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    slim = docs.select(doc.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    by = ["h", F.col("doc_id").asc_nulls_last(), "text_crc32", "size"]
    ranged = alike.withColumn("h", hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).repartitionByRange(*([] if parts is None else [parts]), *by).withColumn("part", F.spark_partition_id())
    alike = written(ranged.withColumns({"shard": shard_of(F.col("doc_id"), weights), "grown_shard": shard_of(F.col("doc_id"), [*weights, 1.0])}), "shards")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = alike.groupBy("shard", "part").agg(F.sum("n").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("within", F.coalesce(F.sum("n").over(order), F.lit(0))).join(F.broadcast(base), ["shard", "part"])  # shards times ranges rows
    placed = placed.withColumn("first", F.col("base") + F.col("within"))
    single, many = placed.where("n = 1"), placed.where("n > 1")
    blocks = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("block"))
    # blocks of one repeated row go to many tasks
    blocks = blocks.repartition("shard", "first", "block").select("*", F.explode(F.sequence("block", F.least(F.col("n"), F.col("block") + BLOCK) - 1)).alias("more"))
    out = lambda df, slot: df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")
    return out(single, F.col("first")).unionByName(out(blocks, F.col("first") + F.col("more")))
