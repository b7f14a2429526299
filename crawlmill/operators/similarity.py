"""Exact and near duplicates of page texts by SimHash over word shingles, with banded candidates.

The hash of a shingle is the first 64 bits of its MD5, so fingerprints are the same in every engine."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.operators.graph import stored

c = F.col
SHINGLE = 3
THRESHOLD = 90
MOST_LISTED = 50


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Runs of `size` words; of fewer words one run; none for no words."""

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
        return F.when(F.size(w) >= size, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words(text)), runs), F.lit(0))


def _half(hash_: Column, start: int) -> Column:
    return F.conv(F.substring(hash_, start, 8), 16, 10).cast("long")


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, simhash: votes of all shingles' bits, one bit set where more shingles have it than not. A text without words has 0.

    The votes are 64 sums of a grouped aggregate, with partial sums before the shuffle."""
    each = docs.select(key, F.explode_outer(shingles(c(text))).alias("s")).withColumn("h", F.md5("s"))
    each = each.select(key, _half(c("h"), 1).alias("hi"), _half(c("h"), 9).alias("lo"))
    vote = lambda half, bit: F.sum(F.when(F.shiftright(half, bit).bitwiseAND(F.lit(1)) == 1, 1).when(half.isNotNull(), -1))
    votes = each.groupBy(key).agg(*(vote(c("hi"), b).alias(f"h{b}") for b in range(32)), *(vote(c("lo"), b).alias(f"l{b}") for b in range(32)))
    packed = lambda p: sum((F.when(c(f"{p}{b}") > 0, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(1, 32)), F.when(c(f"{p}0") > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(key, F.shiftleft(packed("h"), 32).bitwiseOR(packed("l")).alias("simhash"))


def _blocks(most: int, n: int) -> tuple[int, int]:
    """(blocks, equal): fingerprints that differ in `most` bits at most agree in `equal` of so many blocks at least.

    More equal blocks make longer keys and more rows. The fewest are taken for which a key of random fingerprints holds few; results are the same."""
    equal = 1
    while equal < 5 and n >> 64 * equal // (most + equal) > 1:
        equal += 1
    return most + equal, equal


def near_pairs(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """f, g (f < g), distance: pairs of distinct fingerprints (a column f) that differ in as many bits as the threshold allows."""
    most = math.ceil((100 - threshold) * 64 / 100)
    blocks, equal = _blocks(most, distinct.count())
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, some in enumerate(itertools.combinations(range(blocks), equal)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in some)
        keys.append(F.struct(F.lit(k).alias("k"), c("f").bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("v")))
    x, y = (distinct.select(c("f").alias(name), F.explode(F.array(*keys)).alias("key")).select(name, "key.k", "key.v") for name in "fg")
    apart = F.bit_count(c("f").bitwiseXOR(c("g")))
    # both sides are many times what Spark expects of them: never broadcast
    met = x.hint("merge").join(y, ["k", "v"]).where((c("f") < c("g")) & (apart <= most))
    return met.select("f", "g", apart.alias("distance")).distinct()


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """key, closest_similarity (percent), near_duplicate_count, near_duplicates (up to 50 keys): documents with near duplicates.

    Equal texts raise the similarity but don't count as near duplicates. Documents with one fingerprint and one text are a class that shares
    all three facts, so copies are never paired with one another; what is listed of a class or fingerprint is its first keys only."""
    some = docs.select(c(key).alias("k"), F.md5(F.coalesce(text, F.lit(""))).alias("hash"))
    prints = stored(fingerprints(docs, key, text).withColumnRenamed(key, "k").join(some, "k").withColumnRenamed("simhash", "f"), "prints")
    classes = prints.groupBy("f", "hash").agg(F.count("*").alias("own"))
    totals = stored(classes.groupBy("f").agg(F.sum("own").alias("n")), "totals")
    first = lambda df, by, most: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("k"))).where(c("_r") <= most).drop("_r")
    # of a class's first 50 keys at most 50 are among a fingerprint's first 100, so 50 of other classes are there
    heads = first(first(prints, ["f", "hash"], MOST_LISTED), ["f"], 2 * MOST_LISTED)
    heads = stored(heads.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("k", "hash"))).alias("heads")), "heads")
    pairs = near_pairs(totals.select("f"), threshold)
    both = stored(pairs.unionByName(pairs.select(c("g").alias("f"), c("f").alias("g"), "distance")), "pairs")
    others = both.join(totals.select(c("f").alias("g"), "n"), "g").groupBy("f").agg(F.sum("n").alias("far"), F.min("distance").alias("nearest"))
    listed = both.join(heads.select(c("f").alias("g"), F.explode(F.slice("heads", 1, MOST_LISTED)).alias("x")), "g").select("f", c("x.k").alias("k"))
    listed = first(listed, ["f"], MOST_LISTED).groupBy("f").agg(F.collect_list("k").alias("far_keys"))
    told = classes.join(totals, "f").join(heads, "f").join(others, "f", "left").join(listed, "f", "left")
    same = F.transform(F.filter("heads", lambda x: x["hash"] != c("hash")), lambda x: x["k"])
    keys = F.sort_array(F.concat(same, F.coalesce("far_keys", F.slice(same, 1, 0))))
    count = F.coalesce("far", F.lit(0)) + c("n") - c("own")
    distance = F.when(c("n") > 1, 0).otherwise(c("nearest"))
    told = told.select("f", "hash", F.floor((64 - distance) * 100 / 64).cast("int").alias("closest_similarity"), count.alias("near_duplicate_count"), F.slice(keys, 1, MOST_LISTED).alias("near_duplicates"))
    out = prints.join(told.where("near_duplicate_count > 0"), ["f", "hash"])
    return out.select(c("k").alias(key), "closest_similarity", "near_duplicate_count", "near_duplicates")
