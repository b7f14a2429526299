"""Near copies of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found without loss.

SimHash balls come first: fingerprints of the same shingles that differ in 3 bits or fewer meet in their balls (simhash.links), and what they
link is verified on whole sets. Down to a similarity of 0.8 fingerprints of 64 bits differ in about ten, up to twenty bits, more than balls
reach, so an exact check follows for what SimHash hasn't put in one group: sets are joined by
prefixes. Shingles are put in one global order; if two sets are that similar, the first |A| - ceil(0.8 |A|) + 1 shingles of each share
one at least. What meets there is cut by bounds that hold for every similar pair (sizes, shingles shared by the prefixes), and what remains
is verified on whole sets. The order decides the cost only: shingles that are common in a sample come last, the most common at the very end.

Places in the prefixes bound it too: if a shingle is the first that two sets share in the global order, they share no more than what either has
from there on. Every similar pair meets in its first shared shingle, so a meeting that the places rule out is left aside.

Groups are what verified pairs connect. A group of many near copies doesn't cost its square: a first pass of the check compares what meets in a shingle
with one of it only, the one that has the shingle earliest (a text that others were made from has few shingles of its own before it); a second
pass compares what isn't in one group yet.

Words, shingles and hashes are those of the fingerprints (lower case in ASCII, 64-bit xxHash). Texts of fewer than five words are one shingle;
null texts and texts without words are one group. Equal sets of shingles are one node, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, discard, pieces, texts, written
from crawlmill.llm.simhash import SEED, bits, components, links

SHINGLE = 5
#: One document of so many is in the sample that tells common shingles, one so common in it is ordered last; at most so many are told.
SAMPLE, COMMON, MOST_COMMON = 8, 4, 500_000
#: Bytes of text that a worker turns into shingles at once.
AT_ONCE = 1 << 20
#: Shares of all shingles that are shuffled one after another.
PASSES = 4

c = F.col


def shingles(text: bytes | None) -> np.ndarray:
    """The hashes of the shingles of a text, each once, sorted."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))) if len(words) >= SHINGLE else {b" ".join(words)}
    return np.unique(np.fromiter((xxh(p, SEED) for p in parts), np.uint64, len(parts)))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("near copies", dict)
    yield from pieces(batches, AT_ONCE)
    begin("near copies", dict)  # freed memory goes back before the stages without Python


def _node(of: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as xxh

    return int(np.array([xxh(of.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _lists(of: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*of, np.zeros(0, np.uint64)]).view(np.int64)))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in the sample, sorted, and how many documents of it hold them."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            for text in texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["shingle"])

    counts = sample.mapInArrow(hashed, "shingle long").groupBy("shingle").count().where(c("count") >= COMMON)
    found = counts.orderBy(c("count").desc(), "shingle").limit(MOST_COMMON).toArrow()
    which, count = found.column("shingle").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(which)
    return which[order], count[order]


def prefix(of: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The shingles of a set that a similar set must share one of."""
    if not len(of):
        return of
    rank = np.zeros(len(of), np.int64)
    if len(which):
        at = np.minimum(np.searchsorted(which, of), len(which) - 1)
        rank = np.where(which[at] == of, count[at], 0)
    return of[np.lexsort((of, rank))][: len(of) - -(-4 * len(of) // 5) + 1]


def prefixed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, size, fp (SimHash of the set), prefix: a row for each document."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sets = [shingles(t) for t in texts(batch)]
            heads = _lists([prefix(s, *known.value) for s in sets])
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bits(s) for s in sets], pa.int64()), heads]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "fp", "prefix"])

    return docs.select(c("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(cut, "doc_id long, text_hash long, node long, size int, fp long, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles of the wanted (text_hash)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sets = [shingles(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], ["node", "shingles"])

    chosen = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash", "left_semi")
    return chosen.select("text").mapInArrow(cut, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _similar(shared):
    return 9 * shared >= 4 * (c("a_size") + c("b_size"))


def _near_enough(a, b):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _outside(size):
    """Shingles of a set outside its prefix."""
    return F.ceil(4 * size / 5) - 1


def _with_both(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
    """pairs with a_<what> and b_<what> of their nodes."""
    for side in "ab":
        pairs = pairs.join(of.select(c("node").alias(side), c(what).alias(f"{side}_{what}")).hint("merge"), side)
    return pairs


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b, a_size, b_size) that are similar, as a, b. nodes: node, text_hash, prefix.

    Prefixes, a fifth of the sets, are compared first: what two sets share lies in both prefixes or outside one of them. Only sets of pairs
    that this leaves possible are sent for."""
    ends = lambda some: some.select(c("a").alias("node")).unionByName(some.select(c("b").alias("node"))).distinct()
    prefixes = written(nodes.join(ends(pairs), "node", "left_semi").select("node", "prefix"), "ends")
    shared = F.size(F.array_intersect("a_prefix", "b_prefix")) + F.greatest(_outside(c("a_size")), _outside(c("b_size")))
    possible = written(_with_both(pairs, prefixes, "prefix").where(_similar(shared)).select("a", "b", "a_size", "b_size"), "possible")
    discard(prefixes)
    wanted = written(nodes.join(ends(possible), "node", "left_semi").select("text_hash"), "wanted")  # a table of its own: if it is small, texts need no shuffle
    sets = written(whole_sets(docs, wanted), "sets")
    found = written(_with_both(possible, sets, "shingles").where(_similar(F.size(F.array_intersect("a_shingles", "b_shingles")))).select("a", "b"), "links")
    discard(possible, sets, wanted)
    return found


def _far_enough(a: str, b: str):
    """Whether two sets may be similar if what they meet in is the first shingle they share; a, b: what their columns' names begin with."""
    size = c(f"{a}size") + c(f"{b}size")
    return 9 * F.least(c(f"{a}size") - c(f"{a}at"), c(f"{b}size") - c(f"{b}at")) >= 4 * size


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    """a, b (a < b), a_size, b_size of meetings whose nodes are named a and b, each pair once."""
    first = c(f"{a}node") < c(f"{b}node")
    one = lambda x, y, what: F.when(first, c(f"{x}{what}")).otherwise(c(f"{y}{what}"))
    return met.select(one(a, b, "node").alias("a"), one(b, a, "node").alias("b"), one(a, b, "size").alias("a_size"), one(b, a, "size").alias("b_size")).distinct()


def by_simhash(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: similar nodes whose fingerprints differ in 3 bits or fewer. nodes: node, text_hash, size, fp, prefix.

    Of several nodes with one fingerprint the first stands for it: the others are held against it, and it against those of fingerprints nearby."""
    standing = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("of")).select("fp", c("of.node").alias("of_node"), c("of.size").alias("of_size")), "standing")
    own = nodes.select("fp", "node", "size").join(standing, "fp").where(c("node") != c("of_node"))
    near = written(links(standing.select("fp")), "balls")
    ends = [standing.select(c("fp").alias(side), c("of_node").alias(f"{side}_node"), c("of_size").alias(f"{side}_size")) for side in "ab"]
    met = _pairs(own, "of_", "").unionByName(_pairs(near.join(ends[0], "a").join(ends[1], "b"), "a_", "b_"))
    pairs = written(met.where(_near_enough(c("a_size"), c("b_size"))), "pairs")
    found = verified(pairs, docs, nodes)
    discard(standing, near, pairs)
    return found


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root: a row for each document; near copies, and what they connect, have one root."""
    whole = written(prefixed(docs), "prefixes")
    nodes = written(whole.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")), "nodes")
    prints = written(whole.select("doc_id", "text_hash", "node"), "prints")
    discard(whole)
    alike = by_simhash(docs, nodes)
    first = written(components(alike), "roots")

    # shingles that two nodes have at least, a share of all shingles at a time, so that only its rows lie shuffled on disk
    heads = nodes.select("node", "size", F.posexplode("prefix").alias("at", "shingle"))
    shares = []
    for k in range(PASSES):
        own = heads.where(F.pmod(F.shiftrightunsigned("shingle", 9), F.lit(PASSES)) == k)
        # a table of its own: a shingle that very many nodes share is split by Spark's handling of skewed joins
        many = written(own.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "many")
        shares.append(written(own.join(many, "shingle"), "shared"))
        discard(many)
    shared = reduce(DataFrame.unionByName, shares)

    # what meets, with the one that has the shingle earliest
    centres = shared.groupBy("shingle").agg(F.min(F.struct("at", "node", "size")).alias("centre"))
    centres = written(centres.select("shingle", *(c(f"centre.{x}").alias(f"of_{x}") for x in ("at", "node", "size"))), "centres")
    met = shared.join(centres, "shingle")
    some = met.where((c("of_node") != c("node")) & _near_enough(c("of_size"), c("size")) & _far_enough("of_", ""))
    sides = [first.select(c("node").alias(side), c("root").alias(f"{side}_root")) for side in "ab"]
    pairs = _pairs(some, "of_", "").join(sides[0], "a", "left").join(sides[1], "b", "left")
    pairs = written(pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).drop("a_root", "b_root"), "pairs")
    known = alike.unionByName(verified(pairs, docs, nodes))
    roots = written(components(known), "roots")

    # what meets and isn't in one group yet
    apart = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = written(apart.select("shingle", "at", "node", "size", "root"), "apart")
    several = written(apart.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle"), "several")
    left = written(apart.join(several, "shingle"), "left")
    a, b = (left.select("shingle", *(c(x).alias(f"{side}_{x}") for x in ("at", "node", "size", "root"))) for side in "ab")
    close = (c("a_node") < c("b_node")) & (c("a_root") != c("b_root")) & _near_enough(c("a_size"), c("b_size")) & _far_enough("a_", "b_")
    more = written(_pairs(a.hint("merge").join(b, "shingle").where(close), "a_", "b_"), "pairs")
    rooted = components(known.unionByName(verified(more, docs, nodes)))
    found = written(prints.select("doc_id", "text_hash", "node").join(rooted, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")), "groups")
    discard(prints, nodes, first, *shares, centres, pairs, roots, apart, several, left, more)
    return found
