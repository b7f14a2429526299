"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within 3 bits are linked. A fingerprint is cut into three parts of 22, 21 and 21 bits. If two fingerprints differ in 1 to 3
bits, some part holds one of those bits at least, and the other two parts differ in 2 bits at most: the balls of radius 1 around both, over
these two parts, meet. So every distinct fingerprint emits, for each part left out, the variants of the rest within radius 1; variants are
the shuffle key, and what meets is verified on whole fingerprints. (Balls of radius 2 over all 64 bits would find the same pairs with 2,081
variants a fingerprint instead of 131.) A pair meets in up to 44 variants: only the meeting that stands for its difference is kept.

Components come from label propagation with shortcuts over the links between distinct fingerprints, each round written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a row's component is that of its own text, so rows
with one doc_id and unlike texts may have several; a null doc_id is a row with a null doc_id, and its component is the smallest doc_id that
isn't null, if there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.llm.common import begin, bounded_batches, pieces, texts, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Lowest bit and width of the three parts.
PARTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed long."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()  # of bytes: both touch ASCII only
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return bits(np.array([xxh(p, SEED) for p in parts], "<u8"))


def bits(hashes: np.ndarray) -> int:
    """The fingerprint of hashes, as a signed long: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash", dict)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t, shingle) for t in texts(batch)], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(prints: DataFrame) -> DataFrame:
    """fp, variant, flipped (the flipped bit, -1 if none) of distinct fingerprints. The part left out holds the part's number instead."""
    emitted = []
    for k, (low, width) in enumerate(PARTS):
        out = ((1 << width) - 1) << low
        for bit in [-1, *(b for b in range(64) if not out >> b & 1)]:
            flip = 0 if bit < 0 else 1 << bit
            emitted.append((_signed(((1 << 64) - 1) ^ out), _signed(flip | (k + 1) << low), bit))
    steps = F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(x).alias("xor"), F.lit(b).cast("byte").alias("bit")) for m, x, b in emitted))
    step = F.explode(steps).alias("step")
    return prints.select("fp", step).select("fp", F.col("fp").bitwiseAND(F.col("step.mask")).bitwiseXOR(F.col("step.xor")).alias("variant"), F.col("step.bit").alias("flipped"))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: the pairs a < b of distinct fingerprints within the radius, each once."""
    if radius != RADIUS:
        raise ValueError("three parts serve radius 3")
    v = variants(prints)
    # both sides are 131 times what Spark expects of them: never broadcast
    a, b = v.hint("merge").alias("a"), v.alias("b")
    apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    # of the up to 44 meetings of a pair over two parts: centres that are equal, or flips of different bits (one may be none)
    meets = ((F.col("a.flipped") < 0) & (F.col("b.flipped") < 0)) | (F.col("a.flipped") < F.col("b.flipped"))
    found = a.join(b, (F.col("a.variant") == F.col("b.variant")) & (F.col("a.fp") != F.col("b.fp")) & meets & (apart <= radius))
    return found.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for the nodes of the edges (a, b).

    Each round gives a node the smallest root around it, then that root's own new root (a shortcut), so rounds grow as the logarithm of a
    chain's length in the usual case. Rounds go on until no root gets smaller, which ends: there are as many roots as nodes at most."""
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))), "edges")
    at = both.groupBy("node").agg(F.min("to").alias("near")).select("node", F.least("node", "near").alias("root"))
    while True:
        at = written(at, "roots")
        around = both.join(at.select(F.col("node").alias("to"), "root"), "to").groupBy("node").agg(F.min("root").alias("near"))
        step = written(at.join(around, "node").select("node", "root", F.least("root", "near").alias("next")), "steps")
        owner = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        if not step.where(F.col("next") != F.col("root")).limit(1).count():
            return at
        at = step.join(owner, "next").select("node", F.col("jump").alias("root"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: a row for each document."""
    prints = written(fingerprints(docs), "fingerprints")
    owners = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "owners")
    joined = components(links(owners.select("fp"))).withColumnRenamed("node", "fp")
    rooted = owners.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    final = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(final, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies (SimHash balls, then an exact check: nearcopies): that with the smallest doc_id, nulls last, and of these the first by hash of text.

    Rows are told by doc_id and text, so a repeated or null doc_id binds no texts together. Of rows equal in both one stays."""
    from crawlmill.llm import nearcopies

    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("first")
    keep = nearcopies.groups(docs).groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    keep = written(keep, "kept")
    text_hash = F.xxhash64(docs["text"])
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]) & (text_hash == keep["kept_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
