"""The link graph: inlinks, click depth and link score. Loops keep only narrow tables and cut their lineage with checkpoint()."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.functions import urls

c = F.col
DAMPING, ITERATIONS = 0.85, 30
CUT_EVERY = 5


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and the master is local."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if set_ := spark.conf.get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(set_)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="crawlmill-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint in the shared folder. For narrow tables: a checkpoint is read whole, row by row."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: columns are pruned, and lost executors cost nothing. The files go when the application ends."""
    spark, schema = df.sparkSession, df.schema
    to = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(schema).parquet(to)


def links(pages: DataFrame) -> DataFrame:
    """src, dst, anchor, rel, internal, csr_only, pos: a row for each link, in order."""
    each = pages.select(c("url").alias("src"), "row_id", F.posexplode("outlinks").alias("pos", "x"))
    return each.select("src", c("x.dst_url").alias("dst"), c("x.anchor").alias("anchor"), c("x.rel").alias("rel"), urls.is_same_domain(c("x.dst_url"), c("src")).alias("internal"), c("x.csr_only").alias("csr_only"), "row_id", "pos")


def inlinks(of: DataFrame) -> DataFrame:
    """url, inlinks, unique_inlinks, csr_inlinks, unique_csr_inlinks."""
    csr = F.coalesce("csr_only", F.lit(False))
    return of.groupBy(c("dst").alias("url")).agg(F.count("*").alias("inlinks"), F.count_distinct("src").alias("unique_inlinks"), F.count_if(csr).alias("csr_inlinks"), F.count_distinct(F.when(csr, c("src"))).alias("unique_csr_inlinks"))


def outlinks(of: DataFrame) -> DataFrame:
    """url and its eight outlink counters."""
    csr, out = F.coalesce("csr_only", F.lit(False)), ~F.coalesce("internal", F.lit(False))
    counts = {"outlinks": F.lit(True), "external_outlinks": out, "csr_outlinks": csr, "external_csr_outlinks": csr & out}
    return of.groupBy(c("src").alias("url")).agg(*(x for n, cond in counts.items() for x in (F.count_if(cond).alias(n), F.count_distinct(F.when(cond, c("dst"))).alias(f"unique_{n}"))))


def depths(edges: DataFrame, root: str) -> DataFrame:
    """node, depth: hops from the root over edges (src, dst), level by level until a level has no new node; nodes that aren't reached have no row."""
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen = cut(spark.createDataFrame([(root, 0)], "node string, depth int"))
    front = seen
    for level in count(1):
        new = edges.join(front, edges["src"] == front["node"]).select(c("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        front = cut(new)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        if level % CUT_EVERY == 0:
            seen = cut(seen)
    return seen


def page_depths(pages: DataFrame, root: str) -> DataFrame:
    """url, depth of the pages that links and redirects lead to from the root, over normalised URLs; none if the root wasn't crawled."""
    key = urls.normalized_or_trimmed
    hops = pages.where(F.coalesce("redirect_url", F.lit("")) != "").select(key(c("url")).alias("src"), key(c("redirect_url")).alias("dst"))
    edges = links(pages).select(key(c("src")).alias("src"), key(c("dst")).alias("dst")).unionByName(hops)
    start = pages.sparkSession.range(1).select(key(F.lit(root))).first()[0]
    known = pages.select("url", key(c("url")).alias("node"))
    if not known.where(c("node") == start).limit(1).count():
        return known.select("url", F.lit(None).cast("int").alias("depth")).limit(0)
    return known.join(depths(edges, start), "node").select("url", "depth")


def page_rank(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """node, score: PageRank over the multigraph of edges (src, dst), each repeated link counting, scaled so that the best has 100.

    What nodes without links hold is spread over all. Repeated edges are one row with a weight; both tables stay partitioned by node."""
    weighted = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = weighted.groupBy("src").agg(F.sum("w").alias("out"))
    shares = cut(weighted.join(out, "src").select("src", "dst", (c("w") / c("out")).alias("share")))
    nodes = cut(shares.select(c("src").alias("node"), F.lit(False).alias("dangling")).unionByName(shares.select(c("dst").alias("node"), F.lit(True).alias("dangling"))).groupBy("node").agg(F.bool_and("dangling").alias("dangling")))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    ranks = nodes.withColumn("score", F.lit(1.0 / n))
    for k in range(1, iterations + 1):
        lost = ranks.agg(F.coalesce(F.sum(F.when(c("dangling"), c("score"))), F.lit(0.0)).alias("lost"))
        got = shares.join(ranks.select(c("node").alias("src"), "score"), "src").groupBy(c("dst").alias("node")).agg(F.sum(c("share") * c("score")).alias("in"))
        ranks = nodes.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "dangling", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("in", F.lit(0.0)) + c("lost") / n)).alias("score"))
        if k % CUT_EVERY == 0 or k == iterations:
            ranks = cut(ranks)
    return ranks.crossJoin(F.broadcast(ranks.agg(F.max("score").alias("top")))).select("node", (c("score") / c("top") * 100).alias("score"))
