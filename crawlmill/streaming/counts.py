"""Counts over a crawl that still grows.

Page rows arrive as files. Filters that look at one page are counted once for each new row; those that read other pages are counted anew over
all rows so far. Each micro-batch writes its own folder, named by its number, so a batch that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlmill.functions import predicates as p
from crawlmill.operators import filters
from crawlmill.plans import views

INTERVAL = "1 second"


def filter_counts(pages: DataFrame, cross: bool | None = None) -> DataFrame:
    """view_name, filter_name, n of all page filters (cross: only those that do, or don't, read other pages); a row a filter."""
    some = [(v, n, f) for v in filters.PAGE_VIEWS for n, f in filters.FILTERS[v].items() if cross is None or f.cross == cross]
    enriched = filters.enrich(pages, {f"{v}.{n}" for v, n, _ in some})
    marks = enriched.select(*((p.yes(views.VIEWS[v].base()) & f.column()).alias(f"f{k}") for k, (v, _, f) in enumerate(some)))
    sums = marks.agg(*(F.count_if(f"f{k}").alias(f"f{k}") for k in range(len(some))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view_name"), F.lit(n).alias("filter_name"), F.col(f"f{k}").alias("n")) for k, (v, n, _) in enumerate(some)))).alias("r")).select("r.*")


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """New page rows, a URL once. What it remembers is one key a URL, for as long as the crawl goes on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).dropDuplicates(["url"])


def start_counts(stream: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Starts the query: pages go to out/pages/batch=N, counts of one-page filters to out/counts/batch=N."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        filter_counts(rows.sparkSession.read.parquet(f"{out}/pages/batch={number}"), cross=False).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    """All filters' counts so far: sums of the batches', and filters that read other pages over all rows."""
    own = spark.read.parquet(f"{out}/counts").groupBy("view_name", "filter_name").agg(F.sum("n").alias("n"))
    return own.unionByName(filter_counts(spark.read.parquet(f"{out}/pages").drop("batch"), cross=True))


def running_inlinks(stream: DataFrame) -> DataFrame:
    """url, inlinks, csr_inlinks, unique_inlinks of what has been crawled so far: lower bounds that grow. Streaming or not.

    Sources are counted by hash sketch on a stream, whose state would else hold every link; exactly on a table."""
    each = stream.select(F.col("url").alias("src"), F.explode("outlinks").alias("x"))
    sources = F.approx_count_distinct("src", 0.01) if stream.isStreaming else F.count_distinct("src")
    return each.groupBy(F.col("x.dst_url").alias("url")).agg(F.count("*").alias("inlinks"), F.count_if(F.coalesce("x.csr_only", F.lit(False))).alias("csr_inlinks"), sources.alias("unique_inlinks"))


def reloaded(spark: SparkSession, out: str) -> DataFrame:
    """The rows of a finished stream as they were stored, each URL once, with what passes over all of them add: inlinks, depths are the caller's."""
    from crawlmill.operators import graph

    pages = spark.read.parquet(f"{out}/pages").drop("batch").dropDuplicates(["url"])
    counted = graph.inlinks(graph.links(pages)).select("url", *(F.col(a).cast("int").alias(b) for a, b in (("inlinks", "inlinks_count"), ("unique_inlinks", "unique_inlinks_count"), ("csr_inlinks", "csr_inlinks_count"), ("unique_csr_inlinks", "unique_csr_inlinks_count"))))
    names = [n for n in counted.columns if n != "url"]
    return pages.drop(*names).join(counted, "url", "left").fillna(0, names).withColumn("inlinks_complete", F.lit(True))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; on a stream, rows over `late` behind are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")
