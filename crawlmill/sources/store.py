"""Sinks and the crawl catalog: crawls as folders of Parquet, views as CSV, the report as HTML, counts kept with a version."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
BOM = "﻿"
COUNTS_VERSION = 1
MOST_OFFENDERS = 12
MOST_HISTORY = 100


def save_pages(pages: DataFrame, folder: str, mode: str = "append") -> None:
    """Appends page rows; of rows with one URL the first by row_id is kept within a call."""
    first = pages.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("row_id"))).where("_n = 1").drop("_n")
    first.write.mode(mode).parquet(f"{folder}/pages")


def load_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page rows of a crawl; across appends the first row of a URL counts."""
    pages = spark.read.parquet(f"{folder}/pages")
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("row_id"))).where("_n = 1").drop("_n")


def updated(pages: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """pages with the columns of new, by key; where new has NULL or no row the old value stays."""
    names = [n for n in new.columns if n != key]
    renamed = new.select(c(key).alias("_k"), *(c(n).alias(f"_new_{n}") for n in names))
    joined = pages.join(renamed, c(key) == c("_k"), "left")
    return joined.withColumns({n: F.coalesce(f"_new_{n}", n) if n in pages.columns else c(f"_new_{n}") for n in names}).drop("_k", *(f"_new_{n}" for n in names))


def write_csv(rows: DataFrame, folder: str) -> None:
    """A view as CSV parts, each with a byte-order mark, a header of upper-case names, and quotes doubled; nested values as JSON."""
    names = [n.upper() for n in rows.columns]
    flat = rows.select(*(F.to_json(c(f"`{n}`")).alias(n.upper()) if k.startswith(("array", "struct", "map")) else F.coalesce(c(f"`{n}`").cast("string"), F.lit("")).alias(n.upper()) for n, k in rows.dtypes))
    flat = flat.withColumnRenamed(names[0], BOM + names[0])
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(folder)


def csv_text(rows: DataFrame, most: int = 100_000) -> str:
    """A small view as one CSV text that starts with a byte-order mark. Raises if the view has over `most` rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} rows; use write_csv")
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set(',"\r\n') else v
    lines = [[n.upper() for n in rows.columns], *(["" if v is None else str(v) for v in r] for r in got)]
    return BOM + "".join(",".join(map(quoted, line)) + "\r\n" for line in lines)


def report_html(title: str, overview: DataFrame, offenders: DataFrame) -> str:
    """The report: rules that fire with their counts, each with at most 12 of its pages. offenders: issue_name, url."""
    fired = overview.where("count > 0").collect()  # 79 rows at most
    ranked = offenders.withColumn("_n", F.row_number().over(Window.partitionBy("issue_name").orderBy("url"))).where(c("_n") <= MOST_OFFENDERS)
    urls: dict[str, list[str]] = {}
    for r in ranked.orderBy("issue_name", "_n").collect():
        urls.setdefault(r["issue_name"], []).append(r["url"])
    parts = [f"<h2>{html.escape(r['issue_name'])}</h2><p>{r['issue_type']}, {r['priority']}: {r['count']} ({r['pct']:.2f} %)</p><ul>" + "".join(f"<li>{html.escape(u)}</li>" for u in urls.get(r["issue_name"], [])) + "</ul>" for r in fired]
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(parts)


def summary(pages: DataFrame, overview: DataFrame) -> DataFrame:
    """One row: URLs, documents, indexable ones, rules that fire and the sum of their counts."""
    from crawlmill.operators.filters import with_facts

    totals = with_facts(pages).agg(F.count("*").alias("urls"), F.count_if("_document").alias("documents"), F.count_if("_indexable").alias("indexable"))
    fired = overview.agg(F.count_if(c("count") > 0).alias("rules_firing"), F.sum("count").alias("issues"))
    return totals.crossJoin(fired)


# the catalog


def history(crawls: DataFrame, most: int = MOST_HISTORY) -> DataFrame:
    """The latest crawls, newest first."""
    return crawls.orderBy(F.desc("started_at"), F.desc("id")).limit(most)


def previous(crawls: DataFrame) -> DataFrame:
    """Each crawl with the finished crawl of its root before it, previous_id."""
    finished = F.when(c("finished_at").isNotNull() & ~F.coalesce("aborted", F.lit(False)), c("id"))
    before = F.last(finished, ignorenulls=True).over(Window.partitionBy("root_url").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, -1))
    return crawls.withColumn("previous_id", before)


def row_counts(pages: DataFrame) -> DataFrame:
    """One row: all rows, pages, rows that were never fetched."""
    return pages.agg(F.count("*").alias("rows"), F.count_if("is_page").alias("pages"), F.count_if(c("status").isNull() & c("redirect_url").isNull()).alias("unfetched"))


def store_counts(counts: DataFrame, folder: str, crawl_id: int) -> None:
    counts.withColumns({"crawl_id": F.lit(crawl_id), "version": F.lit(COUNTS_VERSION)}).write.mode("overwrite").parquet(f"{folder}/counts/crawl={crawl_id}")


def load_counts(spark: SparkSession, folder: str, crawl_id: int) -> DataFrame:
    """The stored counts; none if they are of another version."""
    return spark.read.parquet(f"{folder}/counts/crawl={crawl_id}").where(c("version") == COUNTS_VERSION)


def started(crawls: DataFrame, root_url: str, now: int, config_json: str = "{}") -> DataFrame:
    """The catalog with one more crawl, whose id follows the greatest."""
    spark = crawls.sparkSession
    number = crawls.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]  # one number
    new = spark.createDataFrame([(number, root_url, now, None, config_json, False)], "id long, root_url string, started_at long, finished_at long, config_json string, aborted boolean")
    return crawls.unionByName(new, allowMissingColumns=True)


def closed(crawls: DataFrame, crawl_id: int, counts: DataFrame, finished_at: int, aborted: bool = False) -> DataFrame:
    """The catalog with a crawl at its end, and with what row_counts() of it says."""
    own = c("id") == crawl_id
    names = ("rows", "pages", "unfetched")
    joined = crawls.drop(*(f"{n}_count" for n in names)).crossJoin(F.broadcast(counts.select(*(c(n).alias(f"_{n}") for n in names))))  # one row
    old = {n: c(f"_old_{n}") if f"{n}_count" in crawls.columns else F.lit(None).cast("long") for n in names}
    if any(f"{n}_count" in crawls.columns for n in names):
        joined = joined.join(crawls.select("id", *(c(f"{n}_count").alias(f"_old_{n}") for n in names if f"{n}_count" in crawls.columns)), "id")
    told = joined.withColumns({"finished_at": F.when(own, F.lit(finished_at)).otherwise(c("finished_at")), "aborted": F.when(own, F.lit(aborted)).otherwise(c("aborted")), **{f"{n}_count": F.when(own, c(f"_{n}")).otherwise(old[n]) for n in names}})
    return told.drop(*(f"_{n}" for n in names), *(f"_old_{n}" for n in names))


def aborted(crawls: DataFrame, last_times: DataFrame) -> DataFrame:
    """The catalog with all unfinished crawls ended as aborted, at the time of their last page or else of their start. last_times: id, last_crawled_at."""
    joined = crawls.join(last_times, "id", "left")
    open_ = c("finished_at").isNull()
    return joined.withColumns({"aborted": open_ | F.coalesce("aborted", F.lit(False)), "finished_at": F.when(open_, F.coalesce("last_crawled_at", "started_at")).otherwise(c("finished_at"))}).drop("last_crawled_at")


def without(crawls: DataFrame, crawl_id: int) -> DataFrame:
    """The catalog without a crawl; its folder goes by delete_crawl()."""
    return crawls.where(c("id") != crawl_id)


def delete_crawl(spark: SparkSession, folder: str) -> bool:
    """Deletes a crawl's folder through Spark's file systems; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def counts_of_crawls(counts: DataFrame, crawls: DataFrame) -> DataFrame:
    """Stored counts with their crawls' root and start, of crawls that the catalog holds."""
    return counts.join(crawls.select(c("id").alias("crawl_id"), "root_url", "started_at"), "crawl_id")


def save_sitemap(entries: DataFrame, folder: str) -> None:
    """The sitemap's URLs as a table, each once a sitemap."""
    entries.dropDuplicates(["sitemap", "loc"]).write.mode("overwrite").parquet(f"{folder}/sitemap_urls")


def side_table(rows: DataFrame, key: str = "url", order: str = "id", name: str = "rows") -> DataFrame:
    """key and all rows of a side table with it, as an array in order. A key's rows are a page's own: links, images, issues."""
    fields = [n for n in rows.columns if n != key]
    each = F.sort_array(F.collect_list(F.struct(order, *(n for n in fields if n != order))))
    return rows.groupBy(key).agg(each.alias(name))


def export_views(pages: DataFrame, folder: str, changes: DataFrame | None = None) -> list[str]:
    """Every view as CSV in a folder of its own, and the overview; changes only if there is a crawl to compare with. The names written."""
    from crawlmill.plans import rules, views

    tables = {name: views.view(pages, name) for name in [*views.VIEWS, "SiteStructure"]} | {"Overview": rules.ordered(rules.overview(pages))}
    if changes is not None:
        tables["Changes"] = changes
    for name, rows in tables.items():
        write_csv(rows, f"{folder}/{name}")
    return list(tables)


def planned_checks(pages: DataFrame, most: int = 10_000) -> DataFrame:
    """url, kind: sources of images and other resources that have no row yet, the first kind of each, at most `most` in order of first appearance."""
    images = pages.select("row_id", F.explode(F.transform("images", lambda i: F.struct(i["src"].alias("url"), F.lit("image").alias("kind")))).alias("x"))
    others = pages.select("row_id", F.explode(F.transform("subresources", lambda s: F.struct(s["url"].alias("url"), s["kind"].alias("kind")))).alias("x"))
    found = images.unionByName(others).where(F.col("x.url").rlike("^https?://")).groupBy("x.url").agg(F.min_by("x.kind", "row_id").alias("kind"), F.min("row_id").alias("first"))
    return found.join(pages.select("url"), "url", "left_anti").orderBy("first", "url").limit(most).select("url", "kind")


def planned_canonicals(pages: DataFrame) -> DataFrame:
    """Canonical targets on the page's own domain that weren't crawled, by normalised URL."""
    from crawlmill.functions import predicates as p
    from crawlmill.functions import urls

    key = urls.normalized_or_trimmed
    declared = pages.where(F.trim("canonical") != "").select(p.resolved_canonical().alias("target"), "url").where(urls.is_same_domain(c("target"), c("url")))
    wanted = declared.select(key(c("target")).alias("k")).distinct()
    return wanted.join(pages.select(key(c("url")).alias("k")), "k", "left_anti").withColumnRenamed("k", "url")
