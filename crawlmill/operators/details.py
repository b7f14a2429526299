"""What is looked up for one page or one image, and what a crawl adds to its records before and after pages are read.

Lookups are filters that reach the scan: the key is compared as it is stored, so Parquet's statistics rule files out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill.functions import predicates as p
from crawlmill.functions import urls
from crawlmill.operators.graph import cut

c = F.col
MOST_HOPS = 10
#: Answers to HEAD after which a resource is asked for with GET, and how much of a body is counted.
REFUSED = (405, 501)
MOST_BODY = 8 << 20
TAG = "struct<lang:string,url:string>"


# lookups


def backlinks(links: DataFrame, url: str) -> DataFrame:
    """source_url, anchor, rel of the links to a URL, in the order of their pages and places. links: as graph.links()."""
    return links.where(c("dst") == url).orderBy("row_id", "pos").select(c("src").alias("source_url"), "anchor", "rel")


def items(pages: DataFrame, url: str) -> DataFrame:
    """format, type_name, raw_json of a page's structured data, in order."""
    each = pages.where(c("url") == url).select("row_id", F.posexplode("sd_items").alias("pos", "x"))
    return each.orderBy("row_id", "pos").select("x.format", "x.type_name", "x.raw_json")


def image_references(pages: DataFrame, src: str) -> DataFrame:
    """page_url, alt, has_alt_attr: a row for each use of an image, in order."""
    some = pages.where(F.exists("images", lambda i: i["src"] == src)).select("row_id", "url", F.posexplode("images").alias("pos", "i"))
    return some.where(c("i.src") == src).orderBy("row_id", "pos").select(c("url").alias("page_url"), "i.alt", "i.has_alt_attr")


def outlink_details(pages: DataFrame) -> DataFrame:
    """row_id, place, dst_url, anchor, rel, status: each page's outlinks as its details list them: broken ones first, then redirected ones,
    then the rest, each in page order (place, from 1). status: of the row crawled for the target, of several the last that has one."""
    from pyspark.sql import Window

    each = pages.select("row_id", F.posexplode("outlinks").alias("pos", "x")).select("row_id", "pos", "x.dst_url", "x.anchor", "x.rel")
    known = pages.where(c("status").isNotNull()).groupBy(c("url").alias("dst_url")).agg(F.max_by("status", "row_id").alias("status"))
    told = each.join(known, "dst_url", "left")
    rank = F.when(c("status") >= 400, 0).when(c("status") >= 300, 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(rank, "pos"))  # of one page's links
    return told.select("row_id", place.alias("place"), "dst_url", "anchor", "rel", "status")


def with_templates(pages: DataFrame, page_layouts: DataFrame, templates: DataFrame) -> DataFrame:
    """pages with layout (template, template_type, assignment). page_layouts: url, template_id, assignment; templates: template_id, template, template_type."""
    told = page_layouts.join(templates, "template_id", "left")
    layout = F.struct("template", "template_type", "assignment").alias("layout")
    return pages.drop("layout").join(told.select("url", layout), "url", "left")


# what a crawl adds


def seeds(spark: SparkSession, addresses: list[str]) -> DataFrame:
    """url, depth of a list of addresses to crawl as it is: each once, in order, all at depth 0."""
    some = list(dict.fromkeys(a.strip() for a in addresses if a.strip()))
    return spark.createDataFrame([(a, 0) for a in some], "url string, depth int")


def probed(checks: DataFrame) -> DataFrame:
    """url, kind, status, content_type, size_bytes, error of resources that were asked for.

    checks: url, kind, method, status, content_type, size_bytes, error; HEAD counts unless it failed, was refused or told no size of what is
    there; then GET does, up to 8 MiB of its body."""
    one = lambda method: F.max_by(F.when(c("method") == method, F.struct("status", "content_type", "size_bytes", "error")), F.when(c("method") == method, F.lit(1))).alias(method)
    both = checks.groupBy("url").agg(F.min("kind").alias("kind"), one("HEAD"), one("GET"))
    good = c("HEAD.error").isNull() & c("HEAD.status").isNotNull() & ~c("HEAD.status").isin(*REFUSED) & ~((F.coalesce("HEAD.size_bytes", F.lit(0)) == 0) & c("HEAD.status").between(200, 299))
    chosen = F.when(p.yes(good) | c("GET").isNull(), c("HEAD")).otherwise(c("GET"))
    kind = F.coalesce(F.trim(F.substring_index(chosen["content_type"], ";", 1)), urls.content_type_by_ending(c("url")))
    return both.select("url", "kind", chosen["status"].alias("status"), F.regexp_replace(kind, '^"|"$', "").alias("content_type"), F.least(chosen["size_bytes"], F.lit(MOST_BODY)).alias("size_bytes"), chosen["error"].alias("error"))


def fetch_counts(responses: DataFrame) -> DataFrame:
    """url, network_fetches, revalidated_fetches (answered 304) of assets. responses: url, resource_type, from_network, wire_status; documents don't count."""
    return responses.where((c("resource_type") != "Document") & c("from_network")).groupBy("url").agg(F.count("*").alias("network_fetches"), F.count_if(c("wire_status") == 304).alias("revalidated_fetches"))


def last_page_time(pages: DataFrame) -> DataFrame:
    """One row, last_crawled_at: NULL for a crawl without pages."""
    return pages.agg(F.max("crawled_at").alias("last_crawled_at"))


def redirect_rows(starts: DataFrame, responses: DataFrame, root: str, recorded: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """hop, start, url, status, target: what following redirects of crawled pages finds out, hop by hop.

    starts: url; responses: url, status, target. Of a way that reaches what is recorded, another site, an answer without a target or the
    hop number `most` no more hops are followed, as a crawl does; a start that comes first in order takes a target that several lead to."""
    front, out, known = starts.select(c("url").alias("start"), "url"), None, recorded.select(c("url").alias("target")).distinct()
    for hop in range(1, most + 1):
        found = front.join(responses, "url").where(c("target").isNotNull()).withColumn("hop", F.lit(hop))
        found = cut(found.select("hop", "start", "url", "status", "target"))
        out = found if out is None else out.unionByName(found)
        new = found.where(urls.is_same_domain(c("target"), F.lit(root))).join(known, "target", "left_anti").groupBy("target").agg(F.min("start").alias("start"))
        front = cut(new.select("start", c("target").alias("url")))
        if not front.limit(1).count():
            break
        known = known.unionByName(front.select(c("url").alias("target")))
    return out


def start_url(responses: DataFrame, root: str, list_mode: bool = False, most: int = MOST_HOPS) -> str:
    """The address that a crawl starts at: redirects between spellings of the same host (with and without www) are followed. A lookup a hop."""
    url = root
    for _ in range(0 if list_mode else most):
        hop = responses.where((c("url") == url) & c("target").isNotNull()).select("target", urls.is_another_spelling(c("target"), c("url")).alias("same")).first()
        if hop is None or not hop["same"]:
            break
        url = hop["target"]
    return url


def gated(pages: DataFrame, root: str) -> DataFrame:
    """pages with analysed, and with what follows for the record itself.

    pages: url, final_url, status, content_type, html. A row that was redirected, is off the site or isn't HTML keeps no facts of a document:
    its html becomes NULL. An empty 2xx document is one without a body tag and words. A redirect that was followed has its target, its own
    3xx status or else 301, and no content type; other rows without a content type are text/html."""
    key = urls.normalized_or_trimmed
    moved = p.yes((F.coalesce("final_url", F.lit("")) != "") & (key(c("final_url")) != key(c("url"))))
    own = F.when(moved, c("final_url")).otherwise(c("url"))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    is_html = kind.isin("", "text/html", "application/xhtml+xml")
    skip = moved | p.yes(c("status").between(300, 399)) | ~urls.is_same_domain(own, F.lit(root)) | ~is_html
    bare = p.yes(~skip & (F.coalesce(F.length("html"), F.lit(0)) == 0) & c("status").between(200, 299))
    return pages.select(
        "*", (~skip & ~p.yes(F.length("html") == 0) & c("html").isNotNull()).alias("analysed"), F.when(moved, c("final_url")).alias("redirect_url"),
        F.when(moved, F.when(c("status").between(300, 399), c("status")).otherwise(F.lit(301))).alias("redirect_status"), bare.alias("empty_document"),
    ).withColumns({"html": F.when(c("analysed"), c("html")), "content_type": F.when(~moved, F.coalesce("content_type", F.lit("text/html")))})


def merged_tags(html: Column, http: Column, sitemap: Column) -> tuple[Column, Column]:
    """(hreflang_tags, hreflang_sources): the tags of three sources in this order, each pair of language and URL once; a source counts if it added any."""
    none = F.array().cast(f"array<{TAG}>")
    parts = [F.coalesce(x, none) for x in (html, http, sitemap)]
    grown = [parts[0], F.array_distinct(F.concat(*parts[:2])), F.array_distinct(F.concat(*parts))]
    sources = F.array_compact(F.array(F.when(F.size(parts[0]) > 0, "HTML"), F.when(F.size(F.array_except(parts[1], parts[0])) > 0, "HTTP"), F.when(F.size(F.array_except(parts[2], F.concat(*parts[:2]))) > 0, "Sitemap")))
    return grown[2], sources


def relative_time(now: Column, then: Column) -> Column:
    """How long ago a time in seconds is: just now, minutes, hours, days, and after a week the date."""
    age = now - then
    many = lambda by, unit: F.concat(F.floor(age / by).cast("string"), F.lit(f"{unit} ago"))
    return F.when(age < 60, "just now").when(age < 3600, many(60, "m")).when(age < 86_400, many(3600, "h")).when(age < 7 * 86_400, many(86_400, "d")).otherwise(F.date_format(F.timestamp_seconds(then), "MMM d"))


def site_host(address: Column) -> Column:
    """The host of an address, with its port if that isn't the scheme's own; an address without a scheme is read as https. NULL for a blank one."""
    text = F.trim(address)
    whole = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    found = F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    usual = F.when(F.lower(whole).startswith("http://"), F.regexp_replace(found, ":(80)?$", "")).otherwise(F.regexp_replace(found, ":(443)?$", ""))
    return F.when((text != "") & (usual != ""), usual)
