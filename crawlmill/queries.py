"""The library's queries by name: (spark, sf_dir) -> DataFrame, over a folder's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlmill import oracle
from crawlmill.functions import text, urls
from crawlmill.operators import changes, details, extract, filters, graph, hreflang, layout, rowfilter, similarity, structured
from crawlmill.plans import analysis, rules, views
from crawlmill.schema import complete
from crawlmill.sources import samples, sitemaps, store
from crawlmill.sources.derived import before, crawl
from crawlmill.streaming import counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


query("overview", lambda s, d: rules.overview(crawl(s, d)), oracle.overview())
for _view in filters.PAGE_VIEWS:
    query(f"filters_{_view.lower()}", lambda s, d, v=_view: views.flags(crawl(s, d), v), oracle.flags(_view))
query("badges", lambda s, d: rules.badges(crawl(s, d)), oracle.badges())
query("view_images", lambda s, d: views.view(crawl(s, d), "Images"), oracle.images())
query("view_site_structure", lambda s, d: views.view(crawl(s, d), "SiteStructure"), oracle.directories())
query("changes", lambda s, d: changes.changes(crawl(s, d), before(crawl(s, d))), oracle.changes())


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "title", "h1", F.size("outlinks").cast("long").alias("outlinks"), "has_body_tag")


def _sd_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = structured.vocabulary(samples.TYPES)
    out = extract.extract(samples.pages(spark, sf_dir, [h for h, _ in samples.ISSUES]), known=known)
    return out.select("page_id", F.explode("sd_issues").alias("i")).select("page_id", "i.severity", "i.type_name", "i.code")


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract(samples.pages(spark, sf_dir, [h for h, _ in samples.PRODUCTS]))
    return out.where("ecommerce is not null").select("page_id", "ecommerce.*")


def _sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of written pages as text, a row a fact."""
    out = extract.extract(samples.pages(spark, sf_dir, [h for h, _ in samples.FACTS]))
    said = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    lists = {
        "hreflang_tags": lambda x: F.concat_ws("=", x["lang"], x["url"]), "subresources": lambda x: F.concat_ws("=", x["url"], x["kind"]), "outlinks": lambda x: F.concat_ws(":", x["dst_url"], said(x["anchor"]), said(x["rel"])),
        "images": lambda x: F.concat_ws(":", x["src"], said(x["alt"]), said(x["width"]), said(x["height"]), said(x["has_alt_attr"])),
    }
    text = {n: F.array_join(F.transform(n, lists[n]), " ") if n in lists else F.col(n).cast("string") for n in samples.FACT_NAMES}
    wanted = F.array(*(F.array(*(F.lit(n) for n in x)) for _, x in samples.FACTS))
    rows = out.select("page_id", F.explode(F.array(*(F.struct(F.lit(n).alias("fact"), v.alias("value")) for n, v in text.items()))).alias("r"))
    return rows.where(F.array_contains(F.element_at(wanted, (F.pmod("page_id", F.lit(len(samples.FACTS))) + 1).cast("int")), F.col("r.fact"))).select("page_id", "r.fact", "r.value")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", urls.normalize_url(u).alias("normalized"), urls.host_of(u).alias("host"), urls.origin_of(u).alias("origin"), urls.resolve_url(u, F.lit("../x/./y?z=1")).alias("resolved"),
        urls.folder_depth(urls.path_of(u)).alias("folder_depth"), urls.is_same_domain(u, F.lit("https://tionsh.example.com/")).alias("same_domain"),
    )


def _row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    C = rowfilter.Condition
    some = views.view(crawl(spark, sf_dir), "Internal")
    wanted = [C("size", ">=", "1500"), C("title", "contains", "ACME"), C("status_code", "in", "200, 404"), C("address", "not_contains", ""), C("nothing", "equals", "x")]
    out = rowfilter.row_filter(some, wanted, search="Example").where(~F.lower(F.col("address")).endswith("/"))
    return rowfilter.sort_by(out, "size", descending=True).select("row_id", "address", "title")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return out.withColumn("near_duplicates", F.array_join(F.transform("near_duplicates", lambda x: x.cast("string")), ","))


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("root_url"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("finished_at"), F.lit(False).alias("aborted"))
    return store.previous(crawls).select("id", "previous_id")


def _gtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", text.gtin_is_valid(F.lpad((F.col("p_partkey") * 7919 % 10_000_000_000_000).cast("string"), 13, "0")).alias("valid"))


def _widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", text.title_pixel_width(F.col("p_name")).alias("title_width"), text.description_pixel_width(F.col("p_name")).alias("text_width"))


def _backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawl(spark, sf_dir)
    return details.backlinks(graph.links(pages), pages.where("row_id = 50").first()["url"])


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    now, k = F.lit(1_700_000_000), F.pmod("page_id", F.lit(4))
    address = F.when(k == 0, F.concat(F.lit(" "), F.regexp_replace("url", "^https://", ""))).when(k == 1, F.regexp_replace("url", "^https://([^/]*)", "http://$1:80")).when(k == 2, F.regexp_replace("url", "^https://([^/]*)", "HTTPS://user@$1:8443"))
    return pages.select("page_id", details.relative_time(now, now - F.col("page_id") * 7919 % 900_000).alias("age"), details.site_host(F.when(F.col("page_id") % 9 != 8, F.coalesce(address, F.col("url"))).otherwise(F.lit("  "))).alias("host"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    checks = pages.selectExpr(
        "url", "'image' AS kind", "explode(array('HEAD', 'GET')) AS method", "page_id % 12 AS k", "page_id").where("k <> 3 OR method = 'HEAD'").selectExpr(
        "concat('https://img.example/', page_id, '.png') AS url", "kind", "method", "CAST(CASE WHEN method = 'GET' THEN 200 WHEN k = 0 THEN 405 WHEN k = 1 THEN 501 WHEN k = 2 THEN NULL WHEN k = 4 THEN 404 ELSE 200 END AS INT) AS status",
        "CASE WHEN k = 5 THEN NULL WHEN method = 'GET' THEN 'image/webp; x=1' ELSE '\"image/gif\"' END AS content_type", "CAST(CASE WHEN method = 'GET' THEN 9000000 WHEN k IN (4, 6) THEN 0 ELSE 10 + k END AS BIGINT) AS size_bytes", "CASE WHEN method = 'HEAD' AND k = 2 THEN 'timeout' END AS error")
    return details.probed(checks)


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return details.fetch_counts(events.selectExpr("concat('/asset/', user_id % 50) AS url", "CASE WHEN event_id % 7 = 0 THEN 'Document' ELSE 'Image' END AS resource_type", "event_id % 3 <> 0 AS from_network", "CASE WHEN event_id % 5 = 0 THEN 304 WHEN event_id % 5 = 1 THEN NULL ELSE 200 END AS wire_status"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    some = pages.selectExpr(
        "page_id", "CASE WHEN page_id % 11 = 4 THEN 'https://other.example/x' ELSE concat('https://www.site.example/', page_id) END AS url", "CASE page_id % 7 WHEN 0 THEN concat('https://www.site.example/', page_id, '/moved') WHEN 1 THEN '' WHEN 2 THEN concat('https://www.site.example/', page_id, '#top') END AS final_url",
        "CAST(CASE page_id % 5 WHEN 0 THEN 302 WHEN 1 THEN NULL ELSE 200 END AS INT) AS status", "CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'TEXT/HTML; charset=x' WHEN 2 THEN 'application/xhtml+xml' END AS content_type", "CASE WHEN page_id % 13 = 3 THEN '' WHEN page_id % 13 = 4 THEN NULL ELSE html END AS html")
    out = details.gated(some, "https://site.example/")
    return out.select("page_id", "analysed", "redirect_url", "redirect_status", "content_type", "empty_document", (F.col("html").isNotNull()).alias("has_html"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    tags = lambda by: F.transform(F.sequence(F.lit(0), F.pmod(F.col("page_id") + by, F.lit(3)).cast("int")), lambda k: F.struct(F.concat(F.lit("l"), k + F.lit(by % 2)).alias("lang"), F.lit("https://x.example/").alias("url")))
    html, http, sitemap = (F.when(F.pmod("page_id", F.lit(m)) != 0, tags(by)) for m, by in ((4, 0), (5, 1), (7, 2)))
    merged, sources = details.merged_tags(html, http, sitemap)
    return pages.select("page_id", F.array_join(F.transform(merged, lambda x: x["lang"]), " ").alias("langs"), F.array_join(sources, " ").alias("sources"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawl(spark, sf_dir)
    entries = pages.where("row_id % 9 < 3").select(F.when(F.col("row_id") % 9 == 0, F.concat("url", F.lit("/lost"))).otherwise(F.col("url")).alias("loc"))
    blocked = pages.where("row_id % 12 = 0").select(F.when(F.col("row_id") % 18 == 0, F.concat("url", F.lit("/lost"))).when(F.col("row_id") % 24 == 0, F.concat("url", F.lit("/shut"))).otherwise(F.col("url")).alias("url"))
    return sitemaps.known_urls(pages.select("row_id", "url"), entries, blocked).select("row_id", "url", "in_sitemap", "blocked_by_robots")


def _sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five urlsets, two of them behind an index within an index, and one that nothing names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<url><loc> "), escaped, F.concat(F.lit("/"), "page_id"), F.lit(" </loc>"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<lastmod>2024-01-0"), F.col("page_id") % 9 + 1, F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"))
    files = pages.groupBy(F.concat(F.lit("s"), F.pmod("page_id", F.lit(5)).cast("string")).alias("url")).agg(F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), ""), F.lit("</urlset>")).alias("body"))
    index = lambda name, *of: (name, "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in of) + "</sitemapindex>")
    more = spark.createDataFrame([index("top", "s0", "inner", "top"), index("inner", "s1", "s2", "deep"), index("deep", "s3"), ("junk", "<urlset><url>")], "url string, body string")
    return sitemaps.sitemap_urls(files.unionByName(more), ["top", "junk"]).select("loc", "lastmod", "sitemap", "pos")


def _depth_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.view(crawl(spark, sf_dir), "SiteStructure")
    return rows.select("dir_path", *(F.coalesce(f.condition(), F.lit(False)).alias(n) for n, f in filters.FILTERS["SiteStructure"].items()))


def _overview_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.overview(crawl(spark, sf_dir))
    return rows.agg(*(F.sum(F.when(f.condition(), F.col("count"))).alias(n) for n, f in filters.FILTERS["Overview"].items()))


def _change_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawl(spark, sf_dir)
    layouts = pages.where("row_id % 4 = 1").select("url", F.lit("Moved 1").alias("summary"))
    rows = changes.changes(pages, before(pages), layouts)
    return rows.agg(*(F.count_if(f.condition()).alias(n) for n, f in filters.FILTERS["Changes"].items()))


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawl(spark, sf_dir).where("layout is not null")
    changed = pages.where("row_id % 3 = 1").select("row_id", F.when(F.col("row_id") % 2 == 0, "Added 1").otherwise("Moved 2").alias("summary"))
    rows = layout.template_rows(pages.select("row_id", F.col("layout.template").alias("template_type"), "layout.assignment"), changed, by="row_id")
    return rows.select("*", *(f.condition().alias(n) for n, f in filters.FILTERS["Layout"].items()))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("root_url"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.lit(1).cast("long")).alias("finished_at"), F.lit(False).alias("aborted"))
    times = crawls.where("id % 2 = 0").select("id", (F.col("started_at") + F.col("id") % 100).alias("last_crawled_at"))
    return store.without(store.aborted(crawls, times), 1)


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.analysed(samples.site(spark, sf_dir), samples.ROOT, samples.site_entries(spark, sf_dir)).where("row_id > 0")
    langs = F.array_join(F.transform("hreflang_tags", lambda x: x["lang"]), " ")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("hreflang_issues", F.array().cast("array<struct<kind:string,lang:string,target_url:string>>")), lambda x: x["kind"]))), " ")
    named = {"title": "title", "indexability": "indexability", "redirect_url": "redirect_url", "redirect_status": "redirect_status", "content_type": "content_type", "word_count": "word_count", "has_body_tag": "has_body_tag", "depth": "depth", "inlinks": "inlinks_count", "unique_inlinks": "unique_inlinks_count", "near": "near_duplicate_count", "in_sitemap": "in_sitemap"}
    return out.select("row_id", *(F.col(v).cast("string").alias(k) for k, v in named.items()), langs.alias("langs"), F.array_join("hreflang_sources", " ").alias("sources"), kinds.alias("issues"))


def _site_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = analysis.analysed(samples.site(spark, sf_dir), samples.ROOT, samples.site_entries(spark, sf_dir))
    return rules.overview(pages).where(F.col("issue_name").isin(*samples.SITE_ISSUES)).select("issue_name", "count")


def _root(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    pages = crawl(spark, sf_dir)
    return pages, pages.where("row_id = 1").first()["url"]


query("extract_facts", _facts, oracle.FACTS)
query("structured_issues", _sd_issues, samples.answers([(k, "error" if x[0] == "e" else "warning", *x[2:].split(" ", 1)) for k, (_, some) in enumerate(samples.ISSUES) for x in some], "severity, type_name, code", len(samples.ISSUES)))
query("ecommerce_facts", _products, samples.answers([(k, *x) for k, (_, x) in enumerate(samples.PRODUCTS) if x], "price, currency, availability, sku, gtin, brand, has_image, has_review_or_rating", len(samples.PRODUCTS)))
query("sample_facts", _sample_facts, samples.answers([(k, n, v) for k, (_, x) in enumerate(samples.FACTS) for n, v in x.items()], "fact, value", len(samples.FACTS)))
query("url_functions", _urls, oracle.url_functions())
query("gtin_checksums", _gtins, oracle.gtins())
query("pixel_widths", _widths, oracle.pixel_widths())
query("row_filter", _row_filter, oracle.row_filter())
query("backlinks", _backlinks, oracle.backlinks())
query("outlink_details", lambda s, d: details.outlink_details(crawl(s, d)), oracle.outlink_details())
query("image_references", lambda s, d: details.image_references(crawl(s, d), "https://img.example/logo.png"), oracle.image_references())
query("rule_pages", lambda s, d: rules.marked(crawl(s, d)), oracle.rule_pages())
query("times_and_hosts", _times, oracle.TIMES)
query("resource_probes", _probes, oracle.PROBES)
query("fetch_counts", _fetches, oracle.FETCHES)
query("gated_pages", _gated, oracle.GATED)
query("merged_hreflang", _merged, oracle.MERGED)
query("known_urls", _known, oracle.known_urls())
query("sitemap_entries", _sitemap_files, oracle.SITEMAPS)
query("filters_sitestructure", _depth_filters, oracle.depth_filters())
query("filters_overview", _overview_filters, oracle.overview_filters())
query("filters_changes", _change_filters, oracle.change_filters())
query("view_layout", _layouts, oracle.layouts())
query("catalog", _catalog, oracle.CATALOG)
query("running_inlinks", lambda s, d: counts.running_inlinks(crawl(s, d)), oracle.running_inlinks())
query("analysed_site", _site, samples.site_answers())
query("analysed_site_issues", _site_issues, samples.site_issues())
query("inlinks", lambda s, d: graph.inlinks(graph.links(crawl(s, d))), oracle.inlinks())
query("outlinks", lambda s, d: graph.outlinks(graph.links(crawl(s, d))), oracle.outlinks())
query("click_depth", lambda s, d: graph.page_depths(*_root(s, d)), oracle.depths())
query("page_rank", lambda s, d: graph.page_rank(graph.links(crawl(s, d)).where("internal")).withColumn("score", F.round("score", 4)), oracle.page_rank())
query("hreflang_issues", lambda s, d: hreflang.issues(crawl(s, d)), oracle.hreflang())
query("near_duplicates", _near, oracle.near_duplicates())
query("event_windows", lambda s, d: counts.event_windows(s.read.parquet(f"{d}/events.parquet")).withColumn("total", F.round("total", 4)), oracle.EVENTS)
query("previous_crawls", _previous, oracle.PREVIOUS)
query("filter_counts", lambda s, d: counts.filter_counts(crawl(s, d), cross=False), oracle.badge_parts())
for _view in views.VIEWS:
    if _view != "Images":
        query(f"view_{_view.lower()}", lambda s, d, v=_view: views.view(complete(crawl(s, d)), v), oracle.view(_view, list(views.VIEWS[_view].columns)))
