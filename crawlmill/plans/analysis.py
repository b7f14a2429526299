"""A crawl's fetched pages to finished page records: gating, extraction, the merges of other sources, then the passes over all pages.

Pages are parsed once and their facts stored; every pass reads the columns it needs and adds a narrow table that is joined by URL or row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill import schema
from crawlmill.functions import predicates as p
from crawlmill.functions import urls
from crawlmill.operators import details, extract, filters, graph, hreflang, similarity
from crawlmill.operators.graph import stored
from crawlmill.sources import sitemaps

c = F.col


def records(fetched: DataFrame, root: str, entries: DataFrame | None = None, known: frozenset[str] | None = None) -> DataFrame:
    """The page records of fetched pages, before the passes over all of them.

    fetched: row_id, url, final_url, status, content_type, headers, html. entries: loc, lastmod, sitemap, pos, alternates of the sitemaps."""
    pages = stored(details.gated(fetched, root), "gated")
    facts = extract.extract(pages.where("analysed"), keep=("row_id",), known=known).drop("url")
    out = pages.drop("html", "final_url").join(facts, "row_id", "left")
    out = out.withColumns({"has_body_tag": F.when(c("empty_document"), F.lit(False)).otherwise(c("has_body_tag")), "word_count": F.when(c("empty_document"), F.lit(0)).otherwise(c("word_count"))})
    out = out.withColumns({"is_internal": urls.is_same_domain(c("url"), F.lit(root)), "is_page": F.lit(True), "is_resource": F.lit(False), "size_bytes": F.octet_length("body_text").cast("long")})
    http = F.filter(F.coalesce("headers", F.array().cast(f"array<{schema.HEADER}>")), lambda h: F.lower(h["k"]) == "link")
    http = F.flatten(F.transform(http, lambda h: extract.hreflang_header(h["v"])))
    http = F.transform(http, lambda x: F.struct(x["lang"].alias("lang"), urls.resolve_url(c("url"), x["url"]).alias("url")))
    if entries is None:
        sitemap = F.lit(None).cast(f"array<{schema.HREFLANG}>")
    else:
        out = sitemaps.in_sitemap(out, entries)
        first = sitemaps.first_entries(entries, urls.normalized_or_trimmed(c("loc"))).select(c("_k"), c("alternates").alias("_alternates"))
        out = out.withColumn("_u", urls.normalized_or_trimmed(c("url"))).join(first, c("_u") == c("_k"), "left").drop("_u", "_k")
        sitemap = c("_alternates")
    analysed = c("analysed")
    tags, sources = details.merged_tags(F.when(analysed, c("hreflang_tags")), F.when(analysed, http), F.when(analysed, sitemap))
    out = out.withColumns({"hreflang_tags": tags, "hreflang_sources": sources})
    return stored(schema.complete(out.withColumn("indexability", p.indexability()).drop("_alternates", "analysed", "empty_document")), "records")


def passed(pages: DataFrame, root: str) -> DataFrame:
    """Page records with what passes over all of them find: inlinks, click depth, near duplicates and hreflang issues."""
    links = graph.links(pages)
    counted = graph.inlinks(links).select("url", *(c(a).cast("int").alias(b) for a, b in (("inlinks", "inlinks_count"), ("unique_inlinks", "unique_inlinks_count"), ("csr_inlinks", "csr_inlinks_count"), ("unique_csr_inlinks", "unique_csr_inlinks_count"))))
    depths = graph.page_depths(pages, root).groupBy("url").agg(F.min("depth").alias("depth"))
    texts = filters.with_facts(pages).where(c("_document") & (c("word_count") > 0)).select("row_id", "body_text")
    near = similarity.near_duplicates(texts, "row_id", "body_text")
    near = near.select("row_id", "closest_similarity", c("near_duplicate_count").cast("int").alias("near_duplicate_count"))
    counts = ["inlinks_count", "unique_inlinks_count", "csr_inlinks_count", "unique_csr_inlinks_count"]
    out = pages.drop(*counts, "depth", "closest_similarity", "near_duplicate_count")
    out = out.join(counted, "url", "left").fillna(0, counts).join(depths, "url", "left").join(near, "row_id", "left")
    return stored(hreflang.with_issues(out).withColumn("inlinks_complete", F.lit(True)), "passed")


def analysed(fetched: DataFrame, root: str, entries: DataFrame | None = None, known: frozenset[str] | None = None) -> DataFrame:
    """Finished page records of fetched pages: what the views, the overview and the badges read."""
    return passed(records(fetched, root, entries, known), root)
