"""The named views: which rows a view has, at which grain, and its columns.

Most views select pages and project. Five have rows of another grain: images (distinct source), structured data (item), accessibility
(violation), site structure (directory) and layout (template). Overview and changes are in rules and operators.changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions import predicates as p
from crawlmill.functions import text as t
from crawlmill.functions import urls
from crawlmill.operators import filters

c = F.col


@dataclass(frozen=True)
class View:
    base: Callable[[], Column]
    columns: dict[str, Callable[[], Column]]
    grain: str = "page"


_document = lambda: c("is_internal") & c("_document")
_fetched = lambda: c("is_internal") & p.was_fetched()


def _col(name: str) -> Callable[[], Column]:
    return lambda: c(name)


def _links(only: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.size(F.filter("outlinks", only)), F.lit(0))


def _unique(only: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.size(F.array_distinct(F.transform(F.filter("outlinks", only), lambda x: x["dst_url"]))), F.lit(0))


_any = lambda x: F.lit(True)
_csr = lambda x: p.yes(x["csr_only"])
_out = lambda x: ~urls.is_same_domain(x["dst_url"], c("url"))

COLUMNS: dict[str, Callable[[], Column]] = {
    "address": _col("url"), "content": _col("content_type"), "status_code": _col("status"), "indexability": _col("indexability"), "indexability_status": p.indexability_status,
    "status": lambda: F.when(c("blocked_by_robots"), "Blocked by robots.txt").when(c("status").isNull(), "Not fetched").otherwise(F.lit("OK")),
    "title": _col("title"), "title_2": _col("title_2"), "title_length": lambda: F.length("title"), "title_pixel_width": _col("title_pixel_width"),
    "meta_desc": _col("meta_description"), "meta_desc_2": _col("meta_description_2"), "meta_desc_length": lambda: F.length("meta_description"), "meta_desc_pixel_width": _col("meta_description_pixel_width"),
    "h1": _col("h1"), "h1_2": _col("h1_2"), "h1_length": lambda: F.length("h1"), "h2": _col("h2"), "h2_2": _col("h2_2"), "h2_length": lambda: F.length("h2"),
    "h2_sequence": lambda: F.when(c("h2_non_sequential"), "Non-Sequential").when(~c("h2_non_sequential"), "Sequential"),
    "robots": _col("robots"), "x_robots_tag": lambda: p.header("x-robots-tag"), "canonical": _col("canonical"), "size": _col("size_bytes"), "transfer_size": _col("transfer_bytes"),
    "response_time": _col("response_time"), "network_fetches": _col("network_fetches"), "revalidated_fetches": _col("revalidated_fetches"), "cache_control": lambda: p.header("cache-control"),
    "words": _col("word_count"), "depth": _col("depth"), "folder_depth": lambda: urls.folder_depth(urls.path_of(c("url"))),
    "inlinks": _col("inlinks_count"), "unique_inlinks": _col("unique_inlinks_count"), "csr_inlinks": _col("csr_inlinks_count"), "unique_csr_inlinks": _col("unique_csr_inlinks_count"),
    "csr_inlinks_pct": lambda: t.percent(c("csr_inlinks_count"), c("inlinks_count")),
    "outlinks_count": lambda: _links(_any), "unique_outlinks": lambda: _unique(_any), "external_outlinks": lambda: _links(_out), "unique_external_outlinks": lambda: _unique(_out),
    "csr_outlinks": lambda: _links(_csr), "unique_csr_outlinks": lambda: _unique(_csr), "external_csr_outlinks": lambda: _links(lambda x: _csr(x) & _out(x)),
    "unique_external_csr_outlinks": lambda: _unique(lambda x: _csr(x) & _out(x)), "csr_outlinks_pct": lambda: t.percent(_links(_csr), _links(_any)),
    "last_modified": lambda: p.header("last-modified"), "redirect_url": _col("redirect_url"), "redirect_type": lambda: F.when(c("_redirect"), F.coalesce(p.redirect_code().cast("string"), F.lit("HTTP Redirect"))),
    "closest_similarity": _col("closest_similarity"), "near_duplicate_count": _col("near_duplicate_count"), "link_score": _col("link_score"), "content_hash": _col("content_hash"),
    "ssr_words": _col("ssr_word_count"), "ssr_diff": lambda: t.ssr_diff_label(c("ssr_word_count"), c("word_count")), "body_tag": lambda: F.when(c("has_body_tag"), "Present").when(~c("has_body_tag"), "Missing"),
    "hreflang_count": lambda: F.coalesce(F.size("hreflang_tags"), F.lit(0)), "hreflang_sources": lambda: F.array_join(F.array_distinct("hreflang_sources"), ", "),
    "in_sitemap": _col("in_sitemap"), "sitemap_lastmod": _col("sitemap_lastmod"), "sitemap_url": _col("sitemap_url"), "a11y_errors": _col("a11y_errors"), "a11y_warnings": _col("a11y_warnings"),
    "sd_errors": _col("sd_errors"), "sd_warnings": _col("sd_warnings"), "ttfb": _col("ttfb_ms"), "fcp": _col("fcp_ms"), "lcp": _col("lcp_ms"), "cls": _col("cls"),
    **{f"ecom_{k}": _col(f"ecommerce.{k}") for k in ("price", "currency", "availability", "sku", "gtin", "brand", "has_image")}, "ecom_has_review": _col("ecommerce.has_review_or_rating"),
    "sec_https": lambda: c("url").startswith("https://"), "sec_hsts": lambda: p.has_header("strict-transport-security"), "sec_csp": lambda: p.has_header("content-security-policy"),
    "sec_frame_guard": lambda: p.has_header("x-frame-options"), "sec_content_type_opts": lambda: p.has_header("x-content-type-options"), "sec_referrer_policy": lambda: p.header("referrer-policy"),
    "sec_mixed_content": _col("has_mixed_content"), "url_length": lambda: F.length("url"), "occurrences": lambda: F.lit(None).cast("long"),
}


def _view(base: Callable[[], Column], names: str, grain: str = "page") -> View:
    return View(base, {n: COLUMNS[n] for n in ("address " + names + " indexability").split()}, grain)


VIEWS: dict[str, View] = {
    "Internal": _view(_fetched, "content status_code status indexability_status title title_length meta_desc meta_desc_length h1 h1_length h2 h2_length robots x_robots_tag canonical size transfer_size response_time network_fetches revalidated_fetches cache_control words depth folder_depth inlinks unique_inlinks csr_inlinks csr_inlinks_pct outlinks_count unique_outlinks external_outlinks unique_external_outlinks csr_outlinks csr_outlinks_pct last_modified redirect_url redirect_type closest_similarity near_duplicate_count link_score"),
    "External": _view(lambda: ~c("is_internal"), "content status_code status size"),
    "ResponseCodes": _view(p.was_fetched, "content status_code status indexability_status inlinks response_time redirect_url redirect_type"),
    "PageTitles": _view(_document, "title title_2 title_length title_pixel_width occurrences"),
    "MetaDesc": _view(_document, "meta_desc meta_desc_2 meta_desc_length meta_desc_pixel_width occurrences"),
    "H1": _view(_document, "h1 h1_2 h1_length occurrences"),
    "H2": _view(_document, "h2 h2_2 h2_length h2_sequence occurrences"),
    "Content": _view(lambda: c("is_internal") & (c("_document") | p.yes(c("blocked_by_robots"))), "content status_code content_hash words closest_similarity near_duplicate_count ssr_words ssr_diff body_tag"),
    "Images": _view(lambda: c("is_internal") & ~p.empty("images"), "", "image"),
    "Canonicals": _view(_document, "canonical occurrences"),
    "Hreflang": _view(_document, "hreflang_count hreflang_sources"),
    "StructuredData": _view(_document, "sd_errors sd_warnings", "item"),
    "Sitemaps": _view(lambda: c("is_internal") & (c("_document") | p.yes(c("in_sitemap"))), "content status_code status in_sitemap sitemap_lastmod sitemap_url"),
    "Accessibility": _view(_document, "a11y_errors a11y_warnings", "violation"),
    "Performance": _view(_document, "status_code ttfb fcp lcp cls response_time size"),
    "Ecommerce": _view(_document, "title ecom_price ecom_currency ecom_availability ecom_sku ecom_gtin ecom_brand ecom_has_image ecom_has_review status_code"),
    "Security": _view(lambda: _fetched() & ~p.empty("headers"), "sec_https sec_hsts sec_csp sec_frame_guard sec_content_type_opts sec_referrer_policy sec_mixed_content"),
    "Url": _view(_fetched, "content status_code url_length"),
    "Directives": _view(_document, "robots x_robots_tag"),
    "Links": _view(lambda: c("is_internal") & (~p.empty("outlinks") | (c("_document") & p.yes(c("status").between(200, 299)))), "inlinks unique_inlinks csr_inlinks unique_csr_inlinks outlinks_count unique_outlinks external_outlinks unique_external_outlinks csr_outlinks unique_csr_outlinks external_csr_outlinks unique_external_csr_outlinks"),
}
OCCURRENCES = {"PageTitles": "title", "MetaDesc": "meta_description", "H1": "h1", "H2": "h2", "Canonicals": "canonical"}
MOST_LANGUAGES = 10


def rows(pages: DataFrame, view: str, name: str = "All") -> DataFrame:
    """The page rows of a view under one of its filters, with the facts of filters.with_facts()."""
    f = filters.ALL if name == "All" else filters.FILTERS[view][name]
    enriched = filters.enrich(pages, {f"{view}.{name}"})
    return enriched.where(p.yes(VIEWS[view].base()) & f.column())


def view(pages: DataFrame, name: str, filter_name: str = "All") -> DataFrame:
    """A view's projected rows, row_id first."""
    if name == "Images":
        return image_rows(rows(pages, name), pages, filter_name)
    if name == "SiteStructure":
        return directory_rows(pages, filter_name)
    out, more = rows(pages, name, filter_name), {}
    if field := OCCURRENCES.get(name):
        counts = filters.with_facts(pages).where(c("_eligible") & ~p.blank(c(field))).groupBy(c(field).alias("_v")).agg(F.count("*").alias("_occurrences"))
        out = out.join(counts, c(field) == c("_v"), "left")
        more["occurrences"] = F.coalesce("_occurrences", F.lit(0))
    if name == "Hreflang":
        widest = min(MOST_LANGUAGES, out.agg(F.max(F.size("hreflang_tags"))).first()[0] or 0)  # one number
        more = {f"hreflang_{k + 1}{suffix}": F.get("hreflang_tags", F.lit(k))[part] for k in range(widest) for part, suffix in (("lang", ""), ("url", "_url"))}
    if name == "StructuredData":
        out = out.withColumn("_item", F.explode_outer("sd_items"))
        more = {"sd_format": c("_item.format"), "sd_type": c("_item.type_name")}
        if filter_name != "All":
            out = out.where(c("_item").isNotNull())  # a page without items keeps a row in the whole view only
    if name == "Accessibility":
        out = out.withColumn("_issue", F.explode_outer("a11y_issues"))
        more = {f"a11y_{k}": c(f"_issue.{k}") for k in ("rule", "impact", "target", "html")}
        if filter_name != "All":
            rule = {"A11yImageAlt": "image-alt", "A11yLabel": "label", "A11yLinkName": "link-name", "A11yButtonName": "button-name", "A11yColorContrast": "color-contrast", "A11yHtmlHasLang": "html-has-lang", "A11yHeadingOrder": "heading-order"}[filter_name]
            out = out.where(c("_issue.rule") == rule)
    return out.select("row_id", *(e().alias(n) for n, e in VIEWS[name].columns.items() if n not in more), *(e.alias(n) for n, e in more.items()))


IMAGE_FILTERS = {"MissingAltText": "_no_text", "MissingAltAttribute": "_no_alt", "AltOver100": "_long_alt", "MissingSizeAttributes": "_no_size"}


def image_rows(some: DataFrame, pages: DataFrame, filter_name: str = "All") -> DataFrame:
    """A row for each distinct image source that isn't inline: its references, first alt text and sizes, flags, and what its own request gave."""
    each = some.select("row_id", F.posexplode("images").alias("_pos", "i")).where(~F.lower(F.ltrim(c("i.src"))).startswith("data:"))
    order = F.struct("row_id", "_pos")
    first = lambda value: F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))
    flags = {"_no_text": filters.MISSING_ALT, "_no_alt": filters.NO_ALT, "_long_alt": filters.LONG_ALT, "_no_size": filters.NO_SIZE}
    by_source = each.groupBy(c("i.src").alias("image_src")).agg(
        F.min(order).alias("_first"), F.count("*").alias("image_inlinks"), F.count_distinct("row_id").alias("image_pages"), first(F.when(c("i.alt") != "", c("i.alt"))).alias("image_alt"),
        first(c("i.width")).alias("image_width"), first(c("i.height")).alias("image_height"), *(F.coalesce(F.bool_or(f(c("i"))), F.lit(False)).alias(k) for k, f in flags.items()),
    )
    resources = pages.where("is_resource").groupBy(c("url").alias("_u")).agg(F.max_by(F.struct("status", "size_bytes"), "row_id").alias("_r"))
    out = by_source.join(resources, c("image_src") == c("_u"), "left").withColumns({"image_status": c("_r.status"), "image_size": F.coalesce("_r.size_bytes", F.lit(0))})
    if filter_name in IMAGE_FILTERS:
        out = out.where(IMAGE_FILTERS[filter_name])
    elif filter_name != "All":
        out = out.where(p.yes(c("image_size") > filters.LARGE_IMAGE if filter_name == "ImageOver100Kb" else c("image_status") >= 400))
    return out.select("image_src", "image_alt", "image_inlinks", "image_pages", "image_status", "image_size", "image_width", "image_height", (~c("_no_alt")).alias("image_has_alt"), c("_first.row_id").alias("first_row"))


def directory_rows(pages: DataFrame, filter_name: str = "All", root: str | None = None) -> DataFrame:
    """A row for each directory of internal pages: of URLs without the root's origin (others stay whole), or of all paths without a root."""
    origin = urls.origin_of(F.lit(root)) if root else None
    path = urls.path_of(c("url")) if root is None else F.when(c("url").startswith(origin), F.substr(c("url"), F.length(origin) + 1)).otherwise(c("url"))
    inside = filters.with_facts(pages).where(p.yes(c("is_internal")) & p.yes(c("is_page")) & ~p.yes(c("is_resource")))
    words = F.sum(F.coalesce("word_count", F.lit(0)))
    out = inside.groupBy(urls.directory_path(path).alias("dir_path")).agg(
        F.count("*").alias("dir_page_count"), F.floor(words / F.count("*")).alias("dir_avg_words"), F.sum("size_bytes").alias("dir_total_size"),
        F.count_if(~p.yes(c("indexability") == "Non-Indexable")).alias("dir_indexable"), F.count_if(c("indexability") == "Non-Indexable").alias("dir_non_indexable"),
    )
    out = out.withColumn("dir_depth", urls.folder_depth(c("dir_path")))
    return out if filter_name == "All" else out.where(filters.FILTERS["SiteStructure"][filter_name].condition())


def flags(pages: DataFrame, view_name: str) -> DataFrame:
    """row_id and, for each filter of a view, 1 where it holds: all filters of a view in one pass."""
    of = filters.FILTERS[view_name]
    enriched = filters.enrich(pages, {f"{view_name}.{n}" for n in of}).where(p.yes(VIEWS[view_name].base()))
    return enriched.select("row_id", *(f.column().cast("int").alias(n) for n, f in of.items()))
