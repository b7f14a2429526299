"""The named filters of the views.

A filter is a condition on a page record. Those marked `content` also need a page whose content an index would use, those marked `shape` a URL
that people navigate to. Filters that read other pages get what they need as columns from enrich(): counts by value, the site's name,
the rows that canonicals, redirects, images and links point at. Each such lookup is one aggregate or join, shared by all its filters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions import predicates as p
from crawlmill.functions import text as t
from crawlmill.functions import urls
from crawlmill.operators import redirects

c = F.col
#: Facts that many filters need, made once by enrich().
FACTS = {"_redirect": p.is_redirect, "_document": p.is_page_document, "_noindex": p.is_noindex, "_canonicalised": p.is_canonicalised}
ERROR, WARNING, NEUTRAL, OK = "error", "warning", "neutral", "ok"

#: The least and most characters and pixels of each field.
LENGTHS = {"title": (30, 60), "meta_description": (70, 160), "h1": (1, 70), "h2": (1, 70)}
PIXELS = {"title": (200, 580), "meta_description": (400, 970)}
FIELDS = {"PageTitles": "title", "MetaDesc": "meta_description", "H1": "h1", "H2": "h2"}
LOW_CONTENT = 200
LARGE_IMAGE = 100_000
LARGE_HTML = 2_000_000
LONG_URL = 115


@dataclass(frozen=True)
class Filter:
    condition: Callable[[], Column]
    tone: str = NEUTRAL
    content: bool = False
    shape: bool = False
    #: Reads other pages: must be counted anew when pages are added.
    cross: bool = False

    def column(self) -> Column:
        """The condition with its gates, never NULL. For a DataFrame from enrich()."""
        return _column(self)


@cache
def _column(f: Filter) -> Column:
    """Made once a process: columns name what they read and belong to no table, and a condition takes hundreds of calls to the JVM."""
    whole = p.yes(f.condition())
    if f.content:
        whole = whole & c("_eligible")
    if f.shape:
        whole = whole & ~urls.is_not_a_page_url(c("url"), c("is_resource"))
    return whole


@cache
def _fact(name: str) -> Column:
    return FACTS[name]()


def _field(name: str, what: str) -> Filter:
    low, high = LENGTHS[name]
    made = {
        "Missing": lambda: p.blank(c(name)),
        "Duplicate": lambda: (c(name) != "") & (c(f"_n_{name}") > 1),
        "OverLength": lambda: F.length(name) > high,
        "UnderLength": lambda: F.length(name).between(1, low - 1),
        "OverPixelWidth": lambda: c(f"{name}_pixel_width") > PIXELS[name][1],
        "UnderPixelWidth": lambda: c(f"{name}_pixel_width").between(1, PIXELS[name][0] - 1),
        "Multiple": lambda: (F.coalesce(c(f"{name}_count"), F.lit(0)) > 1 if name != "meta_description" else F.lit(False)) | c(f"{name}_2").isNotNull(),
        "HtmlEntity": lambda: t.contains_html_entity(c(name)),
    }
    return Filter(made[what], WARNING, content=True, cross=what == "Duplicate")


def _type(*names: str) -> Filter:
    return Filter(lambda: F.arrays_overlap("sd_types", F.array(*map(F.lit, names))))


def _hreflang(kind: str) -> Filter:
    return Filter(lambda: F.exists("hreflang_issues", lambda i: i["kind"] == kind), WARNING, content=True)


def _rule(name: str) -> Filter:
    return Filter(lambda: F.exists("a11y_issues", lambda i: i["rule"] == name), WARNING)


def _no_header(name: str) -> Filter:
    return Filter(lambda: ~p.has_header(name), WARNING)


def _product(condition: Callable[[], Column], tone: str = WARNING) -> Filter:
    return Filter(lambda: c("ecommerce").isNotNull() & condition(), tone)


def _image(condition: Callable[[Column], Column], content: bool = True) -> Filter:
    return Filter(lambda: F.exists("images", condition), WARNING, content=content)


def _link(condition: Callable[[Column], Column], tone: str = WARNING) -> Filter:
    return Filter(lambda: F.exists("outlinks", condition), tone)


def _kind(condition: Callable[[Column], Column]) -> Filter:
    return Filter(lambda: condition(c("content_type")))


def _known_kind() -> Column:
    k = F.coalesce("content_type", F.lit(""))
    return k.startswith("text/html") | k.startswith("image/") | k.contains("css") | k.contains("javascript") | k.contains("pdf") | p.yes(c("resource_initiator").isin("fetch", "xmlhttprequest"))


def _same(link: Column) -> Column:
    return urls.is_same_domain(link["dst_url"], c("url"))


_indexable_document = lambda: c("_document") & c("_indexable")
ALL = Filter(lambda: F.lit(True))
MISSING_ALT = lambda i: p.yes(i["has_alt_attr"]) & (F.coalesce(i["alt"], F.lit("")) == "")
NO_ALT = lambda i: ~p.yes(i["has_alt_attr"])
NO_SIZE = lambda i: i["width"].isNull() | i["height"].isNull()
LONG_ALT = lambda i: F.length(i["alt"]) > 100

FILTERS: dict[str, dict[str, Filter]] = {
    "Internal": {
        "NonIndexable": Filter(lambda: c("indexability") == "Non-Indexable", WARNING),
        "Html": _kind(lambda k: k.startswith("text/html")),
        "Images": _kind(lambda k: k.startswith("image/")),
        "Css": _kind(lambda k: k.contains("css")),
        "JavaScript": _kind(lambda k: k.contains("javascript")),
        "Pdf": _kind(lambda k: k.contains("pdf")),
        "FetchXhr": Filter(lambda: c("resource_initiator").isin("fetch", "xmlhttprequest")),
        "OtherResource": Filter(lambda: ~_known_kind()),
        "NotCached": Filter(lambda: c("is_resource") & c("is_internal") & (c("network_fetches") > 1), WARNING),
    },
    "External": {"Status4xx": Filter(lambda: c("status").between(400, 499), ERROR), "Status5xx": Filter(lambda: c("status") >= 500, ERROR)},
    "ResponseCodes": {
        "Status2xx": Filter(lambda: c("status").between(200, 299)),
        "Status3xx": Filter(lambda: c("status").between(300, 399)),
        "Status4xx": Filter(lambda: c("status").between(400, 499), ERROR),
        "Status5xx": Filter(lambda: c("status") >= 500, ERROR),
        "Redirects": Filter(lambda: c("_redirect"), WARNING),
        "RedirectChain": Filter(lambda: c("redirect_url").isNotNull() & c("_to_redirect"), ERROR, cross=True),
        "RedirectLoop": Filter(lambda: c("_in_loop"), ERROR, cross=True),
        "RedirectTemporary": Filter(lambda: c("_redirect") & p.redirect_code().isin(302, 303, 307), WARNING),
        "RedirectToError": Filter(lambda: c("_redirect") & (c("_end_status") >= 400), ERROR, cross=True),
    },
    "PageTitles": {
        **{k: _field("title", k) for k in ("Missing", "Duplicate", "OverLength", "UnderLength", "OverPixelWidth", "UnderPixelWidth", "Multiple")},
        "SameAsH1": Filter(lambda: (c("title") == c("h1")) & (c("title") != ""), WARNING, content=True),
        "HtmlEntity": _field("title", "HtmlEntity"),
        "RepeatsSiteName": Filter(lambda: t.names_site_twice(c("title"), c("_site_name")), WARNING, content=True, cross=True),
    },
    "MetaDesc": {k: _field("meta_description", k) for k in ("Missing", "Duplicate", "OverLength", "UnderLength", "OverPixelWidth", "UnderPixelWidth", "Multiple", "HtmlEntity")},
    "H1": {k: _field("h1", k) for k in ("Missing", "Duplicate", "OverLength", "Multiple", "HtmlEntity")},
    "H2": {**{k: _field("h2", k) for k in ("Missing", "Duplicate", "OverLength", "Multiple")}, "NonSequential": Filter(lambda: c("h2_non_sequential"), WARNING, content=True)},
    "Content": {
        "ExactDuplicates": Filter(lambda: c("_n_content_hash") > 1, ERROR, content=True, cross=True),
        "NearDuplicates": Filter(lambda: c("near_duplicate_count") > 0, WARNING, content=True),
        "LowContent": Filter(lambda: c("word_count").between(1, LOW_CONTENT - 1), WARNING, content=True),
        "SsrContentMissing": Filter(lambda: c("ssr_content_missing"), ERROR, content=True),
        "BlockedByRobots": Filter(lambda: c("blocked_by_robots"), ERROR),
        "MissingBodyTag": Filter(lambda: ~c("has_body_tag"), ERROR, content=True),
    },
    "Images": {
        "MissingAltText": _image(MISSING_ALT),
        "MissingAltAttribute": _image(NO_ALT),
        "AltOver100": _image(LONG_ALT, content=False),
        "MissingSizeAttributes": _image(NO_SIZE),
        "ImageOver100Kb": Filter(lambda: c("_large_image"), WARNING, cross=True),
        "ImageBroken": Filter(lambda: c("_broken_image"), ERROR, cross=True),
    },
    "Canonicals": {
        "ContainsCanonical": Filter(lambda: c("canonical") != ""),
        "SelfReferencing": Filter(lambda: (F.trim("canonical") != "") & ~c("_canonicalised")),
        "Canonicalised": Filter(lambda: c("_canonicalised"), WARNING),
        "MissingCanonical": Filter(lambda: p.blank(c("canonical")), WARNING, content=True),
        "CanonicalTargetNotIndexable": Filter(lambda: c("_canonicalised") & ~c("_target.indexable"), ERROR, cross=True),
        "CanonicalToRedirect": Filter(lambda: c("_canonicalised") & c("_target.redirect"), WARNING, cross=True),
        "CanonicalToError": Filter(lambda: c("_canonicalised") & ~c("_target.redirect") & (c("_target.status") >= 400), ERROR, cross=True),
        "CanonicalToHttp": Filter(lambda: c("url").startswith("https://") & (F.trim("canonical") != "") & F.lower(p.resolved_canonical()).startswith("http://"), WARNING),
        "CanonicalChain": Filter(lambda: c("_canonicalised") & c("_target.document") & c("_target.canonicalised"), WARNING, cross=True),
    },
    "Hreflang": {
        "ContainsHreflang": Filter(lambda: ~p.empty("hreflang_tags")),
        "MissingHreflang": Filter(lambda: p.empty("hreflang_tags"), WARNING, content=True),
        "HreflangMissingReturnTag": _hreflang("MissingReturnTag"),
        "HreflangInvalidLang": _hreflang("InvalidLanguageCode"),
        "HreflangMissingXDefault": _hreflang("MissingXDefault"),
        "HreflangMissingSelfReference": _hreflang("MissingSelfReference"),
        "HreflangNonCanonical": _hreflang("NonCanonicalUrl"),
    },
    "StructuredData": {
        "HasStructuredData": Filter(lambda: ~p.empty("sd_types")),
        "MissingStructuredData": Filter(lambda: p.empty("sd_types"), WARNING, content=True),
        "SdErrors": Filter(lambda: c("sd_errors") > 0, ERROR, content=True),
        "SdWarnings": Filter(lambda: c("sd_warnings") > 0, WARNING, content=True),
        "JsonLdUrls": Filter(lambda: c("sd_jsonld_count") > 0),
        "MicrodataUrls": Filter(lambda: c("sd_microdata_count") > 0),
        "ParseErrors": Filter(lambda: c("sd_errors") > 0, ERROR),
        "SdTypeArticle": _type("Article", "NewsArticle", "BlogPosting"),
        "SdTypeProduct": _type("Product"),
        "SdTypeFaq": _type("FAQPage"),
        "SdTypeHowTo": _type("HowTo"),
        "SdTypeRecipe": _type("Recipe"),
        "SdTypeVideo": _type("VideoObject", "Video"),
        "SdTypeBreadcrumb": _type("BreadcrumbList"),
        "SdTypeOrganization": _type("Organization", "LocalBusiness"),
    },
    "Accessibility": {f"A11y{k}": _rule(v) for k, v in {"ImageAlt": "image-alt", "Label": "label", "LinkName": "link-name", "ButtonName": "button-name", "ColorContrast": "color-contrast", "HtmlHasLang": "html-has-lang", "HeadingOrder": "heading-order"}.items()},
    "Performance": {
        "SlowLcp": Filter(lambda: c("lcp_ms") > 4000, WARNING, content=True),
        "SlowCls": Filter(lambda: c("cls") > 0.25, WARNING, content=True),
        "SlowFcp": Filter(lambda: c("fcp_ms") > 3000, WARNING),
        "SlowTtfb": Filter(lambda: c("ttfb_ms") > 1800, WARNING),
        "SlowResponse": Filter(lambda: c("response_time") > 1000, WARNING),
        "LargeHtml": Filter(lambda: c("size_bytes") > LARGE_HTML, WARNING),
    },
    "Ecommerce": {
        "IsProductPage": Filter(lambda: c("ecommerce").isNotNull()),
        **{f"Missing{k}": _product(lambda k=k: c(f"ecommerce.{k.lower()}").isNull()) for k in ("Price", "Availability", "Sku", "Gtin", "Brand")},
        "InvalidGtin": _product(lambda: c("ecommerce.gtin").isNotNull() & ~t.gtin_is_valid(c("ecommerce.gtin")), ERROR),
        "OutOfStockIndexable": _product(lambda: p.out_of_stock(c("ecommerce.availability")) & c("_indexable")),
        "MissingBreadcrumbs": _product(lambda: ~p.yes(F.array_contains("sd_types", "BreadcrumbList"))),
        "MissingReviewRating": _product(lambda: ~p.yes(c("ecommerce.has_review_or_rating"))),
        "MissingProductImage": _product(lambda: ~p.yes(c("ecommerce.has_image"))),
        "ProductLayoutWithoutMarkup": Filter(lambda: (c("layout.assignment") == "layout_without_markup") & (c("layout.template_type") == "Product"), WARNING),
    },
    "Sitemaps": {
        "UrlsInSitemap": Filter(lambda: c("in_sitemap")),
        "UrlsNotInSitemap": Filter(lambda: ~c("in_sitemap"), WARNING),
        "SitemapNon200": Filter(lambda: c("in_sitemap") & (c("_redirect") | p.yes(c("status") != 200)), ERROR),
        "SitemapOrphans": Filter(lambda: c("in_sitemap") & c("status").isNull(), ERROR),
        "NonIndexableInSitemap": Filter(lambda: c("in_sitemap") & (c("indexability") == "Non-Indexable"), WARNING),
        "CanonicalisedInSitemap": Filter(lambda: c("in_sitemap") & c("_document") & c("_canonicalised"), WARNING),
    },
    "Security": {
        "MissingHttps": Filter(lambda: ~c("url").startswith("https://"), ERROR),
        "MissingHsts": _no_header("strict-transport-security"),
        "MissingCsp": _no_header("content-security-policy"),
        "MissingFrameGuard": _no_header("x-frame-options"),
        "MissingContentTypeOptions": _no_header("x-content-type-options"),
        "MissingReferrerPolicy": Filter(lambda: F.coalesce(p.leaks_url(p.header("referrer-policy")), F.lit(True)), WARNING),
        "MixedContent": Filter(lambda: c("has_mixed_content"), ERROR),
    },
    "Url": {
        "UrlNonAscii": Filter(lambda: c("url").rlike(r"[^\x00-\x7F]"), WARNING, shape=True),
        "UrlUppercase": Filter(lambda: c("url").rlike("[A-Z]"), WARNING, shape=True),
        "UrlUnderscores": Filter(lambda: c("url").contains("_"), WARNING, shape=True),
        "UrlMultipleSlashes": Filter(lambda: urls.path_of(c("url")).contains("//"), WARNING, shape=True),
        "UrlParameters": Filter(lambda: c("url").contains("?"), WARNING, shape=True),
        "UrlOverLength": Filter(lambda: F.length("url") > LONG_URL, WARNING, shape=True),
        "UrlSpaces": Filter(lambda: c("url").contains(" "), WARNING, shape=True),
        "IndexableParameterUrl": Filter(lambda: c("url").contains("?") & _indexable_document(), WARNING),
    },
    "Directives": {
        "DirectiveNoindex": Filter(lambda: c("_noindex"), ERROR),
        "DirectiveNofollow": Filter(lambda: p.has_directive("nofollow"), WARNING),
        "DirectiveNoarchive": Filter(lambda: p.has_directive("noarchive"), WARNING),
        "DirectiveNosnippet": Filter(lambda: p.has_directive("nosnippet"), WARNING),
        "DirectiveNone": Filter(lambda: p.has_directive("none")),
    },
    "Links": {
        "LinkBroken": Filter(lambda: c("_broken_link"), ERROR, cross=True),
        "LinkRedirected": Filter(lambda: c("_redirected_link"), WARNING, cross=True),
        "LinkNofollow": _link(lambda x: F.lower(x["rel"]).contains("nofollow")),
        "LinkNoAnchorText": _link(lambda x: p.lacks_anchor(x["anchor"]) & _same(x)),
        "LinkExternal": _link(lambda x: ~_same(x), NEUTRAL),
        "LinkToHttp": Filter(lambda: c("url").startswith("https://") & F.exists("outlinks", lambda x: x["dst_url"].startswith("http://") & _same(x)), WARNING),
        "SingleInlink": Filter(lambda: c("inlinks_complete") & _indexable_document() & (c("unique_inlinks_count") == 1), WARNING),
        "NoInternalOutlinks": Filter(lambda: _indexable_document() & ~p.yes(F.exists("outlinks", _same)), WARNING),
    },
    # of the views whose rows aren't pages; their conditions read those rows
    "SiteStructure": {
        "DepthShallow": Filter(lambda: c("dir_depth") <= 1),
        "DepthMedium": Filter(lambda: c("dir_depth").between(2, 3)),
        "DepthDeep": Filter(lambda: c("dir_depth") >= 4, WARNING),
    },
    "Overview": {
        **{f"IssueType{k}": Filter(lambda v=v: c("issue_type") == v, tone) for k, v, tone in (("Error", "Issue", ERROR), ("Opportunity", "Opportunity", WARNING), ("Warning", "Warning", NEUTRAL))},
        **{f"Priority{k}": Filter(lambda k=k: c("priority") == k, tone) for k, tone in (("High", ERROR), ("Medium", WARNING), ("Low", NEUTRAL))},
    },
    "Changes": {
        **{f"Change{k}": Filter(lambda k=k: c("change_kind") == k, tone) for k, tone in (("Added", OK), ("Removed", ERROR), ("Changed", WARNING))},
        "ChangeLayout": Filter(lambda: c("layout_change").isNotNull(), WARNING),
    },
    "Layout": {"LayoutMissingMarkup": Filter(lambda: c("layout_missing_markup") > 0, WARNING), "LayoutChanged": Filter(lambda: c("layout_changed") > 0, WARNING)},
}
PAGE_VIEWS = [v for v in FILTERS if v not in ("SiteStructure", "Overview", "Changes", "Layout")]


#: By name: a column of values, and which pages count.
Repeats = dict[str, tuple[str, Callable[[], Column]]]


def repeated(pages: DataFrame, of: Repeats) -> DataFrame:
    """row_id and by name how many counted pages share the row's value, for rows whose value two of them share at least.

    All values go through one table of (name, value): one count, with partial counts before the shuffle, and one join. A value that very many
    pages share is split by Spark as any skewed join."""
    values = F.array(*(F.struct(F.lit(k).alias("k"), c(value).alias("v"), p.yes(counted()).alias("counted")) for k, (value, counted) in enumerate(of.values())))
    each = pages.select("row_id", F.explode(values).alias("x")).select("row_id", "x.k", "x.v", "x.counted").where(~p.blank(c("v")))
    counts = each.where("counted").groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = each.select("row_id", "k", "v").join(counts, ["k", "v"])
    return met.groupBy("row_id").agg(*(F.max(F.when(c("k") == k, c("n"))).alias(name) for k, name in enumerate(of)))


def gathered(pages: DataFrame, narrow: list[DataFrame]) -> DataFrame:
    """pages with the columns of narrow tables (row_id and facts of some rows): they are brought together first, so page records are joined once."""
    if not narrow:
        return pages
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), narrow)
    names = [n for n in union.columns if n != "row_id"]
    met = union.groupBy("row_id").agg(*(F.max(n).alias(n) for n in names)) if len(narrow) > 1 else union
    return pages.join(met, "row_id", "left")


def site_name(pages: DataFrame) -> DataFrame:
    """One row, _site_name: the suffix that more than half of the titled eligible internal pages share, and five of them at least."""
    titled = pages.where(c("is_internal") & c("_eligible") & ~p.blank(c("title")))
    counts = titled.groupBy(t.title_suffix(c("title")).alias("name")).agg(F.count("*").alias("n"))
    best = counts.agg(F.min_by("name", F.struct(F.when(c("name").isNull(), 0).otherwise(-c("n")), c("name"))).alias("name"), F.max(F.when(c("name").isNotNull(), c("n"))).alias("n"), F.sum("n").alias("all"))
    return best.select(F.when((c("n") >= t.LEAST_SITE_PAGES) & (c("n") * 2 > c("all")), c("name")).alias("_site_name"))


def with_facts(pages: DataFrame) -> DataFrame:
    """pages with the facts of FACTS, and with _indexable and _eligible, which follow from them; pages that have them stay as they are."""
    if "_eligible" in pages.columns:
        return pages
    known = pages.withColumns({k: _fact(k) for k in FACTS})
    good = p.yes(c("status").between(200, 299)) & ~c("_redirect") & ~c("_noindex") & ~c("_canonicalised")
    return known.withColumns({"_indexable": good, "_eligible": c("_document") & ~c("_noindex") & ~c("_canonicalised")})


def lookups(pages: DataFrame, wanted: Callable[..., bool], more: Repeats) -> list[DataFrame]:
    """What wanted filters read of other pages, each as a narrow table of row_id and facts."""
    fields = {f"{view}.Duplicate": field for view, field in FIELDS.items()} | {"Content.ExactDuplicates": "content_hash"}
    of: Repeats = {f"_n_{field}": (field, lambda: c("_eligible")) for name, field in fields.items() if wanted(name)} | more
    out = [repeated(pages, of)] if of else []
    key = urls.normalized_or_trimmed
    if wanted("Canonicals.CanonicalTargetNotIndexable", "Canonicals.CanonicalToRedirect", "Canonicals.CanonicalToError", "Canonicals.CanonicalChain"):
        facts = F.struct(c("_indexable").alias("indexable"), c("_redirect").alias("redirect"), c("status").alias("status"), c("_document").alias("document"), c("_canonicalised").alias("canonicalised"))
        asked = pages.where("_canonicalised").select("row_id", key(p.resolved_canonical()).alias("_k"))
        targets = pages.groupBy(key(c("url")).alias("_k")).agg(F.max_by(facts, c("row_id")).alias("_target"))  # of several rows the last
        out.append(asked.join(targets, "_k").select("row_id", "_target"))
    if wanted("ResponseCodes.RedirectChain", "ResponseCodes.RedirectLoop", "ResponseCodes.RedirectToError"):
        out.append(redirects.ways(pages))
    if wanted("Images.ImageOver100Kb", "Images.ImageBroken"):
        resources = pages.where("is_resource").groupBy(c("url").alias("_src")).agg(F.max_by("size_bytes", "row_id").alias("_s"), F.max_by(F.struct("status"), "row_id")["status"].alias("_st"))
        bad = resources.where((c("_s") > LARGE_IMAGE) | (c("_st") >= 400))
        hit = pages.select("row_id", F.explode(F.array_distinct(F.transform("images", lambda i: i["src"]))).alias("_src")).join(bad, "_src")
        out.append(hit.groupBy("row_id").agg(F.bool_or(p.yes(c("_s") > LARGE_IMAGE)).alias("_large_image"), F.bool_or(p.yes(c("_st") >= 400)).alias("_broken_image")))
    if wanted("Links.LinkBroken", "Links.LinkRedirected"):
        statuses = pages.where(c("status").isNotNull()).groupBy(c("url").alias("_dst")).agg(F.max_by("status", "row_id").alias("_st")).where("_st >= 300")
        hit = pages.select("row_id", F.explode(F.array_distinct(F.transform("outlinks", lambda x: x["dst_url"]))).alias("_dst")).join(statuses, "_dst")
        out.append(hit.groupBy("row_id").agg(F.bool_or(c("_st") >= 400).alias("_broken_link"), F.bool_or(c("_st").between(300, 399)).alias("_redirected_link")))
    return out


def enrich(pages: DataFrame, needs: set[str] | None = None, more: Repeats | None = None) -> DataFrame:
    """pages with what the filters named in needs (of "View.Filter"; None: all) read of other pages. more: further values to count."""
    wanted = lambda *names: needs is None or any(n in needs for n in names)
    pages = with_facts(pages)
    out = gathered(pages, lookups(pages, wanted, more or {}))
    if wanted("PageTitles.RepeatsSiteName"):
        out = out.crossJoin(F.broadcast(site_name(pages)))  # one row
    return out


def where(pages: DataFrame, view: str, name: str) -> DataFrame:
    """The pages of one filter; pages are those of the whole crawl, the view's base condition isn't applied."""
    f = ALL if name == "All" else FILTERS[view][name]
    return enrich(pages, {f"{view}.{name}"}).where(f.column()).select(*pages.columns)
