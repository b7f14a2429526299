"""The issue rules: a row a rule with its count and share. All page rules are counted in one pass over the enriched pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill.functions import predicates as p
from crawlmill.operators import filters
from crawlmill.plans import views

c = F.col
ISSUE, WARNING, OPPORTUNITY = "Issue", "Warning", "Opportunity"
HIGH, MEDIUM, LOW = "High", "Medium", "Low"

#: Populations, by the denominator's name.
POPULATIONS: dict[str, Callable[[], Column]] = {
    "documents": lambda: c("_eligible") & p.yes(c("is_internal")) & p.was_fetched(),
    "internal": lambda: p.yes(c("is_internal")) & p.was_fetched(),
    "all": lambda: F.lit(True),
    "known_internal": lambda: p.yes(c("is_internal")),
    "with_headers": lambda: p.yes(c("is_internal")) & p.was_fetched() & ~p.empty("headers"),
    "sitemap": lambda: p.yes(c("in_sitemap")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    priority: str
    population: str
    #: A condition of the population's rows, or a view and a filter whose rows are counted.
    condition: Callable[[], Column] | None = None
    view: str = ""
    filter: str = ""


def _twice(field: str) -> Callable[[], Column]:
    return lambda: c(f"_doc_{field}") > 1


def _issue(kind: str) -> Callable[[], Column]:
    return lambda: F.exists("hreflang_issues", lambda i: i["kind"] == kind)


_BUILT = [
    ("Missing Page Title", ISSUE, HIGH, "documents", lambda: p.blank(c("title"))),
    ("Duplicate Page Title", ISSUE, HIGH, "documents", _twice("title")),
    ("Page Title Over 60 Characters", WARNING, MEDIUM, "documents", lambda: F.length("title") > 60),
    ("Missing Meta Description", OPPORTUNITY, MEDIUM, "documents", lambda: p.blank(c("meta_description"))),
    ("Duplicate Meta Description", ISSUE, MEDIUM, "documents", _twice("meta_description")),
    ("Missing H1", ISSUE, HIGH, "documents", lambda: p.blank(c("h1"))),
    ("Duplicate H1", WARNING, LOW, "documents", _twice("h1")),
    ("Non-Indexable Pages", WARNING, HIGH, "internal", lambda: c("indexability") == "Non-Indexable"),
    ("HTTP Errors (4xx/5xx)", ISSUE, HIGH, "all", lambda: c("status") >= 400),
    ("Redirects", WARNING, MEDIUM, "all", lambda: c("_redirect")),
    ("Structured Data Errors", ISSUE, HIGH, "documents", lambda: c("sd_errors") > 0),
    ("Near Duplicate Content", OPPORTUNITY, MEDIUM, "documents", lambda: c("near_duplicate_count") > 0),
    ("Low Content Pages", OPPORTUNITY, MEDIUM, "documents", lambda: c("word_count").between(1, filters.LOW_CONTENT - 1)),
    ("Content Requires JavaScript (SSR)", ISSUE, HIGH, "documents", lambda: c("ssr_content_missing")),
    ("Blocked by robots.txt", ISSUE, HIGH, "known_internal", lambda: c("blocked_by_robots")),
    ("Slow Largest Contentful Paint", ISSUE, HIGH, "documents", lambda: c("lcp_ms") > 4000),
    ("High Cumulative Layout Shift", ISSUE, MEDIUM, "documents", lambda: c("cls") > 0.25),
    ("Accessibility Critical & Serious Issues", ISSUE, HIGH, "documents", lambda: F.exists("a11y_issues", lambda i: i["impact"].isin("critical", "serious"))),
    ("Missing HTTPS", ISSUE, HIGH, "with_headers", lambda: ~c("url").startswith("https://")),
    ("Missing HSTS Header", WARNING, LOW, "with_headers", lambda: ~p.has_header("strict-transport-security")),
    ("Mixed Content", ISSUE, HIGH, "with_headers", lambda: c("has_mixed_content")),
    ("Hreflang Missing Return Tags", ISSUE, HIGH, "documents", _issue("MissingReturnTag")),
    ("Hreflang Invalid Language Codes", ISSUE, MEDIUM, "documents", _issue("InvalidLanguageCode")),
    ("Hreflang Missing x-default", WARNING, LOW, "documents", _issue("MissingXDefault")),
    ("Hreflang Non-Canonical Targets", ISSUE, HIGH, "documents", _issue("NonCanonicalUrl")),
    ("Internal Outlinks With No Anchor Text", OPPORTUNITY, LOW, "documents", lambda: filters.FILTERS["Links"]["LinkNoAnchorText"].condition()),
]
_FILTERED = [
    ("Page Title Below 30 Characters", OPPORTUNITY, LOW, "PageTitles.UnderLength", "documents"),
    ("Page Title Below 200 Pixels", OPPORTUNITY, LOW, "PageTitles.UnderPixelWidth", "documents"),
    ("Meta Description Below 70 Characters", OPPORTUNITY, LOW, "MetaDesc.UnderLength", "documents"),
    ("Meta Description Below 400 Pixels", OPPORTUNITY, LOW, "MetaDesc.UnderPixelWidth", "documents"),
    ("Missing H2", OPPORTUNITY, LOW, "H2.Missing", "documents"),
    ("Duplicate H2", OPPORTUNITY, LOW, "H2.Duplicate", "documents"),
    ("H2 Over 70 Characters", OPPORTUNITY, LOW, "H2.OverLength", "documents"),
    ("Non-Sequential H2", WARNING, LOW, "H2.NonSequential", "documents"),
    ("Multiple H1", WARNING, LOW, "H1.Multiple", "documents"),
    ("Page Title Contains HTML Entity", WARNING, MEDIUM, "PageTitles.HtmlEntity", "documents"),
    ("Page Title Repeats Site Name", WARNING, LOW, "PageTitles.RepeatsSiteName", "documents"),
    ("Meta Description Contains HTML Entity", WARNING, MEDIUM, "MetaDesc.HtmlEntity", "documents"),
    ("H1 Contains HTML Entity", WARNING, LOW, "H1.HtmlEntity", "documents"),
    ("Canonicalised", WARNING, MEDIUM, "Canonicals.Canonicalised", "documents"),
    ("Non-200 URLs in Sitemap", ISSUE, HIGH, "Sitemaps.SitemapNon200", "sitemap"),
    ("Non-Indexable URLs in Sitemap", WARNING, MEDIUM, "Sitemaps.NonIndexableInSitemap", "sitemap"),
    ("Sitemap URLs Not Crawled", WARNING, MEDIUM, "Sitemaps.SitemapOrphans", "sitemap"),
    ("Images Over 100 kB", OPPORTUNITY, MEDIUM, "Images.ImageOver100Kb", "images"),
    ("Broken Images", ISSUE, HIGH, "Images.ImageBroken", "images"),
    ("Images Missing Alt Text", ISSUE, MEDIUM, "Images.MissingAltText", "images"),
    ("Images Missing Alt Attribute", ISSUE, MEDIUM, "Images.MissingAltAttribute", "images"),
    ("Images Missing Size Attributes", OPPORTUNITY, LOW, "Images.MissingSizeAttributes", "images"),
    ("URLs with Parameters", OPPORTUNITY, LOW, "Url.UrlParameters", "internal"),
    ("Uppercase URLs", WARNING, LOW, "Url.UrlUppercase", "internal"),
    ("Missing X-Frame-Options", WARNING, LOW, "Security.MissingFrameGuard", "internal"),
    ("Missing X-Content-Type-Options", WARNING, LOW, "Security.MissingContentTypeOptions", "internal"),
    ("Missing Referrer-Policy", WARNING, LOW, "Security.MissingReferrerPolicy", "internal"),
    ("Multiple H2", OPPORTUNITY, LOW, "H2.Multiple", "documents"),
    ("Hreflang Missing Self Reference", WARNING, MEDIUM, "Hreflang.HreflangMissingSelfReference", "documents"),
    ("Missing Canonical Tag", OPPORTUNITY, MEDIUM, "Canonicals.MissingCanonical", "documents"),
    ("Missing <body> Tag", ISSUE, HIGH, "Content.MissingBodyTag", "documents"),
    ("Noindex", WARNING, MEDIUM, "Directives.DirectiveNoindex", "documents"),
    ("Missing Content-Security-Policy", WARNING, LOW, "Security.MissingCsp", "internal"),
    ("Redirect Chains", ISSUE, MEDIUM, "ResponseCodes.RedirectChain", "internal"),
    ("Canonical to Non-Indexable Page", ISSUE, HIGH, "Canonicals.CanonicalTargetNotIndexable", "documents"),
    ("Indexable Parameter URLs", WARNING, MEDIUM, "Url.IndexableParameterUrl", "documents"),
    ("Out of Stock Products", OPPORTUNITY, LOW, "Ecommerce.OutOfStockIndexable", "documents"),
    ("Invalid GTIN", ISSUE, HIGH, "Ecommerce.InvalidGtin", "documents"),
    ("Product Pages Missing Breadcrumbs", OPPORTUNITY, LOW, "Ecommerce.MissingBreadcrumbs", "documents"),
    ("Product Layout Without Product Markup", ISSUE, HIGH, "Ecommerce.ProductLayoutWithoutMarkup", "documents"),
    ("Temporary Redirects", WARNING, LOW, "ResponseCodes.RedirectTemporary", "internal"),
    ("Redirects to an Error", ISSUE, HIGH, "ResponseCodes.RedirectToError", "internal"),
    ("HTTPS Pages Linking to HTTP", WARNING, MEDIUM, "Links.LinkToHttp", "documents"),
    ("Pages With One Inlink", OPPORTUNITY, LOW, "Links.SingleInlink", "documents"),
    ("Pages Without Internal Outlinks", WARNING, LOW, "Links.NoInternalOutlinks", "documents"),
    ("Canonical Points to a Redirect", WARNING, MEDIUM, "Canonicals.CanonicalToRedirect", "documents"),
    ("Canonical Points to an Error", ISSUE, HIGH, "Canonicals.CanonicalToError", "documents"),
    ("Canonical Points to HTTP", WARNING, MEDIUM, "Canonicals.CanonicalToHttp", "documents"),
    ("Canonical Chains", WARNING, MEDIUM, "Canonicals.CanonicalChain", "documents"),
    ("Canonicalised URLs in Sitemap", WARNING, MEDIUM, "Sitemaps.CanonicalisedInSitemap", "sitemap"),
    ("Slow HTML Response", WARNING, MEDIUM, "Performance.SlowResponse", "documents"),
    ("HTML Over 2 MB", WARNING, LOW, "Performance.LargeHtml", "documents"),
    ("Assets Not Cached", WARNING, MEDIUM, "Internal.NotCached", "internal"),
]
RULES = [Rule(n, k, pr, pop, condition=f) for n, k, pr, pop, f in _BUILT] + [Rule(n, k, pr, pop, None, *vf.split(".")) for n, k, pr, vf, pop in _FILTERED]


_DOCUMENT_COUNTS: filters.Repeats = {f"_doc_{field}": (field, POPULATIONS["documents"]) for field in ("title", "meta_description", "h1")}


def _enriched(pages: DataFrame) -> DataFrame:
    return filters.enrich(pages, {f"{r.view}.{r.filter}" for r in RULES if r.view and r.view != "Images"}, _DOCUMENT_COUNTS)


@cache
def _holds(rule: Rule) -> Column:
    if rule.condition is not None:
        return POPULATIONS[rule.population]() & p.yes(rule.condition())
    return p.yes(views.VIEWS[rule.view].base()) & filters.FILTERS[rule.view][rule.filter].column()


def marked(pages: DataFrame) -> DataFrame:
    """row_id, rule_no: each page with each rule about pages that it breaks, in one pass. What a rule counts are its rows here."""
    some = F.array(*(F.when(_holds(r), F.lit(k + 1)) for k, r in enumerate(RULES) if r.view != "Images"))
    return _enriched(pages).select("row_id", F.explode(F.array_compact(some)).alias("rule_no"))


def overview(pages: DataFrame) -> DataFrame:
    """rule_no, issue_name, issue_type, priority, count, population, pct (of the population, 2 decimals): a row for each of the 79 rules."""
    by_page = [r for r in RULES if r.view != "Images"]
    enriched = _enriched(pages)
    # the conditions become columns, a bit each, before they are added up: one narrow pass instead of one vast expression
    marks = [_holds(r) for r in by_page]
    sums = enriched.select(*(m.cast("int").alias(f"m{k}") for k, m in enumerate(marks)), *(f().cast("int").alias(f"p_{k}") for k, f in POPULATIONS.items())).agg(
        *(F.coalesce(F.sum(f"m{k}"), F.lit(0)).alias(f"m{k}") for k in range(len(marks))), *(F.coalesce(F.sum(f"p_{k}"), F.lit(0)).alias(f"p_{k}") for k in POPULATIONS)
    )
    image_conditions = {"ImageOver100Kb": c("image_size") > filters.LARGE_IMAGE, "ImageBroken": c("image_status") >= 400, **{k: c(v) for k, v in views.IMAGE_FILTERS.items()}}
    pictures = _image_flags(pages).agg(F.count("*").alias("p_images"), *(F.count_if(p.yes(v)).alias(f"i_{k}") for k, v in image_conditions.items()))
    one = sums.crossJoin(pictures)  # a row and a row
    place = {id(r): k for k, r in enumerate(by_page)}
    listed = F.array(
        *(
            F.struct(
                F.lit(k + 1).alias("rule_no"), F.lit(r.name).alias("issue_name"), F.lit(r.kind).alias("issue_type"), F.lit(r.priority).alias("priority"),
                (c(f"i_{r.filter}") if r.view == "Images" else c(f"m{place[id(r)]}")).alias("count"), F.greatest(c(f"p_{r.population}"), F.lit(1)).alias("population"),
            )
            for k, r in enumerate(RULES)
        )
    )
    rows = one.select(F.explode(listed).alias("r")).select("r.*")
    return rows.withColumn("pct", F.round(F.lit(100.0) * c("count") / c("population"), 2))


def pages_of(pages: DataFrame, rule_name: str) -> DataFrame:
    """The rows behind a rule's count: page rows, or for rules about images rows of the image view."""
    rule = next(r for r in RULES if r.name == rule_name)
    if rule.view == "Images":
        return views.view(pages, "Images", rule.filter)
    if rule.view:
        return views.rows(pages, rule.view, rule.filter).select(*pages.columns)
    enriched = filters.enrich(pages, set(), _DOCUMENT_COUNTS)
    return enriched.where(POPULATIONS[rule.population]() & p.yes(rule.condition())).select(*pages.columns)


def _image_flags(pages: DataFrame) -> DataFrame:
    some = filters.with_facts(pages).where(p.yes(views.VIEWS["Images"].base()))
    each = some.select(F.explode("images").alias("i")).where(~F.lower(F.ltrim(c("i.src"))).startswith("data:"))
    flags = {"_no_text": filters.MISSING_ALT, "_no_alt": filters.NO_ALT, "_long_alt": filters.LONG_ALT, "_no_size": filters.NO_SIZE}
    by_source = each.groupBy(c("i.src").alias("src")).agg(*(F.bool_or(p.yes(f(c("i")))).alias(k) for k, f in flags.items()))
    resources = pages.where("is_resource").groupBy(c("url").alias("src")).agg(F.max_by(F.struct("status", "size_bytes"), "row_id").alias("_r"))
    return by_source.join(resources, "src", "left").withColumns({"image_status": c("_r.status"), "image_size": c("_r.size_bytes")})


def ordered(overview_rows: DataFrame) -> DataFrame:
    """By type, priority, most counts first; rules that count alike in their own order."""
    kind = F.when(c("issue_type") == ISSUE, 0).when(c("issue_type") == WARNING, 1).otherwise(2)
    level = F.when(c("priority") == HIGH, 0).when(c("priority") == MEDIUM, 1).otherwise(2)
    return overview_rows.orderBy(kind, level, F.desc("count"), "rule_no")


def compared(now: DataFrame, then: DataFrame) -> DataFrame:
    """The overview with count_prev and count_delta from an earlier crawl's; a rule absent then has an empty count_prev and counts as 0."""
    previous = then.select("issue_name", c("count").alias("count_prev"))
    return now.join(previous, "issue_name", "left").withColumn("count_delta", c("count") - F.coalesce("count_prev", F.lit(0)))


def badges(pages: DataFrame) -> DataFrame:
    """view_name, total, errors, warnings: rows of each page view, those that an error filter selects, and those that only warnings do."""
    names = list(filters.PAGE_VIEWS)
    enriched = filters.enrich(pages)
    masks = []
    for v in names:
        inside = p.yes(views.VIEWS[v].base())
        any_of = lambda tone, v=v: F.exists(F.array(F.lit(False), *(f.column() for f in filters.FILTERS[v].values() if f.tone == tone)), lambda x: x)
        masks += [inside.alias(f"{v}_total"), (inside & any_of(filters.ERROR)).alias(f"{v}_error"), (inside & any_of(filters.WARNING)).alias(f"{v}_warning")]
    marked = enriched.select(*masks)
    counts = marked.agg(*(F.count_if(x).alias(n) for v in names for n, x in ((f"{v}_n", c(f"{v}_total")), (f"{v}_e", c(f"{v}_error")), (f"{v}_w", c(f"{v}_warning") & ~c(f"{v}_error")))))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view_name"), c(f"{v}_n").alias("total"), c(f"{v}_e").alias("errors"), c(f"{v}_w").alias("warnings")) for v in names))).alias("r")).select("r.*")
