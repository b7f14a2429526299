"""DuckDB SQL for the library's queries, written apart from the Spark code over the same derived crawl."""

from __future__ import annotations

from crawlmill.functions import text as t
from crawlmill.operators import filters as f
from crawlmill.sources.derived import Dialect, select

_NORM = "replace(regexp_replace({u}, '#.*$', ''), ' ', '%20')"


def norm(u: str) -> str:
    """The derived crawl's URLs have lower-case hosts, no ports and a path."""
    return _NORM.format(u=u)


def host(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '')"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def any_(array: str, cond: str) -> str:
    return f"(len(list_filter({array}, lambda x: coalesce({cond}, false))) > 0)"


def _has(name: str) -> str:
    return any_("headers", f"lower(x.k) = '{name}'")


def _first_header(name: str) -> str:
    return f"(list_filter(headers, lambda x: lower(x.k) = '{name}'))[1].v"


_TOKENS = "list_concat(CASE WHEN robots IS NULL THEN [] ELSE [robots] END, list_transform(list_filter(headers, lambda x: lower(x.k) = 'x-robots-tag'), lambda x: x.v))"
_DIRECTIVES = f"list_filter(flatten(list_transform({_TOKENS}, lambda v: list_transform(string_split(regexp_replace(v, '^\\s*[A-Za-z0-9_*-]+\\s*:', ''), ','), lambda y: lower(trim(y))))), lambda z: z <> '')"
_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_GTIN_DIGITS = "regexp_replace(ecommerce.gtin, '[ -]', '', 'g')"
_GTIN_SUM = f"list_sum(list_transform(range(1, length({_GTIN_DIGITS}) + 1), lambda i: try_cast(substr(reverse({_GTIN_DIGITS}), i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))"


def crawl() -> str:
    """CTEs: d (records), k (with facts), r (raw hops), ends of redirects, and e (all that filters need)."""
    field_counts = "".join(f", n_{v} AS (SELECT {v} AS v, count(*) AS n_{v} FROM k WHERE eligible AND coalesce({v}, '') <> '' GROUP BY 1)" for v in ("title", "meta_description", "h1", "h2", "content_hash", "canonical"))
    joins = "".join(f" LEFT JOIN n_{v} ON n_{v}.v = k.{v}" for v in ("title", "meta_description", "h1", "h2", "content_hash", "canonical"))
    seps = "|".join(("\\|", "-", "–", "—", "·", "•", "»", "::", "/"))
    return f"""
WITH RECURSIVE d AS ({select(Dialect(True))}),
d1 AS (SELECT *, {_DIRECTIVES} AS directives, CASE WHEN trim(canonical) = '' THEN NULL WHEN starts_with(canonical, '/') THEN {_ORIGIN} || canonical ELSE canonical END AS resolved,
  redirect_url IS NOT NULL OR coalesce(status BETWEEN 300 AND 399, false) AS redirect FROM d),
k0 AS (SELECT *, list_contains(directives, 'noindex') OR list_contains(directives, 'none') AS noindex, coalesce({norm("resolved")} <> {norm("url")}, false) AS canonicalised,
  is_page AND NOT is_resource AND NOT redirect AND coalesce(lower(trim(string_split(content_type, ';')[1])) IN ('', 'text/html', 'application/xhtml+xml'), true) AS document FROM d1),
k AS (SELECT *, coalesce(status BETWEEN 200 AND 299, false) AND NOT redirect AND NOT noindex AND NOT canonicalised AS indexable, document AND NOT noindex AND NOT canonicalised AS eligible, {norm("url")} AS nurl FROM k0)
{field_counts},
titled AS (SELECT title, lower(regexp_replace(CASE WHEN regexp_matches(title, ' ({seps}) ') THEN regexp_extract(title, '^.* (?:{seps}) (.*)$', 1) END, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS name FROM k WHERE is_internal AND eligible AND coalesce(title, '') <> ''),
site AS (SELECT CASE WHEN n >= {t.LEAST_SITE_PAGES} AND n * 2 > (SELECT count(*) FROM titled) THEN name END AS site_name FROM (SELECT name, count(*) AS n FROM titled WHERE name IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 1)),
target AS (SELECT nurl AS t_url, arg_max(indexable, row_id) AS t_indexable, arg_max(redirect, row_id) AS t_redirect, arg_max(coalesce(status, -1), row_id) AS t_status, arg_max(document, row_id) AS t_document, arg_max(canonicalised, row_id) AS t_canonicalised FROM k GROUP BY 1),
hop AS (SELECT nurl AS node, nullif(arg_max(coalesce({norm("redirect_url")}, ''), row_id), '') AS dest FROM k GROUP BY 1),
walk AS (SELECT node AS origin, dest AS at FROM hop WHERE dest IS NOT NULL UNION SELECT w.origin, h.dest FROM walk w JOIN hop h ON h.node = w.at WHERE h.dest IS NOT NULL),
stop AS (SELECT w.origin, t.t_status AS end_status FROM walk w JOIN target t ON t.t_url = w.at WHERE NOT t.t_redirect),
rawhop AS (SELECT url AS node, arg_max(redirect_url, row_id) AS dest FROM k WHERE redirect_url IS NOT NULL GROUP BY 1),
rawwalk AS (SELECT node AS origin, dest AS at FROM rawhop UNION SELECT w.origin, h.dest FROM rawwalk w JOIN rawhop h ON h.node = w.at),
looped AS (SELECT DISTINCT w.origin FROM rawwalk w WHERE w.at IN (SELECT x.origin FROM rawwalk x WHERE x.origin = x.at)),
res AS (SELECT url AS src, arg_max(size_bytes, row_id) AS res_size, arg_max(coalesce(status, -1), row_id) AS res_status FROM k WHERE is_resource GROUP BY 1),
pic AS (SELECT row_id, bool_or(res_size > {f.LARGE_IMAGE}) AS large_image, bool_or(res_status >= 400) AS broken_image FROM (SELECT row_id, unnest(images).src AS src FROM k) JOIN res USING (src) GROUP BY 1),
st AS (SELECT url AS dst, arg_max(status, row_id) AS st FROM k WHERE status IS NOT NULL GROUP BY 1),
lnk AS (SELECT row_id, bool_or(st >= 400) AS broken_link, bool_or(st BETWEEN 300 AND 399) AS redirected_link FROM (SELECT row_id, unnest(outlinks).dst_url AS dst FROM k) JOIN st USING (dst) GROUP BY 1),
e AS (SELECT k.*, n_title, n_meta_description, n_h1, n_h2, n_content_hash, n_canonical, site_name, t.*, n2.t_redirect AS to_redirect, end_status, looped.origin IS NOT NULL AS in_loop, large_image, broken_image, broken_link, redirected_link,
  'x ' || trim(regexp_replace(lower(k.title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS title_words
  FROM k{joins} LEFT JOIN site ON true LEFT JOIN target t ON k.canonicalised AND t.t_url = {norm("k.resolved")} LEFT JOIN target n2 ON n2.t_url = {norm("k.redirect_url")}
  LEFT JOIN stop ON stop.origin = k.nurl LEFT JOIN looped ON looped.origin = k.url LEFT JOIN pic ON pic.row_id = k.row_id LEFT JOIN lnk ON lnk.row_id = k.row_id)
"""


def _field(v: str, low: int, high: int) -> dict[str, tuple[str, str]]:
    return {
        "Missing": (f"coalesce({v}, '') = ''", "C"), "Duplicate": (f"n_{v} > 1", "C"), "OverLength": (f"length({v}) > {high}", "C"), "UnderLength": (f"length({v}) BETWEEN 1 AND {low - 1}", "C"),
        "Multiple": ((f"{v}_count > 1 OR " if v != "meta_description" else "") + f"{v}_2 IS NOT NULL", "C"), "HtmlEntity": (f"regexp_matches({v}, '&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);')", "C"),
    }


def _pixels(v: str, low: int, high: int) -> dict[str, tuple[str, str]]:
    return {"OverPixelWidth": (f"{v}_pixel_width > {high}", "C"), "UnderPixelWidth": (f"{v}_pixel_width BETWEEN 1 AND {low - 1}", "C")}


_TYPE = "coalesce(content_type, '')"
_KINDS = {"Html": f"starts_with({_TYPE}, 'text/html')", "Images": f"starts_with({_TYPE}, 'image/')", "Css": f"contains({_TYPE}, 'css')", "JavaScript": f"contains({_TYPE}, 'javascript')", "Pdf": f"contains({_TYPE}, 'pdf')", "FetchXhr": "coalesce(resource_initiator, '') IN ('fetch', 'xmlhttprequest')"}
_SAME = f"{host('x.dst_url')} = {host('url')}"
_MISSING = ("Missing", "Duplicate", "OverLength", "UnderLength", "Multiple", "HtmlEntity")
_SD = {"Article": "'Article', 'NewsArticle', 'BlogPosting'", "Product": "'Product'", "Faq": "'FAQPage'", "HowTo": "'HowTo'", "Recipe": "'Recipe'", "Video": "'VideoObject', 'Video'", "Breadcrumb": "'BreadcrumbList'", "Organization": "'Organization', 'LocalBusiness'"}
_RULES = {"ImageAlt": "image-alt", "Label": "label", "LinkName": "link-name", "ButtonName": "button-name", "ColorContrast": "color-contrast", "HtmlHasLang": "html-has-lang", "HeadingOrder": "heading-order"}
_ASSET = f"(is_resource OR regexp_matches(lower({path('url')}), '\\.(css|js|mjs|cjs|map|png|jpg|jpeg|gif|svg|webp|avif|ico|bmp|woff|woff2|ttf|otf|eot)$'))"

#: By view: the base condition, then each filter's condition and gate (C content, Q page URLs).
VIEWS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "Internal": ("is_internal AND (status IS NOT NULL OR redirect_url IS NOT NULL)", {"NonIndexable": ("indexability = 'Non-Indexable'", ""), **{k: (v, "") for k, v in _KINDS.items()}, "OtherResource": ("NOT (" + " OR ".join(_KINDS.values()) + ")", ""), "NotCached": ("is_resource AND is_internal AND network_fetches > 1", "")}),
    "External": ("NOT is_internal", {"Status4xx": ("status BETWEEN 400 AND 499", ""), "Status5xx": ("status >= 500", "")}),
    "ResponseCodes": ("status IS NOT NULL OR redirect_url IS NOT NULL", {**{f"Status{n}xx": (f"status >= {n}00" + (f" AND status < {n + 1}00" if n < 5 else ""), "") for n in (2, 3, 4, 5)}, "Redirects": ("redirect", ""), "RedirectChain": ("redirect_url IS NOT NULL AND to_redirect", ""), "RedirectLoop": ("in_loop", ""), "RedirectTemporary": ("redirect AND coalesce(redirect_status, CASE WHEN status BETWEEN 300 AND 399 THEN status END) IN (302, 303, 307)", ""), "RedirectToError": ("redirect AND end_status >= 400", "")}),
    "PageTitles": ("is_internal AND document", {**{k: v for k, v in _field("title", 30, 60).items()}, **_pixels("title", 200, 580), "SameAsH1": ("title = h1 AND title <> ''", "C"), "RepeatsSiteName": ("site_name IS NOT NULL AND length(regexp_replace(title_words, ' acme ?store(?: |$)', '~ ', 'g')) - length(replace(regexp_replace(title_words, ' acme ?store(?: |$)', '~ ', 'g'), '~', '')) > 1", "C")}),
    "MetaDesc": ("is_internal AND document", {**_field("meta_description", 70, 160), **_pixels("meta_description", 400, 970)}),
    "H1": ("is_internal AND document", {k: v for k, v in _field("h1", 1, 70).items() if k != "UnderLength"}),
    "H2": ("is_internal AND document", {**{k: v for k, v in _field("h2", 1, 70).items() if k not in ("UnderLength", "HtmlEntity")}, "NonSequential": ("h2_non_sequential", "C")}),
    "Content": ("is_internal AND (document OR coalesce(blocked_by_robots, false))", {"ExactDuplicates": ("n_content_hash > 1", "C"), "NearDuplicates": ("near_duplicate_count > 0", "C"), "LowContent": ("word_count > 0 AND word_count < 200", "C"), "SsrContentMissing": ("ssr_content_missing", "C"), "BlockedByRobots": ("blocked_by_robots", ""), "MissingBodyTag": ("NOT has_body_tag", "C")}),
    "Images": ("is_internal AND len(images) > 0", {"MissingAltText": (any_("images", "x.has_alt_attr AND coalesce(x.alt, '') = ''"), "C"), "MissingAltAttribute": (any_("images", "NOT x.has_alt_attr"), "C"), "AltOver100": (any_("images", "length(x.alt) > 100"), ""), "MissingSizeAttributes": (any_("images", "x.width IS NULL OR x.height IS NULL"), "C"), "ImageOver100Kb": ("large_image", ""), "ImageBroken": ("broken_image", "")}),
    "Canonicals": ("is_internal AND document", {"ContainsCanonical": ("canonical <> ''", ""), "SelfReferencing": ("trim(canonical) <> '' AND NOT canonicalised", ""), "Canonicalised": ("canonicalised", ""), "MissingCanonical": ("coalesce(canonical, '') = ''", "C"), "CanonicalTargetNotIndexable": ("canonicalised AND NOT t_indexable", ""), "CanonicalToRedirect": ("canonicalised AND t_redirect", ""), "CanonicalToError": ("canonicalised AND NOT t_redirect AND t_status >= 400", ""), "CanonicalToHttp": ("starts_with(url, 'https://') AND starts_with(resolved, 'http://')", ""), "CanonicalChain": ("canonicalised AND t_document AND t_canonicalised", "")}),
    "Hreflang": ("is_internal AND document", {"ContainsHreflang": ("len(hreflang_tags) > 0", ""), "MissingHreflang": ("len(hreflang_tags) = 0", "C"), **{n: (any_("hreflang_issues", f"x.kind = '{k}'"), "C") for n, k in (("HreflangMissingReturnTag", "MissingReturnTag"), ("HreflangInvalidLang", "InvalidLanguageCode"), ("HreflangMissingXDefault", "MissingXDefault"), ("HreflangMissingSelfReference", "MissingSelfReference"), ("HreflangNonCanonical", "NonCanonicalUrl"))}}),
    "StructuredData": ("is_internal AND document", {"HasStructuredData": ("len(sd_types) > 0", ""), "MissingStructuredData": ("len(sd_types) = 0", "C"), "SdErrors": ("sd_errors > 0", "C"), "SdWarnings": ("sd_warnings > 0", "C"), "JsonLdUrls": ("sd_jsonld_count > 0", ""), "MicrodataUrls": ("sd_microdata_count > 0", ""), "ParseErrors": ("sd_errors > 0", ""), **{f"SdType{k}": (f"list_has_any(sd_types, [{v}])", "") for k, v in _SD.items()}}),
    "Accessibility": ("is_internal AND document", {f"A11y{k}": (any_("a11y_issues", f"x.rule = '{v}'"), "") for k, v in _RULES.items()}),
    "Performance": ("is_internal AND document", {"SlowLcp": ("lcp_ms > 4000", "C"), "SlowCls": ("cls > 0.25", "C"), "SlowFcp": ("fcp_ms > 3000", ""), "SlowTtfb": ("ttfb_ms > 1800", ""), "SlowResponse": ("response_time > 1000", ""), "LargeHtml": ("size_bytes > 2000000", "")}),
    "Ecommerce": ("is_internal AND document", {"IsProductPage": ("ecommerce IS NOT NULL", ""), **{f"Missing{k}": (f"ecommerce IS NOT NULL AND ecommerce.{k.lower()} IS NULL", "") for k in ("Price", "Availability", "Sku", "Gtin", "Brand")}, "InvalidGtin": (f"ecommerce.gtin IS NOT NULL AND NOT (regexp_matches({_GTIN_DIGITS}, '^([0-9]{{8}}|[0-9]{{12}}|[0-9]{{13}}|[0-9]{{14}})$') AND {_GTIN_SUM} % 10 = 0)", ""), "OutOfStockIndexable": ("lower(trim(ecommerce.availability)) IN ('outofstock', 'soldout', 'discontinued') AND indexable", ""), "MissingBreadcrumbs": ("ecommerce IS NOT NULL AND NOT list_contains(sd_types, 'BreadcrumbList')", ""), "MissingReviewRating": ("ecommerce IS NOT NULL AND NOT ecommerce.has_review_or_rating", ""), "MissingProductImage": ("ecommerce IS NOT NULL AND NOT ecommerce.has_image", ""), "ProductLayoutWithoutMarkup": ("layout.assignment = 'layout_without_markup' AND layout.template_type = 'Product'", "")}),
    "Sitemaps": ("is_internal AND (document OR coalesce(in_sitemap, false))", {"UrlsInSitemap": ("in_sitemap", ""), "UrlsNotInSitemap": ("NOT in_sitemap", ""), "SitemapNon200": ("in_sitemap AND (redirect OR coalesce(status <> 200, false))", ""), "SitemapOrphans": ("in_sitemap AND status IS NULL", ""), "NonIndexableInSitemap": ("in_sitemap AND indexability = 'Non-Indexable'", ""), "CanonicalisedInSitemap": ("in_sitemap AND document AND canonicalised", "")}),
    "Security": ("is_internal AND (status IS NOT NULL OR redirect_url IS NOT NULL) AND len(headers) > 0", {"MissingHttps": ("NOT starts_with(url, 'https://')", ""), "MissingHsts": (f"NOT {_has('strict-transport-security')}", ""), "MissingCsp": (f"NOT {_has('content-security-policy')}", ""), "MissingFrameGuard": (f"NOT {_has('x-frame-options')}", ""), "MissingContentTypeOptions": (f"NOT {_has('x-content-type-options')}", ""), "MissingReferrerPolicy": (f"coalesce(trim({_first_header('referrer-policy')}) = '' OR contains(lower({_first_header('referrer-policy')}), 'unsafe-url') OR contains(lower({_first_header('referrer-policy')}), 'no-referrer-when-downgrade'), true)", ""), "MixedContent": ("has_mixed_content", "")}),
    "Url": ("is_internal AND (status IS NOT NULL OR redirect_url IS NOT NULL)", {"UrlNonAscii": ("length(url) <> octet_length(encode(url))", "Q"), "UrlUppercase": ("regexp_matches(url, '[A-Z]')", "Q"), "UrlUnderscores": ("contains(url, '_')", "Q"), "UrlMultipleSlashes": (f"contains({path('url')}, '//')", "Q"), "UrlParameters": ("contains(url, '?')", "Q"), "UrlOverLength": ("length(url) > 115", "Q"), "UrlSpaces": ("contains(url, ' ')", "Q"), "IndexableParameterUrl": ("contains(url, '?') AND document AND indexable", "")}),
    "Directives": ("is_internal AND document", {"DirectiveNoindex": ("noindex", ""), "DirectiveNofollow": ("list_contains(directives, 'nofollow') OR list_contains(directives, 'none')", ""), **{f"Directive{k.title()}": (f"list_contains(directives, '{k}')", "") for k in ("noarchive", "nosnippet", "none")}}),
    "Links": ("is_internal AND (len(outlinks) > 0 OR (document AND coalesce(status BETWEEN 200 AND 299, false)))", {"LinkBroken": ("broken_link", ""), "LinkRedirected": ("redirected_link", ""), "LinkNofollow": (any_("outlinks", "contains(lower(x.rel), 'nofollow')"), ""), "LinkNoAnchorText": (any_("outlinks", f"trim(coalesce(x.anchor, '')) = '' AND {_SAME}"), ""), "LinkExternal": (any_("outlinks", f"NOT ({_SAME})"), ""), "LinkToHttp": ("starts_with(url, 'https://') AND " + any_("outlinks", f"starts_with(x.dst_url, 'http://') AND {_SAME}"), ""), "SingleInlink": ("inlinks_complete AND document AND indexable AND unique_inlinks_count = 1", ""), "NoInternalOutlinks": (f"document AND indexable AND NOT {any_('outlinks', _SAME)}", "")}),
}
GATES = {"": "", "C": " AND eligible", "Q": f" AND NOT {_ASSET}"}


def condition(view: str, name: str) -> str:
    cond, gate = VIEWS[view][1][name]
    return f"(coalesce({cond}, false){GATES[gate]})"


def flags(view: str) -> str:
    marks = ", ".join(f"CAST({condition(view, n)} AS INTEGER) AS {n}" for n in VIEWS[view][1])
    return crawl() + f"SELECT row_id, {marks} FROM e WHERE {VIEWS[view][0]}"


def badges() -> str:
    def tone(v: str, which: str) -> str:
        some = [condition(v, n) for n, x in f.FILTERS[v].items() if x.tone == which]
        return "(" + (" OR ".join(some) or "false") + ")"

    parts = [f"SELECT '{v}' AS view_name, count(*) AS total, count(*) FILTER ({tone(v, f.ERROR)}) AS errors, count(*) FILTER ({tone(v, f.WARNING)} AND NOT {tone(v, f.ERROR)}) AS warnings FROM e WHERE {b}" for v, (b, _) in VIEWS.items()]
    return crawl() + " UNION ALL ".join(parts)


IMAGES = """pics AS (SELECT row_id, unnest(images) AS i, generate_subscripts(images, 1) AS pos FROM e WHERE is_internal AND len(images) > 0),
agg AS (SELECT i.src AS image_src, arg_min(i.alt, (row_id, pos)) FILTER (i.alt <> '') AS image_alt, count(*) AS image_inlinks, count(DISTINCT row_id) AS image_pages, arg_min(i.width, (row_id, pos)) FILTER (i.width IS NOT NULL) AS image_width,
  arg_min(i.height, (row_id, pos)) FILTER (i.height IS NOT NULL) AS image_height, bool_or(NOT i.has_alt_attr) AS no_alt, bool_or(i.has_alt_attr AND coalesce(i.alt, '') = '') AS no_text, bool_or(coalesce(length(i.alt) > 100, false)) AS long_alt,
  bool_or(i.width IS NULL OR i.height IS NULL) AS no_size, min(row_id) AS first_row FROM pics WHERE NOT starts_with(lower(ltrim(i.src)), 'data:') GROUP BY 1),
im AS (SELECT agg.*, nullif(res_status, -1) AS image_status, coalesce(res_size, 0) AS image_size FROM agg LEFT JOIN res ON res.src = image_src)
"""


def images() -> str:
    return crawl().rstrip() + ",\n" + IMAGES + "SELECT image_src, image_alt, image_inlinks, image_pages, image_status, image_size, image_width, image_height, NOT no_alt AS image_has_alt, first_row FROM im"


def directories() -> str:
    bare = f"regexp_replace({path('url')}, '/+$', '')"
    folder = f"CASE WHEN {bare} = '' THEN '/' WHEN contains(regexp_extract({bare}, '[^/]*$'), '.') THEN regexp_replace(regexp_replace({bare}, '[^/]*$', ''), '/+$', '') || '/' ELSE {bare} || '/' END"
    return crawl() + f"""SELECT dir_path, count(*) AS dir_page_count, CAST(sum(coalesce(word_count, 0)) // count(*) AS BIGINT) AS dir_avg_words, CAST(sum(size_bytes) AS BIGINT) AS dir_total_size, count(*) FILTER (indexability IS DISTINCT FROM 'Non-Indexable') AS dir_indexable,
  count(*) FILTER (indexability = 'Non-Indexable') AS dir_non_indexable, CAST(greatest(length(dir_path) - length(replace(dir_path, '/', '')) - 1, 0) AS INTEGER) AS dir_depth FROM (SELECT *, {folder} AS dir_path FROM e WHERE is_internal AND is_page AND NOT is_resource) GROUP BY dir_path"""


def overview(pages_only: bool = False) -> str:
    from crawlmill.plans import rules

    doc = "(eligible AND is_internal AND (status IS NOT NULL OR redirect_url IS NOT NULL))"
    fetched = "(is_internal AND (status IS NOT NULL OR redirect_url IS NOT NULL))"
    populations = {"documents": doc, "internal": fetched, "all": "true", "known_internal": "is_internal", "with_headers": f"({fetched} AND len(headers) > 0)", "sitemap": "coalesce(in_sitemap, false)"}
    twice = lambda v: f"{v} IN (SELECT {v} FROM e WHERE {doc} AND coalesce({v}, '') <> '' GROUP BY 1 HAVING count(*) > 1)"
    kind = lambda k: any_("hreflang_issues", f"x.kind = '{k}'")
    built = [
        "coalesce(title, '') = ''", twice("title"), "length(title) > 60", "coalesce(meta_description, '') = ''", twice("meta_description"), "coalesce(h1, '') = ''", twice("h1"), "indexability = 'Non-Indexable'", "status >= 400", "redirect", "sd_errors > 0",
        "near_duplicate_count > 0", "word_count > 0 AND word_count < 200", "ssr_content_missing", "blocked_by_robots", "lcp_ms > 4000", "cls > 0.25", any_("a11y_issues", "x.impact IN ('critical', 'serious')"), "NOT starts_with(url, 'https://')",
        f"NOT {_has('strict-transport-security')}", "has_mixed_content", kind("MissingReturnTag"), kind("InvalidLanguageCode"), kind("MissingXDefault"), kind("NonCanonicalUrl"), VIEWS["Links"][1]["LinkNoAnchorText"][0],
    ]
    pictures = {"ImageOver100Kb": f"image_size > {f.LARGE_IMAGE}", "ImageBroken": "image_status >= 400", "MissingAltText": "no_text", "MissingAltAttribute": "no_alt", "MissingSizeAttributes": "no_size"}
    parts = []
    if pages_only:
        conditions = {k: f"{populations[r.population]} AND ({built[k]})" if not r.view else f"({VIEWS[r.view][0]}) AND {condition(r.view, r.filter)}" for k, r in enumerate(rules.RULES) if r.view != "Images"}
        return crawl() + " UNION ALL ".join(f"SELECT row_id, {k + 1} AS rule_no FROM e WHERE {cond}" for k, cond in conditions.items())
    for k, r in enumerate(rules.RULES):
        if r.view == "Images":
            n, of = f"(SELECT count(*) FROM im WHERE {pictures[r.filter]})", "(SELECT count(*) FROM im)"
        else:
            cond = f"{populations[r.population]} AND ({built[k]})" if not r.view else f"({VIEWS[r.view][0]}) AND {condition(r.view, r.filter)}"
            n, of = f"(SELECT count(*) FROM e WHERE {cond})", f"(SELECT count(*) FROM e WHERE {populations[r.population]})"
        name = r.name.replace("'", "''")
        parts.append(f"SELECT {k + 1} AS rule_no, '{name}' AS issue_name, '{r.kind}' AS issue_type, '{r.priority}' AS priority, {n} AS count, greatest({of}, 1) AS population")
    body = crawl().rstrip().replace(", e AS (", ", e AS MATERIALIZED (").replace("\ne AS (", "\ne AS MATERIALIZED (") + ",\n" + IMAGES
    return body + "SELECT *, round(100.0::DOUBLE * count / population, 2) AS pct FROM (" + " UNION ALL ".join(parts) + ")"


def changes() -> str:
    older = """older AS (SELECT CASE WHEN row_id % 19 = 5 THEN url || '/gone' ELSE url END AS url, CASE WHEN row_id % 13 = 6 THEN 503 ELSE status END AS status, indexability, CASE WHEN row_id % 7 = 1 THEN 'Old title' ELSE title END AS title,
  CASE WHEN row_id % 11 = 2 THEN 'Old heading' ELSE h1 END AS h1, meta_description, CASE WHEN row_id % 5 = 3 THEN 7 ELSE word_count END AS word_count FROM d WHERE row_id % 17 <> 4),
now AS (SELECT * FROM d WHERE is_internal),"""
    shown = lambda v: f"coalesce(CAST({v} AS VARCHAR), '-')"
    part = lambda v, text: f"CASE WHEN b.{v} IS DISTINCT FROM a.{v} THEN {text} END"
    pair = lambda v, word: part(v, f"'{word}' || {shown('b.' + v)} || ' → ' || {shown('a.' + v)}")
    detail = f"array_to_string(list_filter([{pair('status', 'Status ')}, {pair('indexability', '')}, {part('title', repr('Title changed'))}, {part('h1', repr('H1 changed'))}, {part('meta_description', repr('Meta description changed'))}, {pair('word_count', 'Words ')}], lambda x: x IS NOT NULL), '; ')"
    return f"""WITH d AS ({select(Dialect(True))}), {older}
j AS (SELECT coalesce(a.url, b.url) AS change_url, CASE WHEN b.url IS NULL THEN 'Added' WHEN a.url IS NULL THEN 'Removed' ELSE 'Changed' END AS change_kind, b.status AS status_before, a.status AS status_after, CAST(NULL AS VARCHAR) AS layout_change,
  CASE WHEN a.url IS NULL OR b.url IS NULL THEN '' ELSE {detail} END AS change_detail FROM now a FULL OUTER JOIN older b ON a.url = b.url)
SELECT * FROM j WHERE change_kind <> 'Changed' OR change_detail <> ''"""


def _outlinks() -> str:
    return "links AS (SELECT row_id, url AS src, unnest(outlinks) AS x FROM d), ln AS (SELECT row_id, src, x.dst_url AS dst, x.csr_only AS csr, " + f"{host('x.dst_url')} = {host('src')} AS internal FROM links)"


def inlinks() -> str:
    return f"WITH d AS ({select(Dialect(True))}), {_outlinks()} SELECT dst AS url, count(*) AS inlinks, count(DISTINCT src) AS unique_inlinks, count(*) FILTER (csr) AS csr_inlinks, count(DISTINCT src) FILTER (csr) AS unique_csr_inlinks FROM ln GROUP BY dst"


def outlinks() -> str:
    parts = ", ".join(f"count(*) FILTER ({cond}) AS {n}, count(DISTINCT dst) FILTER ({cond}) AS unique_{n}" for n, cond in (("outlinks", "true"), ("external_outlinks", "NOT internal"), ("csr_outlinks", "csr"), ("external_csr_outlinks", "csr AND NOT internal")))
    return f"WITH d AS ({select(Dialect(True))}), {_outlinks()} SELECT src AS url, {parts} FROM ln GROUP BY src"


def depths() -> str:
    return f"""WITH RECURSIVE d AS ({select(Dialect(True))}), {_outlinks()},
edge AS (SELECT DISTINCT {norm("src")} AS src, {norm("dst")} AS dst FROM ln UNION SELECT {norm("url")}, {norm("redirect_url")} FROM d WHERE coalesce(redirect_url, '') <> ''),
walk AS (SELECT {norm("url")} AS node, 0 AS depth FROM d WHERE row_id = 1 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edge e ON e.src = w.node WHERE w.depth < 60)
SELECT d.url, min(w.depth) AS depth FROM d JOIN walk w ON w.node = {norm("d.url")} GROUP BY d.url, d.row_id"""


def page_rank(steps: int = 30) -> str:
    loops = "".join(
        f""",
r{k} AS MATERIALIZED (SELECT n.node, 0.15 / n.n + 0.85 * (coalesce(i.v, 0) + l.v / n.n) AS s FROM nodes n LEFT JOIN (SELECT dst AS node, sum(w * s / o) AS v FROM edge JOIN outs USING (src) JOIN r{k - 1} ON r{k - 1}.node = edge.src GROUP BY 1) i USING (node)
  CROSS JOIN (SELECT coalesce(sum(s), 0) AS v FROM r{k - 1} WHERE node NOT IN (SELECT src FROM outs)) l)"""
        for k in range(1, steps + 1)
    )
    return f"""WITH d AS MATERIALIZED ({select(Dialect(True))}), {_outlinks()},
edge AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM ln WHERE internal GROUP BY 1, 2), outs AS MATERIALIZED (SELECT src, sum(w) AS o FROM edge GROUP BY 1),
nodes AS MATERIALIZED (SELECT node, count(*) OVER () AS n FROM (SELECT src AS node FROM edge UNION SELECT dst FROM edge)),
r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS s FROM nodes){loops}
SELECT node, round(s / (SELECT max(s) FROM r{steps}) * 100, 4) AS score FROM r{steps}"""


def hreflang() -> str:
    return f"""WITH d AS ({select(Dialect(True))}),
k AS (SELECT row_id, url, {norm("url")} AS me, canonical, hreflang_tags, list_transform(hreflang_tags, lambda x: {norm("x.url")}) AS back FROM d),
p AS (SELECT me AS dest, arg_max(back, row_id) AS back, arg_max(coalesce(canonical, ''), row_id) AS canonical FROM k GROUP BY 1),
t AS (SELECT row_id, url, me, unnest(hreflang_tags) AS x FROM k), t2 AS (SELECT row_id, url, me, x.lang AS lang, x.url AS target_url, {norm("x.url")} AS dest FROM t),
m AS (SELECT t2.*, p.back, CASE WHEN starts_with(p.canonical, '/') THEN regexp_extract(target_url, '^([a-z]+://[^/?#]*)', 1) || p.canonical ELSE p.canonical END AS resolved FROM t2 JOIN p USING (dest))
SELECT row_id, url, 'MissingXDefault' AS kind, NULL AS lang, NULL AS target_url FROM t2 GROUP BY 1, 2 HAVING NOT bool_or(lang = 'x-default')
UNION ALL SELECT row_id, url, 'MissingSelfReference', NULL, NULL FROM t2 GROUP BY 1, 2 HAVING NOT bool_or(lang <> 'x-default' AND dest = me)
UNION ALL SELECT row_id, url, 'InvalidLanguageCode', lang, NULL FROM t2 WHERE lang = 'xx-yy'
UNION ALL SELECT row_id, url, 'MissingReturnTag', lang, target_url FROM m WHERE NOT list_contains(back, me)
UNION ALL SELECT row_id, url, 'NonCanonicalUrl', NULL, target_url FROM m WHERE trim(resolved) <> '' AND {norm("resolved")} <> dest"""


def near_duplicates() -> str:
    votes = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64))
    packed = " | ".join(f"CASE WHEN b{b} > 0 THEN 1::UBIGINT << {b} ELSE 0::UBIGINT END" for b in range(64))
    return f"""WITH w AS (SELECT doc_id, md5(coalesce(text, '')) AS hash, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
v AS (SELECT doc_id, {votes} FROM (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM s) GROUP BY doc_id),
f AS MATERIALIZED (SELECT w.doc_id, w.hash, coalesce({packed}, 0::UBIGINT) AS f FROM w LEFT JOIN v USING (doc_id)),
pair AS (SELECT a.doc_id, b.doc_id AS other, bit_count(xor(a.f, b.f)) AS distance, bit_count(xor(a.f, b.f)) = 0 AND a.hash = b.hash AS same FROM f a JOIN f b ON a.doc_id <> b.doc_id AND bit_count(xor(a.f, b.f)) <= 7)
SELECT doc_id, CAST(max((64 - CAST(distance AS INTEGER)) * 100 // 64) AS INTEGER) AS closest_similarity, count(*) FILTER (NOT same) AS near_duplicate_count, array_to_string(list_slice(list_sort(list(other) FILTER (NOT same)), 1, 50), ',') AS near_duplicates
FROM pair GROUP BY doc_id HAVING count(*) FILTER (NOT same) > 0"""


def url_functions() -> str:
    return f"""SELECT page_id, {norm("url")} AS normalized, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_replace({path("url")}, '[^/]*$', ''), '[^/]*/$', '') || 'x/y?z=1' AS resolved,
  CAST(greatest(length({path("url")}) - length(replace({path("url")}, '/', '')) - 1, 0) AS INTEGER) AS folder_depth, {host("url")} = 'tionsh.example.com' AS same_domain FROM pages"""


def row_filter() -> str:
    return crawl() + "SELECT row_id, url AS address, title FROM e WHERE is_internal AND (status IS NOT NULL OR redirect_url IS NOT NULL) AND coalesce(size_bytes, 0) >= 1500 AND contains(lower(trim(title)), 'acme') AND coalesce(status, 0) IN (200, 404) AND NOT ends_with(lower(url), '/') AND contains(lower(concat_ws(' ', url, title)), 'example')"


def gtins() -> str:
    digits = "lpad(CAST(p_partkey * 7919 % 10000000000000 AS VARCHAR), 13, '0')"
    total = f"list_sum(list_transform(range(1, 14), lambda i: CAST(substr({digits}, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))"
    return f"SELECT p_partkey, {total} % 10 = 0 AS valid FROM part"


def pixel_widths() -> str:
    def width(text: str, ascii_: str, em: int, size: int) -> str:
        return f"CAST(floor(list_sum(list_transform(string_split({text}, ''), lambda x: ([{', '.join(ascii_.split())}])[ord(x) - 31])) * {size}.0::DOUBLE / {em} + 0.5) AS INTEGER)"

    return f"SELECT p_partkey, {width('p_name', t.TITLE_ASCII, 1000, 22)} AS title_width, {width('p_name', t.TEXT_ASCII, 2048, 14)} AS text_width FROM part"


PREVIOUS = """SELECT o_orderkey AS id, last_value(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_id FROM orders"""
EVENTS = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
FACTS = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
  trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS h1,
  len(regexp_extract_all(html, '<a href="/')) AS outlinks, regexp_matches(html, '(?i)<body([\s>/]|$)') AS has_body_tag FROM pages"""


def badge_parts() -> str:
    """One-page filters of the growing crawl's counts."""
    parts = [f"SELECT '{v}' AS view_name, '{n}' AS filter_name, count(*) FILTER ({condition(v, n)}) AS n FROM e WHERE {VIEWS[v][0]}" for v in VIEWS for n in VIEWS[v][1] if not f.FILTERS[v][n].cross]
    return crawl() + " UNION ALL ".join(parts)


def _len(v: str) -> str:
    return f"CAST(length({v}) AS INTEGER)"


def _count(cond: str, unique: bool = False) -> str:
    some = f"list_filter(outlinks, lambda x: {cond})"
    return f"CAST(len(list_distinct(list_transform({some}, lambda x: x.dst_url))) AS INTEGER)" if unique else f"CAST(len({some}) AS INTEGER)"


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {part} > 0 AND {whole} > 0 THEN CAST(CAST(round({part}::DOUBLE / {whole} * 100) AS INTEGER) AS VARCHAR) || '%' END"


_REASONS = "list_filter([CASE WHEN redirect THEN 'Redirected' WHEN NOT status BETWEEN 200 AND 299 THEN 'Non-Indexable (' || status || ')' END, CASE WHEN noindex THEN 'Noindex' END, CASE WHEN NOT redirect AND canonicalised THEN 'Canonicalised' END], lambda x: x IS NOT NULL)"
_NULL_TEXT = "CAST(NULL AS VARCHAR)"
_OUT = f"NOT ({_SAME})"
#: The views' columns in DuckDB; those that the derived crawl doesn't fill are NULL.
COLUMNS = {
    "address": "url", "content": "content_type", "status_code": "status", "indexability": "indexability", "indexability_status": f"CASE WHEN status IS NULL THEN 'N/A' WHEN len({_REASONS}) = 0 THEN 'Indexable' ELSE array_to_string({_REASONS}, ', ') END",
    "status": "CASE WHEN blocked_by_robots THEN 'Blocked by robots.txt' WHEN status IS NULL THEN 'Not fetched' ELSE 'OK' END", "title": "title", "title_2": "title_2", "title_length": _len("title"), "title_pixel_width": "title_pixel_width",
    "meta_desc": "meta_description", "meta_desc_2": "meta_description_2", "meta_desc_length": _len("meta_description"), "meta_desc_pixel_width": "meta_description_pixel_width", "h1": "h1", "h1_2": "h1_2", "h1_length": _len("h1"), "h2": "h2", "h2_2": "h2_2", "h2_length": _len("h2"),
    "h2_sequence": "CASE WHEN h2_non_sequential THEN 'Non-Sequential' WHEN NOT h2_non_sequential THEN 'Sequential' END", "robots": "robots", "x_robots_tag": _first_header("x-robots-tag"), "canonical": "canonical", "size": "size_bytes", "transfer_size": "transfer_bytes", "response_time": "response_time",
    "network_fetches": "network_fetches", "revalidated_fetches": "revalidated_fetches", "cache_control": _NULL_TEXT, "words": "word_count", "depth": "depth", "folder_depth": f"CAST(greatest(length({path('url')}) - length(replace({path('url')}, '/', '')) - 1, 0) AS INTEGER)",
    "inlinks": "inlinks_count", "unique_inlinks": "unique_inlinks_count", "csr_inlinks": "csr_inlinks_count", "unique_csr_inlinks": "unique_csr_inlinks_count", "csr_inlinks_pct": _pct("csr_inlinks_count", "inlinks_count"),
    "outlinks_count": _count("true"), "unique_outlinks": _count("true", True), "external_outlinks": _count(_OUT), "unique_external_outlinks": _count(_OUT, True), "csr_outlinks": _count("x.csr_only"), "unique_csr_outlinks": _count("x.csr_only", True),
    "external_csr_outlinks": _count(f"x.csr_only AND {_OUT}"), "unique_external_csr_outlinks": _count(f"x.csr_only AND {_OUT}", True), "csr_outlinks_pct": _pct(_count("x.csr_only"), _count("true")), "last_modified": _NULL_TEXT, "redirect_url": "redirect_url",
    "redirect_type": "CASE WHEN redirect THEN coalesce(CAST(coalesce(redirect_status, CASE WHEN status BETWEEN 300 AND 399 THEN status END) AS VARCHAR), 'HTTP Redirect') END", "closest_similarity": "closest_similarity", "near_duplicate_count": "near_duplicate_count", "link_score": "link_score", "content_hash": "content_hash",
    "ssr_words": "ssr_word_count", "ssr_diff": "CASE WHEN word_count > 0 THEN CAST(CAST(round(greatest(word_count - ssr_word_count, 0)::DOUBLE / word_count * 100) AS INTEGER) AS VARCHAR) || '%' END", "body_tag": "CASE WHEN has_body_tag THEN 'Present' WHEN NOT has_body_tag THEN 'Missing' END",
    "hreflang_count": "CAST(len(hreflang_tags) AS INTEGER)", "hreflang_sources": _NULL_TEXT, "in_sitemap": "in_sitemap", "sitemap_lastmod": "sitemap_lastmod", "sitemap_url": "sitemap_url", "a11y_errors": "a11y_errors", "a11y_warnings": "a11y_warnings", "sd_errors": "sd_errors", "sd_warnings": "sd_warnings",
    "ttfb": "ttfb_ms", "fcp": "fcp_ms", "lcp": "lcp_ms", "cls": "cls", **{f"ecom_{k}": f"ecommerce.{k}" for k in ("price", "currency", "availability", "sku", "gtin", "brand", "has_image")}, "ecom_has_review": "ecommerce.has_review_or_rating",
    "sec_https": "starts_with(url, 'https://')", "sec_hsts": _has("strict-transport-security"), "sec_csp": _has("content-security-policy"), "sec_frame_guard": _has("x-frame-options"), "sec_content_type_opts": _has("x-content-type-options"), "sec_referrer_policy": _first_header("referrer-policy"),
    "sec_mixed_content": "has_mixed_content", "url_length": _len("url"),
}
_OCCURRENCES = {"PageTitles": "title", "MetaDesc": "meta_description", "H1": "h1", "H2": "h2", "Canonicals": "canonical"}


def view(name: str, columns: list[str]) -> str:
    """A page view's rows; accessibility has a row a violation and structured data (which has no items here) one a page."""
    made = [f"{COLUMNS[n]} AS {n}" for n in columns if n in COLUMNS]
    source = "e"
    if name in _OCCURRENCES:
        made.append(f"coalesce(n_{_OCCURRENCES[name]}, 0) AS occurrences")
    if name == "Hreflang":
        made += [f"hreflang_tags[{k}].{part} AS hreflang_{k}{suffix}" for k in (1, 2, 3) for part, suffix in (("lang", ""), ("url", "_url"))]
    if name == "StructuredData":
        made += [f"{_NULL_TEXT} AS sd_format", f"{_NULL_TEXT} AS sd_type"]
    if name == "Accessibility":
        source = "(SELECT *, unnest(CASE WHEN len(a11y_issues) > 0 THEN a11y_issues ELSE [NULL] END) AS issue FROM e)"
        made += [f"issue.{k} AS a11y_{k}" for k in ("rule", "impact", "target", "html")]
    return crawl() + f"SELECT row_id, {', '.join(made)} FROM {source} WHERE {VIEWS[name][0]}"


def rule_pages() -> str:
    return overview(pages_only=True)


def backlinks() -> str:
    return f"WITH d AS ({select(Dialect(True))}), x AS (SELECT url, unnest(outlinks) AS l FROM d) SELECT url AS source_url, l.anchor AS anchor, l.rel AS rel FROM x WHERE l.dst_url = (SELECT url FROM d WHERE row_id = 50)"


def outlink_details() -> str:
    return f"""WITH d AS ({select(Dialect(True))}), x AS (SELECT row_id, unnest(outlinks) AS l, generate_subscripts(outlinks, 1) AS pos FROM d),
s AS (SELECT url, arg_max(status, row_id) AS status FROM d WHERE status IS NOT NULL GROUP BY 1)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN status >= 400 THEN 'a' WHEN status >= 300 THEN 'b' ELSE 'c' END, pos) AS INTEGER) AS place, l.dst_url AS dst_url, l.anchor AS anchor, l.rel AS rel, status FROM x LEFT JOIN s ON s.url = l.dst_url"""


def image_references() -> str:
    return f"WITH d AS ({select(Dialect(True))}), x AS (SELECT url, unnest(images) AS i FROM d) SELECT url AS page_url, i.alt AS alt, i.has_alt_attr AS has_alt_attr FROM x WHERE i.src = 'https://img.example/logo.png'"


TIMES = """SELECT page_id, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN CAST(a // 60 AS VARCHAR) || 'm ago' WHEN a < 86400 THEN CAST(a // 3600 AS VARCHAR) || 'h ago' WHEN a < 604800 THEN CAST(a // 86400 AS VARCHAR) || 'd ago' ELSE strftime(make_timestamp((1700000000 - a) * 1000000), '%b %-d') END AS age,
  CASE WHEN page_id % 9 = 8 THEN NULL WHEN page_id % 4 = 2 AND starts_with(url, 'https://') THEN lower(string_split(url, '/')[3]) || ':8443' ELSE lower(string_split(url, '/')[3]) END AS host FROM (SELECT *, page_id * 7919 % 900000 AS a FROM pages)"""
PROBES = """SELECT 'https://img.example/' || CAST(page_id AS VARCHAR) || '.png' AS url, 'image' AS kind, CASE WHEN k = 4 THEN 404 ELSE 200 END AS status,
  CASE WHEN k = 5 THEN 'image/png' WHEN k IN (0, 1, 2, 6) THEN 'image/webp' ELSE 'image/gif' END AS content_type, CAST(CASE WHEN k IN (0, 1, 2, 6) THEN 8388608 WHEN k = 4 THEN 0 ELSE 10 + k END AS BIGINT) AS size_bytes, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, page_id % 12 AS k FROM pages)"""
FETCHES = "SELECT '/asset/' || CAST(user_id % 50 AS VARCHAR) AS url, count(*) AS network_fetches, count(*) FILTER (event_id % 5 = 0) AS revalidated_fetches FROM events WHERE event_id % 7 <> 0 AND event_id % 3 <> 0 GROUP BY 1"
GATED = """SELECT page_id, moved = 0 AND site AND kind <> 0 AND page_id % 5 <> 0 AND page_id % 13 NOT IN (3, 4) AS analysed, CASE WHEN moved = 1 THEN 'https://www.site.example/' || CAST(page_id AS VARCHAR) || '/moved' WHEN moved = 2 THEN 'https://www.site.example/' || CAST(page_id AS VARCHAR) || '#top' END AS redirect_url,
  CASE WHEN moved > 0 THEN CASE WHEN page_id % 5 = 0 THEN 302 ELSE 301 END END AS redirect_status, CASE WHEN moved > 0 THEN NULL WHEN kind = 0 THEN 'application/pdf' WHEN kind = 1 THEN 'TEXT/HTML; charset=x' WHEN kind = 2 THEN 'application/xhtml+xml' ELSE 'text/html' END AS content_type,
  moved = 0 AND site AND kind <> 0 AND page_id % 5 > 1 AND page_id % 13 IN (3, 4) AS empty_document, moved = 0 AND site AND kind <> 0 AND page_id % 5 <> 0 AND page_id % 13 NOT IN (3, 4) AS has_html
FROM (SELECT *, page_id % 6 AS kind, page_id % 11 <> 4 AS site, CASE WHEN page_id % 7 = 0 THEN 1 WHEN page_id % 7 = 2 AND page_id % 11 = 4 THEN 2 ELSE 0 END AS moved FROM pages)"""
MERGED = """SELECT page_id, array_to_string(list_filter(['l0', 'l1', 'l2', 'l3'], lambda x: list_contains(h, x) OR list_contains(p, x) OR list_contains(s, x)), ' ') AS langs0,
  array_to_string(list_concat(h, list_concat(list_filter(p, lambda x: NOT list_contains(h, x)), list_filter(s, lambda x: NOT list_contains(h, x) AND NOT list_contains(p, x)))), ' ') AS langs,
  array_to_string(list_filter([CASE WHEN len(h) > 0 THEN 'HTML' END, CASE WHEN len(list_filter(p, lambda x: NOT list_contains(h, x))) > 0 THEN 'HTTP' END, CASE WHEN len(list_filter(s, lambda x: NOT list_contains(h, x) AND NOT list_contains(p, x))) > 0 THEN 'Sitemap' END], lambda x: x IS NOT NULL), ' ') AS sources
FROM (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN (['l0', 'l1', 'l2'])[1:page_id % 3 + 1] ELSE [] END AS h, CASE WHEN page_id % 5 <> 0 THEN (['l1', 'l2', 'l3'])[1:(page_id + 1) % 3 + 1] ELSE [] END AS p, CASE WHEN page_id % 7 <> 0 THEN (['l0', 'l1', 'l2'])[1:(page_id + 2) % 3 + 1] ELSE [] END AS s FROM pages)"""
MERGED = f"SELECT * EXCLUDE (langs0) FROM ({MERGED})"
SITEMAPS = """SELECT trim(url) || '/' || CAST(page_id AS VARCHAR) AS loc, CASE WHEN page_id % 3 = 0 THEN '2024-01-0' || CAST(page_id % 9 + 1 AS VARCHAR) END AS lastmod, 's' || CAST(page_id % 5 AS VARCHAR) AS sitemap, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS pos FROM pages WHERE page_id % 5 < 4"""


def known_urls() -> str:
    return f"""WITH d AS (SELECT row_id, url FROM ({select(Dialect(True))})),
s AS (SELECT DISTINCT CASE WHEN row_id % 9 = 0 THEN url || '/lost' ELSE url END AS url FROM d WHERE row_id % 9 < 3),
b AS (SELECT DISTINCT CASE WHEN row_id % 18 = 0 THEN url || '/lost' WHEN row_id % 24 = 0 THEN url || '/shut' ELSE url END AS url FROM d WHERE row_id % 12 = 0)
SELECT row_id, url, CAST(NULL AS BOOLEAN) AS in_sitemap, CASE WHEN url IN (SELECT url FROM b) THEN true END AS blocked_by_robots FROM d
UNION ALL SELECT NULL, url, true, CASE WHEN url IN (SELECT url FROM b) THEN true END FROM s WHERE url NOT IN (SELECT url FROM d)
UNION ALL SELECT NULL, url, NULL, true FROM b WHERE url NOT IN (SELECT url FROM d) AND url NOT IN (SELECT url FROM s)"""


def depth_filters() -> str:
    return f"SELECT dir_path, dir_depth <= 1 AS DepthShallow, dir_depth IN (2, 3) AS DepthMedium, dir_depth > 3 AS DepthDeep FROM ({directories()})"


def overview_filters() -> str:
    parts = [f"sum(count) FILTER (issue_type = '{v}') AS IssueType{k}" for k, v in (("Error", "Issue"), ("Opportunity", "Opportunity"), ("Warning", "Warning"))] + [f"sum(count) FILTER (priority = '{k}') AS Priority{k}" for k in ("High", "Medium", "Low")]
    return f"SELECT {', '.join(f'CAST({x[: x.index(' AS ')]} AS BIGINT){x[x.index(' AS '):]}' for x in parts)} FROM ({overview()})"


def change_filters() -> str:
    by_layout = "(SELECT url FROM d WHERE row_id % 4 = 1)"
    body = changes().replace("SELECT * FROM j WHERE change_kind <> 'Changed' OR change_detail <> ''", f"SELECT count(*) FILTER (change_kind = 'Added') AS ChangeAdded, count(*) FILTER (change_kind = 'Removed') AS ChangeRemoved, count(*) FILTER (change_kind = 'Changed' AND (change_detail <> '' OR change_url IN {by_layout})) AS ChangeChanged, count(*) FILTER (change_kind = 'Changed' AND change_url IN {by_layout}) AS ChangeLayout FROM j")
    return body


def layouts() -> str:
    return f"""WITH d AS (SELECT url, row_id, layout FROM ({select(Dialect(True))}) WHERE layout IS NOT NULL), t AS (SELECT layout.template AS t, layout.assignment AS a, CASE WHEN row_id % 3 = 1 THEN CASE WHEN row_id % 2 = 0 THEN 'Added 1' ELSE 'Moved 2' END END AS s FROM d),
m AS (SELECT t, s, row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, s) AS r FROM t WHERE s IS NOT NULL GROUP BY t, s),
o AS (SELECT t AS layout_template, count(*) AS layout_pages, count(*) FILTER (a = 'layout_without_markup') AS layout_missing_markup, count(s) AS layout_changed FROM t GROUP BY t)
SELECT o.*, m.s AS layout_common_change, layout_missing_markup > 0 AS LayoutMissingMarkup, layout_changed > 0 AS LayoutChanged FROM o LEFT JOIN m ON m.t = layout_template AND m.r = 1"""


CATALOG = """SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS root_url, CAST(epoch(o_orderdate) AS BIGINT) AS started_at, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderkey % 2 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 100 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS finished_at, o_orderstatus <> 'F' AS aborted FROM orders WHERE o_orderkey <> 1"""


def running_inlinks() -> str:
    return f"WITH d AS ({select(Dialect(True))}), {_outlinks()} SELECT dst AS url, count(*) AS inlinks, count(*) FILTER (csr) AS csr_inlinks, count(DISTINCT src) AS unique_inlinks FROM ln GROUP BY dst"
