"""The predicates of a page record, as Columns over its fields. NULL counts as not so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlmill.functions import urls

c = F.col


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def empty(array: str) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) <= 0


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def is_redirect() -> Column:
    return yes(c("redirect_url").isNotNull() | c("status").between(300, 399))


def is_html() -> Column:
    kind = F.lower(F.trim(F.substring_index(c("content_type"), ";", 1)))
    return F.coalesce(kind.isin("", "text/html", "application/xhtml+xml"), F.lit(True))


def is_page_document() -> Column:
    return yes(c("is_page")) & ~yes(c("is_resource")) & ~is_redirect() & is_html()


def directives(value: Column) -> Column:
    """The tokens of a robots value; a crawler's name before a colon is dropped."""
    bare = F.regexp_replace(value, r"^\s*[A-Za-z0-9_*\-]+\s*:", "")
    return F.filter(F.transform(F.split(bare, ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def all_directives() -> Column:
    sent = F.transform(F.filter(F.coalesce("headers", F.array().cast("array<struct<k:string,v:string>>")), lambda h: F.lower(h["k"]) == "x-robots-tag"), lambda h: h["v"])
    return F.flatten(F.transform(F.concat(F.when(c("robots").isNotNull(), F.array("robots")).otherwise(F.array().cast("array<string>")), sent), directives))


def has_directive(name: str) -> Column:
    """`none` stands for noindex and nofollow."""
    found = F.array_contains(all_directives(), name)
    return yes(found | F.array_contains(all_directives(), "none") if name in ("noindex", "nofollow") else found)


def is_noindex() -> Column:
    return has_directive("noindex")


def resolved_canonical() -> Column:
    return F.coalesce(urls.resolve_url(c("url"), c("canonical")), c("canonical"))


def is_canonicalised() -> Column:
    return yes((F.trim("canonical") != "") & ~urls.urls_equivalent(resolved_canonical(), c("url")))


def is_indexable() -> Column:
    return yes(c("status").between(200, 299)) & ~is_redirect() & ~is_noindex() & ~is_canonicalised()


def is_content_eligible() -> Column:
    """A page whose content an index would use; its status is ignored on purpose."""
    return is_page_document() & ~is_noindex() & ~is_canonicalised()


def was_fetched() -> Column:
    return c("status").isNotNull() | c("redirect_url").isNotNull()


def indexability_status() -> Column:
    """`N/A` without a status; `Indexable`, or all reasons against it. A redirect's canonical belongs to its target."""
    reasons = F.array_compact(
        F.array(
            F.when(is_redirect(), F.lit("Redirected")).when(~c("status").between(200, 299), F.concat(F.lit("Non-Indexable ("), c("status").cast("string"), F.lit(")"))),
            F.when(is_noindex(), F.lit("Noindex")),
            F.when(~is_redirect() & is_canonicalised(), F.lit("Canonicalised")),
        )
    )
    return F.when(c("status").isNull(), F.lit("N/A")).when(F.size(reasons) == 0, F.lit("Indexable")).otherwise(F.array_join(reasons, ", "))


def indexability() -> Column:
    s = indexability_status()
    return F.when(s.isin("N/A", "Indexable"), s).otherwise(F.lit("Non-Indexable"))


def header(name: str) -> Column:
    """The first header of that name, NULL if it wasn't sent."""
    return F.get(F.transform(F.filter("headers", lambda h: F.lower(h["k"]) == name), lambda h: h["v"]), F.lit(0))


def has_header(name: str) -> Column:
    return yes(F.exists("headers", lambda h: F.lower(h["k"]) == name))


def leaks_url(policy: Column) -> Column:
    p = F.lower(F.trim(policy))
    return (p == "") | p.contains("unsafe-url") | p.contains("no-referrer-when-downgrade")


def out_of_stock(availability: Column) -> Column:
    return yes(F.lower(F.trim(availability)).isin("outofstock", "soldout", "discontinued"))


def redirect_code() -> Column:
    return F.coalesce("redirect_status", F.when(c("status").between(300, 399), c("status")))


def lacks_anchor(anchor: Column) -> Column:
    return F.coalesce(F.trim(anchor), F.lit("")) == ""


#: The good and the poor limit of each web vital.
VITALS = {"lcp_ms": (2500, 4000), "cls": (0.1, 0.25), "fcp_ms": (1800, 3000), "ttfb_ms": (800, 1800)}


def vital_tone(name: str) -> Column:
    good, poor = VITALS[name]
    return F.when(c(name).isNull(), F.lit(None)).when(c(name) <= good, "good").when(c(name) <= poor, "fair").otherwise("poor")
