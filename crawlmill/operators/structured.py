"""Structured data of a page: JSON-LD and microdata items, the issues that rich results have with them, and what a shop page says of its product."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

from crawlmill.functions.html import Node

ERROR, WARNING = "error", "warning"
#: By type the required and the recommended properties.
RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Article": (("author", "datePublished", "headline", "image"), ("dateModified", "mainEntityOfPage", "publisher")),
    "Product": (("name",), ("image", "description", "brand", "review", "aggregateRating", "offers")),
    "Recipe": (("name",), ("image", "description", "recipeIngredient", "recipeInstructions", "totalTime", "recipeYield", "recipeCategory", "recipeCuisine", "nutrition")),
    "FAQPage": (("mainEntity",), ()),
    "Event": (("name", "startDate", "location"), ("endDate", "description", "image", "offers")),
    "LocalBusiness": (("name", "address"), ("telephone", "url", "image", "priceRange", "openingHours")),
    "BreadcrumbList": (("itemListElement",), ()),
    "Organization": (("name",), ("url", "logo", "contactPoint", "sameAs")),
    "VideoObject": (("name", "description", "thumbnailUrl", "uploadDate"), ("duration", "contentUrl", "embedUrl")),
    "JobPosting": (("title", "description", "datePosted", "hiringOrganization", "jobLocation"), ("employmentType", "salary", "validThrough")),
    "HowTo": (("name",), ("step", "image", "totalTime", "estimatedCost")),
    "Course": (("name", "description", "provider"), ("url",)),
    "Book": (("name",), ("author", "url", "isbn", "workExample")),
    "Review": (("reviewRating", "author"), ("itemReviewed", "reviewBody")),
    "SoftwareApplication": (("name",), ("operatingSystem", "applicationCategory", "offers")),
    "Dataset": (("name", "description"), ("url", "creator", "distribution", "temporalCoverage")),
}
#: Properties that hold URLs, and where an object keeps the URL it stands for.
URL_PROPERTIES = ("@id", "url", "image", "logo", "sameAs", "thumbnailUrl", "contentUrl", "embedUrl", "mainEntityOfPage", "acquireLicensePage")
NESTED_URLS = ("@id", "url", "contentUrl")
#: Where JSON-LD items hold further items.
INSIDE = ("@graph", "mainEntity", "hasPart", "itemListElement", "item")
GTIN_KEYS = ("gtin", "gtin13", "gtin12", "gtin8", "gtin14", "isbn")
PLACEHOLDERS = {"null", "undefined", "NaN", "#", "-"}


def issue(severity: str, type_name: str, code: str, message: str) -> dict:
    return {"severity": severity, "type_name": type_name, "code": code, "message": message}


def bare_type(name: str) -> str:
    for start in ("http://schema.org/", "https://schema.org/"):
        name = name.removeprefix(start)
    return name


def json_ld(value, base: str = "") -> Iterator[tuple[str, dict]]:
    """(type, object) of each item of a parsed script, an object once for each of its types, outer before inner."""
    if isinstance(value, list):
        for x in value:
            yield from json_ld(x)
    elif isinstance(value, dict):
        types = value.get("@type")
        for name in dict.fromkeys(x for x in (types if isinstance(types, list) else [types]) if isinstance(x, str) and x):
            yield bare_type(name), value
        for key in INSIDE:
            if key in value:
                yield from json_ld(value[key])


def _item_value(node: Node, base: str):
    if "itemscope" in node.attrs:
        return microdata_object(node, base)
    key = {"meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "embed": "src", "iframe": "src", "source": "src", "track": "src", "video": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime"}.get(node.tag)
    if key is None or (node.tag == "time" and key not in node.attrs):
        return node.attrs.get("content") or node.text()
    value = node.attrs.get(key, "")
    return urljoin(base, value) if key in ("href", "src", "data") and value else value


def microdata_object(scope: Node, base: str) -> dict:
    out: dict = {"@type": bare_type(scope.attrs.get("itemtype", "").split()[0])} if scope.attrs.get("itemtype", "").split() else {}
    stack = [x for x in reversed(scope.children) if isinstance(x, Node)]
    while stack:
        node = stack.pop()
        if "itemprop" in node.attrs:
            value = _item_value(node, base)
            for name in node.attrs["itemprop"].split():
                out[name] = value if name not in out else [*out[name], value] if isinstance(out[name], list) else [out[name], value]
        if "itemscope" not in node.attrs:
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def url_fault(value: str, base: str) -> str | None:
    """None for an absolute web address, 'relative', or what is wrong with it."""
    v = value.strip()
    if not v:
        return "the value is empty"
    if any(ch.isspace() or ord(ch) < 32 or ord(ch) == 127 for ch in v):
        return "the value contains whitespace"
    if set(v) & set("{}<>") or v in PLACEHOLDERS:
        return "the value is a placeholder, not a URL"
    try:
        parts = urlsplit(v)
    except ValueError:
        return "the value is not a URL"
    if parts.scheme:
        if parts.scheme not in ("http", "https"):
            return "the scheme is not http or https"
        return None if parts.netloc else "the URL has no host"
    return "the URL is missing its scheme" if v.startswith("www.") else "relative"


def url_issues(type_name: str, prop: str, value, base: str) -> Iterator[dict]:
    if isinstance(value, str):
        if (prop == "@id" or prop.endswith(".@id")) and value.strip().startswith("_:"):
            return
        fault = url_fault(value, base)
        if fault == "relative":
            yield issue(WARNING, type_name, f"relative-url:{prop}", f"'{value}' is relative")
        elif fault:
            yield issue(ERROR, type_name, f"invalid-url:{prop}", f"'{value}': {fault}")
    elif isinstance(value, list):
        for x in value:
            yield from url_issues(type_name, prop, x, base)
    elif isinstance(value, dict):
        key = next((k for k in NESTED_URLS if k in value), None)
        if key:
            yield from url_issues(type_name, prop if prop == key else f"{prop}.{key}", value[key], base)
    elif value is not None:
        yield issue(ERROR, type_name, f"invalid-url:{prop}", f"{value} is not a URL")


def _place(value) -> int | None:
    """A whole number from 0, also as text; a fraction, a sign or a truth value is none."""
    if isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value if value >= 0 else None
    if isinstance(value, str):
        digits = value.strip().removeprefix("+")
        return int(digits) if digits.isascii() and digits.isdigit() and len(digits) < 20 else None
    return None


def _said(value) -> bool:
    """Whether a name is there: text that isn't blank, or a number."""
    return bool(value.strip()) if isinstance(value, str) else isinstance(value, (int, float)) and not isinstance(value, bool)


def level_issues(level: int, entry, of: int, base: str) -> Iterator[dict]:
    """One level of a breadcrumb; level counts from 1, of is the number of levels."""
    name = "ListItem"
    if not isinstance(entry, dict):
        yield issue(ERROR, name, "invalid-value:itemListElement", f"level {level} is no object")
        return
    kind = entry.get("@type")
    if isinstance(kind, str) and bare_type(kind) != name:
        yield issue(WARNING, name, "invalid-value:@type", f"level {level} is a {kind}; only a ListItem is read")
    place = _place(entry.get("position"))
    if "position" not in entry:
        yield issue(ERROR, name, "missing-required:position", f"level {level} has no position")
    elif place is None:
        yield issue(ERROR, name, "invalid-value:position", f"the position of level {level} is no whole number: {json.dumps(entry['position'])}")
    target = entry.get("item")
    if not (_said(entry.get("name")) or isinstance(target, dict) and _said(target.get("name"))):
        yield issue(ERROR, name, "missing-required:name", f"level {level} has no name")
    if "item" not in entry:
        # the page itself needs no address: the level whose position is last, or which is written last if it has no position
        if (place if place is not None else level) != of:
            yield issue(ERROR, name, "missing-required:item", f"level {level} has no item; only the last level needs none")
    elif isinstance(target, (str, dict)):
        if isinstance(target, dict) and not any(k in target for k in NESTED_URLS):
            yield issue(ERROR, name, "missing-required:item.@id", f"the item of level {level} has neither @id nor url")
        if not (isinstance(target, dict) and "@type" in target):  # an item with a type is looked at on its own
            yield from url_issues(name, "item", target, base)
    else:
        yield issue(ERROR, name, "invalid-value:item", f"the item of level {level} is neither an address nor an object: {json.dumps(target)}")


def breadcrumb_issues(item: dict, base: str) -> Iterator[dict]:
    """Each level needs a position, a name and, but for the last, a page; positions run 1, 2, 3 in any order."""
    name = "BreadcrumbList"
    if "itemListElement" not in item:
        return
    levels = item["itemListElement"]
    levels = [levels] if isinstance(levels, dict) else levels
    if not isinstance(levels, list):
        yield issue(ERROR, name, "invalid-value:itemListElement", "itemListElement is no list of ListItem objects")
        return
    if not levels:
        yield issue(ERROR, name, "empty-value:itemListElement", "itemListElement has no levels")
        return
    for k, entry in enumerate(levels, 1):
        yield from level_issues(k, entry, len(levels), base)
    places = sorted(p for x in levels if isinstance(x, dict) and (p := _place(x.get("position"))) is not None)
    if len(places) == len(levels) and places != list(range(1, len(levels) + 1)):
        yield issue(WARNING, name, "invalid-value:position-order", "positions are not 1, 2, 3, ...")


def offer_issues(item: dict) -> Iterator[dict]:
    if all(item.get(k) is None for k in ("offers", "review", "aggregateRating")):
        yield issue(ERROR, "Product", "missing-required:offers|review|aggregateRating", "a product needs one of offers, review and aggregateRating")
    offers = item.get("offers")
    for o in offers if isinstance(offers, list) else [offers]:
        if not isinstance(o, dict):
            continue
        kind = o.get("@type")
        range_ = isinstance(kind, str) and bare_type(kind) == "AggregateOffer"
        if not any(k in o for k in ("price", "lowPrice" if range_ else "priceSpecification")):
            yield issue(ERROR, "Offer", "missing-required:price", "an offer needs a price")
        if not any(k in o for k in ("priceCurrency", "priceSpecification")):
            yield issue(ERROR, "Offer", "missing-required:priceCurrency", "an offer needs a priceCurrency")
        if "availability" not in o:
            yield issue(WARNING, "Offer", "missing-recommended:availability", "an offer should state its availability")


def item_issues(type_name: str, item: dict, base: str, known: frozenset[str] | None = None) -> list[dict]:
    """known: the names of all types (vocabulary()); without them no type is unknown."""
    out = [issue(ERROR, type_name, "unknown-type", f"'{type_name}' is no known type")] if known is not None and type_name not in known and type_name not in RULES else []
    for prop in URL_PROPERTIES:
        if prop in item:
            out += url_issues(type_name, prop, item[prop], base)
    required, recommended = RULES.get(type_name, ((), ()))
    out += [issue(ERROR, type_name, f"missing-required:{x}", f"{type_name} needs {x}") for x in required if x not in item]
    out += [issue(WARNING, type_name, f"missing-recommended:{x}", f"{type_name} should have {x}") for x in recommended if x not in item]
    if type_name == "Product":
        out += offer_issues(item)
    if type_name == "BreadcrumbList":
        out += breadcrumb_issues(item, base)
    return out


def vocabulary(lines) -> frozenset[str]:
    """The names of types from the lines of a list, with or without their address; blank lines and those that begin with # are left out."""
    return frozenset(bare_type(x.strip()) for x in lines if x.strip() and not x.lstrip().startswith("#"))


def _scalar(value) -> str | None:
    if isinstance(value, str):
        return value.strip() or None
    return None if isinstance(value, bool) or not isinstance(value, (int, float)) else json.dumps(value)


def _filled(value) -> bool:
    return bool(value.strip()) if isinstance(value, str) else value is not None and value != [] and value != {}


def product(items: list[tuple[str, dict]], types: list[str], og_type: str | None) -> dict | None:
    """What a product page says of its product; None for other pages. Of several products the last one's fields count."""
    if "Product" not in types and og_type not in ("product", "product.item"):
        return None
    out = dict.fromkeys(("price", "currency", "availability", "sku", "gtin", "brand")) | {"has_image": False, "has_review_or_rating": False}

    def offers(value) -> None:
        for o in [value] if isinstance(value, dict) else value if isinstance(value, list) else []:
            if not isinstance(o, dict):
                continue
            if "offers" in o:
                offers(o["offers"])
            stated = o.get("availability")
            new = {
                "price": _scalar(o.get("price", o.get("lowPrice"))), "currency": o.get("priceCurrency") if isinstance(o.get("priceCurrency"), str) else None,
                "availability": stated.rsplit("/", 1)[-1].lower() if isinstance(stated, str) else None, "sku": o.get("sku") if isinstance(o.get("sku"), str) else None,
            }
            out.update({k: v for k, v in new.items() if out[k] is None})

    for name, item in items:
        if name != "Product":
            continue
        out["has_image"] |= _filled(item.get("image"))
        out["has_review_or_rating"] |= _filled(item.get("review")) or _filled(item.get("aggregateRating"))
        maker = item.get("brand", item.get("manufacturer"))
        if maker is not None:
            named = maker.get("name") if isinstance(maker, dict) else maker
            out["brand"] = named if isinstance(named, str) else None
        out["sku"] = _scalar(item.get("sku")) or out["sku"]
        out["gtin"] = next((v for k in GTIN_KEYS if (v := _scalar(item.get(k)))), None)
        offers(item.get("offers"))
    return out


def facts(root: Node, base: str, og_type: str | None, known: frozenset[str] | None = None) -> dict:
    """The structured-data columns of a page. A script that can't be parsed is an error."""
    items: list[tuple[str, str, dict]] = []
    errors = scripts = 0
    for script in root.all("script"):
        if script.attrs.get("type", "").strip().lower() == "application/ld+json":
            scripts += 1
            try:
                items += [("JSON-LD", name, x) for name, x in json_ld(json.loads("".join(script.texts())))]
            except (ValueError, RecursionError):
                errors += 1
    scopes = [n for n in root.walk() if "itemscope" in n.attrs and n.attrs.get("itemtype")]
    for scope in scopes:
        made = microdata_object(scope, base)
        items += [("Microdata", made["@type"], made)] if made.get("@type") else []
    issues = [i for _, name, x in items for i in item_issues(name, x, base, known)]
    types = list(dict.fromkeys(name for _, name, _ in items))
    return {
        "sd_types": types, "sd_errors": errors + sum(i["severity"] == ERROR for i in issues), "sd_warnings": sum(i["severity"] == WARNING for i in issues),
        "sd_jsonld_count": scripts, "sd_microdata_count": len(scopes), "sd_items": [{"format": f, "type_name": n, "raw_json": json.dumps(x)} for f, n, x in items],
        "sd_issues": issues, "ecommerce": product([(n, x) for _, n, x in items], types, og_type),
    }
