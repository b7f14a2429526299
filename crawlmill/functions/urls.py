"""URL algebra as Columns, by regular expressions rather than a strict parser: crawled URLs hold spaces and other bytes that one rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#\\]*))?([^?#]*)(\?[^#]*)?(#.*)?\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated and written into the plan once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _WHOLE, n)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority_of(url: Column) -> Column:
    """Host and port, lower-cased, without user info and without the scheme's own port."""
    bare = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    return _without_port(scheme_of(url), bare)


def _without_port(scheme: Column, bare: Column) -> Column:
    return let(F.named_struct(F.lit("s"), scheme, F.lit("b"), bare), lambda x: F.when(x["s"] == "http", F.regexp_replace(x["b"], ":(80)?$", "")).when(x["s"] == "https", F.regexp_replace(x["b"], ":(443)?$", "")).otherwise(x["b"]))


def host_of(url: Column) -> Column:
    """The lower-cased host; '' if there is none."""
    return F.regexp_replace(F.lower(F.regexp_replace(_part(url, 2), "^.*@", "")), r":\d*$", "")


def path_of(url: Column) -> Column:
    """The path, as written; '/' for none."""
    return F.regexp_replace(_part(url, 3), "^$", "/")


def is_web(url: Column) -> Column:
    return url.rlike(r"^\s*(?i:https?)://(?:[^/?#\\]*@)?[^/?#\\:]")


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments resolved."""
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    joined = lambda x: F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(F.regexp_replace(x, "^/", ""), "/"), F.array().cast("array<string>"), step), "/"))
    closed = lambda x: let(joined(x), lambda j: F.when(x.rlike(r"/\.{1,2}$") & ~j.endswith("/"), F.concat(j, F.lit("/"))).otherwise(j))
    return let(path, lambda x: F.when(x.rlike(r"(^|/)\.{1,2}(/|$)"), closed(x)).otherwise(x))


def _parts(url: Column) -> Column:
    return F.named_struct(F.lit("s"), scheme_of(url), F.lit("a"), authority_of(url), F.lit("p"), path_of(url), F.lit("q"), _part(url, 4), F.lit("web"), is_web(url))


def normalize_url(url: Column) -> Column:
    """Without fragment and user info, scheme and host lower-cased, default port dropped, empty path '/'; NULL if it isn't a web address.

    Letter case of the path, the query and a trailing slash are significant. Spaces become %20."""
    made = lambda x: F.when(x["web"], F.replace(F.concat(x["s"], F.lit("://"), x["a"], without_dots(x["p"]), x["q"]), F.lit(" "), F.lit("%20")))
    return let(url, lambda u: let(_parts(u), made))


def resolve_url(base: Column, href: Column) -> Column:
    """href as seen from base: absolute, scheme-relative, root-relative, query, fragment or relative; NULL if base is no web address."""
    clean = lambda u: F.concat(F.regexp_extract(u, r"^([^/]*//[^/?#]*)", 1), without_dots(F.regexp_extract(u, r"^[^/]*//[^/?#]*([^?#]*)", 1)), F.regexp_extract(u, r"([?#].*)?$", 1))

    def made(x: Column) -> Column:
        h, b = x["h"], x["b"]
        whole = F.concat(b["s"], F.lit("://"), b["a"])
        return F.when(
            b["web"],
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(b["s"], F.lit(":"), h))
            .when(h == "", F.concat(whole, b["p"], b["q"]))
            .when(h.startswith("?"), F.concat(whole, b["p"], h))
            .when(h.startswith("#"), F.concat(whole, b["p"], b["q"], h))
            .otherwise(let(F.when(h.startswith("/"), F.concat(whole, h)).otherwise(F.concat(whole, F.regexp_replace(b["p"], "[^/]*$", ""), h)), clean)),
        )

    return let(F.named_struct(F.lit("b"), let(base, _parts), F.lit("h"), F.trim(href)), made)


def normalized_or_trimmed(url: Column) -> Column:
    """The join key of a URL: normalised, or trimmed if it can't be."""
    return F.coalesce(normalize_url(url), F.trim(url))


def urls_equivalent(a: Column, b: Column) -> Column:
    """Equal normalised; if either can't be, equal but for white space around them."""
    pair = F.named_struct(F.lit("a"), a, F.lit("b"), b, F.lit("m"), normalize_url(a), F.lit("n"), normalize_url(b))
    return let(pair, lambda x: F.coalesce(x["m"] == x["n"], F.trim(x["a"]) == F.trim(x["b"])))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def is_same_domain(url: Column, root: Column) -> Column:
    """Hosts are equal but for a leading www.; true if the root has none, false if only the url has none."""
    return let(F.named_struct(F.lit("u"), bare_host(url), F.lit("r"), bare_host(root)), lambda x: (x["r"] == "") | (x["u"] == x["r"]))


def is_another_spelling(url: Column, root: Column) -> Column:
    """Different hosts that are equal but for a leading www."""
    return (host_of(url) != host_of(root)) & (bare_host(url) == bare_host(root))


def origin_of(url: Column) -> Column:
    return F.when(is_web(url), F.concat(scheme_of(url), F.lit("://"), authority_of(url)))


def page_address(url: Column, root: Column) -> Column:
    """The URL without the root's origin; '/' if nothing is left."""
    rest = F.substring(url, F.length(origin_of(root)) + 1, 1 << 20)
    return F.when(url.startswith(origin_of(root)), F.when(rest == "", F.lit("/")).otherwise(rest)).otherwise(url)


def directory_path(path: Column) -> Column:
    """The directory of a URL path: a last segment with a dot is a file; ends with '/'."""
    bare = F.regexp_replace(path, "/+$", "")
    parent = F.regexp_replace(F.regexp_replace(bare, "[^/]*$", ""), "/+$", "")
    file = F.regexp_extract(bare, "[^/]*$", 0).contains(".")
    return F.when(bare == "", F.lit("/")).when(file, F.concat(parent, F.lit("/"))).otherwise(F.concat(bare, F.lit("/")))


def folder_depth(path: Column) -> Column:
    return F.greatest(F.length(path) - F.length(F.replace(path, F.lit("/"))) - 1, F.lit(0))


#: Endings of paths that are no pages.
ASSETS = "css js mjs cjs map png jpg jpeg gif svg webp avif ico bmp woff woff2 ttf otf eot".split()


def is_not_a_page_url(url: Column, is_resource: Column) -> Column:
    return F.coalesce(is_resource, F.lit(False)) | F.lower(path_of(url)).rlike(r"\.(" + "|".join(ASSETS) + ")$")


def decode_entities(text: Column) -> Column:
    """The five predefined entities."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


#: The content type that a file ending stands for.
TYPES = {
    "css": "text/css", "js": "text/javascript", "mjs": "text/javascript", "json": "application/json", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "avif": "image/avif", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2",
    "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject", "xml": "application/xml", "txt": "text/plain", "webm": "video/webm", "mp4": "video/mp4",
}


def content_type_by_ending(url: Column) -> Column:
    types = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.try_element_at(types, F.lower(F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1)))


def url_verdict(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a crawl may take a URL: no exclude pattern and, if there are any, some include pattern is found in it."""
    ok = F.lit(True)
    for p in exclude:
        ok = ok & ~url.rlike(p)
    if include:
        some = F.lit(False)
        for p in include:
            some = some | url.rlike(p)
        ok = ok & some
    return ok
