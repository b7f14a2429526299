"""From HTML to page facts: one lenient parse a page, in Arrow batches; everything that follows from the facts stays in the JVM."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlmill import schema
from crawlmill.functions import text as t
from crawlmill.functions.html import BLOCKS, Node, parse, select
from crawlmill.operators import structured

#: What counts as boilerplate of a page.
SKIPPED = frozenset("script style noscript template nav aside dialog".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog".split())
CONSENT_IDS = frozenset("onetrust-consent-sdk CybotCookiebotDialog usercentrics-root didomi-host cookie-law-info-bar cmplz-cookiebanner-container cookiescript_injected termly-code-snippet-support".split())
LAZY_SOURCES = ("data-src", "data-lazy-src", "data-original", "data-lazy")
LAZY_SETS = ("data-srcset", "data-lazy-srcset")
NOT_LINKS = ("#", "javascript:", "mailto:", "tel:", "sms:", "data:")
MIXED = (("img", "src"), ("script", "src"), ("iframe", "src"), ("audio", "src"), ("video", "src"), ("source", "src"), ("embed", "src"), ("object", "data"), ("link", "href"), ("form", "action"))

FACTS = (
    "title string, title_2 string, title_count int, meta_description string, meta_description_2 string, h1 string, h1_2 string, h1_count int, h2 string, h2_2 string, h2_count int,"
    "h2_non_sequential boolean, canonical string, robots string, body_text string, word_count int, content_hash string, has_body_tag boolean, og_type string, has_mixed_content boolean,"
    f"hreflang_tags array<{schema.HREFLANG}>, images array<{schema.IMAGE}>, outlinks array<{schema.OUTLINK}>, subresources array<struct<url:string,kind:string>>,"
    f"ttfb_ms long, lcp_ms long, fcp_ms long, cls double, meta_refresh boolean, sd_types array<string>, sd_errors int, sd_warnings int, sd_jsonld_count int, sd_microdata_count int,"
    f"sd_items array<{schema.SD_ITEM}>, sd_issues array<{schema.SD_ISSUE}>, ecommerce {schema.ECOMMERCE}"
)


def resolve(base: str, href: str) -> str | None:
    try:
        made = urljoin(base, href.strip())
        parts = urlsplit(made)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return made or None
    return parts._replace(scheme=parts.scheme.lower(), netloc=parts.netloc.lower(), path=parts.path or "/").geturl()


def is_boilerplate(node: Node) -> bool:
    if node.tag in SKIPPED or node.attrs.get("role", "").lower() in SKIPPED_ROLES or node.attrs.get("aria-modal") == "true" or "data-nosnippet" in node.attrs:
        return True
    own = node.attrs.get("id", "")
    if own in CONSENT_IDS or own.startswith("sp_message_container_"):
        return True
    return node.tag in ("header", "footer") and not any(a.tag in ("article", "section", "main") for a in node.above())


def body_text(root: Node) -> str:
    """The text of the body without boilerplate; a block that ends without a full stop gets one."""
    body = next(root.all("body"), root)
    parts: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(body, False)]
    while stack:
        x, closing = stack.pop()
        if isinstance(x, str):
            if s := " ".join(x.split()):
                parts.append(s)
        elif closing:
            if x.tag in BLOCKS and parts and parts[-1][-1] not in ".!?":
                parts[-1] += "."
        elif x is body or not is_boilerplate(x):
            stack.append((x, True))
            stack.extend((k, False) for k in reversed(x.children))
    return " ".join(parts)


def words_in(text: str) -> int:
    return sum(any(ch.isalpha() for ch in w) for w in text.split())


def images_of(root: Node, base: str) -> list[dict]:
    out = []
    for img in root.all("img"):
        a = img.attrs
        src = a.get("src", "")
        lazy = next((a[k] for k in LAZY_SOURCES if a.get(k)), "")
        sources = [lazy if lazy and (not src or src.startswith("data:")) else src]
        sets = [a.get("srcset", ""), *(a.get(k, "") for k in LAZY_SETS)]
        if img.parent is not None and img.parent.tag == "picture":
            sets += [s.attrs.get("srcset", "") or s.attrs.get("data-srcset", "") for s in img.parent.all("source")]
        sources += [c.split()[0] for s in sets for c in re.split(r",\s+|,(?=\S+\s)", s) if c.split()]
        size = [int(m[0]) if (m := re.match(r"\d+", a.get(k, "").strip())) else None for k in ("width", "height")]
        for u in dict.fromkeys(u if u.startswith("data:") else resolve(base, u) for u in sources if u.strip()):
            if u:
                out.append({"src": inline(u) if u.startswith("data:") else u, "alt": a.get("alt"), "width": size[0], "height": size[1], "has_alt_attr": "alt" in a})
    return out


def inline(url: str) -> str:
    """A short name of a data URL: its kind, a hash and its size."""
    head, _, data = url.partition(",")
    size = len(data) // 4 * 3 - data.count("=", -2) if head.endswith(";base64") else len(data)
    return f"{head},#{hashlib.md5(url.encode('utf-8', 'replace')).hexdigest()[:8]} ({size} B)"


def links_of(root: Node, base: str) -> list[dict]:
    out = []
    for a in root.all("a"):
        href = a.attrs.get("href", "").strip()
        if not href or href.lower().startswith(NOT_LINKS):
            continue
        url = resolve(base, href)
        if url is None or not url.startswith(("http://", "https://")):
            continue
        anchor = " ".join(a.attrs.get("aria-label", "").split()) or a.text() or " ".join(" ".join(i.attrs.get("alt", "") for i in a.all("img")).split())
        out.append({"dst_url": url.split("#")[0], "anchor": anchor or None, "rel": a.attrs.get("rel") or None, "csr_only": False})
    return out


def facts(html: str, url: str, content_selector: str = "", known: frozenset[str] | None = None) -> dict:
    """All facts of one page."""
    root = parse(html)
    titles = [n.text() for n in root.all("title") if not any(a.tag == "svg" for a in n.above())]
    metas = list(root.all("meta"))
    described = [m.attrs.get("content", "").strip() for m in metas if m.attrs.get("name") == "description"]
    heads = {k: [n.text() for n in root.all(k)] for k in ("h1", "h2")}
    first = next(root.all("h1", "h2"), None)
    links = list(root.all("link"))
    canonical = next((x.attrs["href"].strip() for x in links if x.attrs.get("rel") == "canonical" and "href" in x.attrs), None)
    robots = next((m.attrs.get("content", "").strip() for m in metas if m.attrs.get("name", "").lower() == "robots"), None)
    body = ""
    if content_selector:
        body = " ".join(n.text() for n in select(root, content_selector)).strip()
    body = body or body_text(root)
    tags = []
    for x in links:
        if x.attrs.get("rel") == "alternate" and x.attrs.get("hreflang") and x.attrs.get("href") and (u := resolve(url, x.attrs["href"])):
            tags.append({"lang": x.attrs["hreflang"], "url": u})
    sheets = [(x.attrs["href"], "stylesheet") for x in links if "stylesheet" in x.attrs.get("rel", "").lower().split() and x.attrs.get("href")] + [(x.attrs["src"], "script") for x in root.all("script") if x.attrs.get("src")]
    subresources = [{"url": u, "kind": k} for u, k in dict.fromkeys((resolve(url, h), k) for h, k in sheets) if u]
    vitals = next((n for n in root.all("script") if n.attrs.get("id") == "__sr_metrics"), None)
    try:
        measured = json.loads("".join(vitals.texts())) if vitals else {}
    except ValueError:
        measured = {}
    number = lambda k, kind: kind(measured[k]) if isinstance(measured.get(k), (int, float)) else None
    at = lambda items, k: items[k] if len(items) > k else None
    og = next((m.attrs.get("content", "").strip() for m in metas if m.attrs.get("property") == "og:type"), None)
    return {
        "title": at(titles, 0), "title_2": at(titles, 1), "title_count": len(titles), "meta_description": at(described, 0), "meta_description_2": at(described, 1),
        "h1": at(heads["h1"], 0), "h1_2": at(heads["h1"], 1), "h1_count": len(heads["h1"]), "h2": at(heads["h2"], 0), "h2_2": at(heads["h2"], 1), "h2_count": len(heads["h2"]),
        "h2_non_sequential": bool(first is not None and first.tag == "h2" and heads["h1"]), "canonical": canonical, "robots": robots, "body_text": body, "word_count": words_in(body),
        "content_hash": hashlib.md5(body.encode("utf-8", "replace")).hexdigest(), "has_body_tag": bool(re.search(r"(?i)<body([\s>/]|$)", html)), "og_type": og,
        "has_mixed_content": url.startswith("https://") and any(n.attrs.get(k, "").strip().lower().startswith("http://") for tag, k in MIXED for n in root.all(tag) if tag != "link" or "stylesheet" in n.attrs.get("rel", "").lower()),
        "hreflang_tags": tags, "images": images_of(root, url), "outlinks": links_of(root, url), "subresources": subresources,
        "ttfb_ms": number("ttfb", int), "lcp_ms": number("lcp", int), "fcp_ms": number("fcp", int), "cls": number("cls", float),
        "meta_refresh": any(m.attrs.get("http-equiv", "").lower() == "refresh" for m in metas), **structured.facts(root, url, og, known),
    }


def extract(pages: DataFrame, content_selector: str = "", keep: tuple[str, ...] = ("page_id",), known: frozenset[str] | None = None) -> DataFrame:
    """keep, url and the facts of each page's html; a null html has the facts of an empty page. Pixel widths are added in the JVM.

    known: the names of all schema.org types, without which no type counts as unknown."""
    names = [x.split()[0] for x in re.split(r",(?![^<]*>)", FACTS)]

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [facts(h or "", u or "", content_selector, known) for h, u in zip(frame["html"], frame["url"])]
            out = {k: frame[k] for k in (*keep, "url")}
            yield pd.DataFrame(out | {n: pd.Series([r[n] for r in rows], index=frame.index, dtype="object") for n in names})

    kinds = dict(pages.dtypes)
    some = pages.select(*keep, "url", "html")
    out = some.mapInPandas(parsed, ", ".join(f"{k} {kinds[k]}" for k in keep) + f", url string, {FACTS}")
    return out.withColumns({"title_pixel_width": t.title_pixel_width(F.col("title")), "meta_description_pixel_width": t.description_pixel_width(F.col("meta_description"))})


def compared(raw: DataFrame, rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """rendered facts with ssr_word_count, ssr_h1, ssr_content_missing and csr_only links, from the facts of the HTML as served.

    Content is missing if a rendered page of 50 words or more had under half of them, or its H1 comes from scripts alone; a page that only
    refreshes elsewhere isn't judged."""
    r = raw.select(F.col(key).alias("_k"), F.col("word_count").alias("ssr_word_count"), F.col("h1").alias("ssr_h1"), F.transform("outlinks", lambda x: x["dst_url"]).alias("_known"), F.col("meta_refresh").alias("_refresh"))
    joined = rendered.join(r, F.col(key) == F.col("_k"), "left")
    few = (F.col("word_count") >= 50) & (F.col("ssr_word_count") * 2 < F.col("word_count"))
    no_h1 = (F.coalesce("h1", F.lit("")) != "") & (F.coalesce("ssr_h1", F.lit("")) == "")
    missing = F.when(F.col("_k").isNotNull() & ~F.coalesce("_refresh", F.lit(False)), few | no_h1)
    links = F.transform("outlinks", lambda x: x.withField("csr_only", F.coalesce(~F.array_contains("_known", x["dst_url"]), F.lit(False))))
    return joined.withColumns({"ssr_content_missing": missing, "outlinks": links}).drop("_k", "_known", "_refresh")


def hreflang_header(value: Column) -> Column:
    """hreflang tags of a Link header: its entries in angle brackets with rel=alternate and a language."""
    entries = F.regexp_extract_all(value, F.lit(r"(<[^>]*>[^,]*)"), F.lit(1))
    tag = lambda e: F.struct(F.regexp_extract(e, r"(?i);\s*hreflang\s*=\s*\"?([^\";\s]+)", 1).alias("lang"), F.regexp_extract(e, "<([^>]*)>", 1).alias("url"))
    alternate = lambda e: e.rlike(r"(?i);\s*rel\s*=\s*\"?[^\";]*\balternate\b")
    return F.filter(F.transform(F.filter(entries, alternate), tag), lambda x: (x["lang"] != "") & (x["url"] != ""))
