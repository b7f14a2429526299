"""Written pages with what is known of each, so that extraction has answers to be held against that no code of this library made.

A query gives page number k of a folder's pages the HTML of sample k modulo their number; its SQL twin joins the same numbers with the answers,
which are written out as rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL = "https://shop.example/a/page"


def _ld(*items) -> str:
    return "<html><head>" + "".join(f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>' for x in items) + "</head><body><p>x</p></body></html>"


def _crumbs(*levels, **more) -> dict:
    return {"@type": "BreadcrumbList", "itemListElement": list(levels)} | more


def _level(position, name="n", item="https://shop.example/x", **more) -> dict:
    return {"@type": "ListItem"} | {k: v for k, v in (("position", position), ("name", name), ("item", item)) if v is not None} | more


_PRODUCT = {"@type": "Product", "name": "Cup", "image": "https://shop.example/c.png", "description": "d", "brand": {"name": "Acme"}, "review": [], "aggregateRating": {"ratingValue": 4}}
_OFFER = {"@type": "Offer", "price": "9.50", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}
_ALL = ["missing-recommended:image", "missing-recommended:description", "missing-recommended:brand", "missing-recommended:review", "missing-recommended:aggregateRating", "missing-recommended:offers"]

#: (HTML, issues as "e|w Type code").
ISSUES: list[tuple[str, list[str]]] = [
    ("<html><body>no data</body></html>", []),
    (_ld(_crumbs(_level(1), _level(2, item=None))), []),
    (_ld(_crumbs(_level(2, item=None), _level(1))), []),  # written in any order: position 2 of 2 is the last
    (_ld(_crumbs(_level(1, item=None), _level(2))), ["e ListItem missing-required:item"]),
    (_ld(_crumbs(_level(None, item=None), _level(None, item=None))), ["e ListItem missing-required:position"] * 2 + ["e ListItem missing-required:item"]),
    (_ld(_crumbs(_level("1"), _level(" 2 ", item=None))), []),
    (_ld(_crumbs(_level("one"), _level(1.5, item=None), _level(True))), ["e ListItem invalid-value:position"] * 3 + ["e ListItem missing-required:item"]),
    (_ld(_crumbs(_level(1), _level(3))), ["w BreadcrumbList invalid-value:position-order"]),
    (_ld(_crumbs(_level(2), _level(None))), ["e ListItem missing-required:position"]),  # order is told only if all levels are numbered
    (_ld(_crumbs(_level(1, name=None), _level(2, name=" "), _level(3, name=7))), ["e ListItem missing-required:name"] * 2),
    (_ld(_crumbs(_level(1, name=None, item={"name": "n", "@id": "https://shop.example/x"}))), []),
    (_ld(_crumbs(_level(1, item={"name": "n"}), _level(2, item={}))), ["e ListItem missing-required:item.@id"] * 2),  # at the last level too
    (_ld(_crumbs(_level(1, item={"contentUrl": "/rel"}))), ["w ListItem relative-url:item.contentUrl"]),
    (_ld(_crumbs(_level(1, item={"@type": "WebPage", "url": "/rel"}))), ["w WebPage relative-url:url"]),  # looked at once, on its own
    (_ld(_crumbs(_level(1, item=5), _level(2, item=["https://shop.example/x"]))), ["e ListItem invalid-value:item"] * 2),
    (_ld(_crumbs("home", _level(2))), ["e ListItem invalid-value:itemListElement"]),
    (_ld({"@type": "BreadcrumbList", "itemListElement": []}), ["e BreadcrumbList empty-value:itemListElement"]),
    (_ld({"@type": "BreadcrumbList", "itemListElement": "x"}), ["e BreadcrumbList invalid-value:itemListElement"]),
    (_ld({"@type": "BreadcrumbList"}), ["e BreadcrumbList missing-required:itemListElement"]),
    (_ld(_crumbs(_level(1, **{"@type": "Thing"}))), ["w ListItem invalid-value:@type"]),
    (_ld(_crumbs(_level(1, item="www.shop.example/x"), _level(2, item="{{url}}"), _level(3, item="ftp://x/y"), _level(4, item="a b"), _level(5, item=""))), ["e ListItem invalid-url:item"] * 5),
    (_ld(_PRODUCT | {"offers": _OFFER}), []),
    (_ld({"@type": "Product", "name": "Cup"}), ["e Product missing-required:offers|review|aggregateRating"] + [f"w Product {x}" for x in _ALL]),
    (_ld({"@type": "Product", "name": "Cup", "offers": None, "review": None}), ["e Product missing-required:offers|review|aggregateRating"] + [f"w Product {x}" for x in _ALL[:3] + _ALL[4:5]]),
    (_ld(_PRODUCT | {"offers": {"@type": "Offer", "lowPrice": 3, "priceCurrency": "EUR", "availability": "InStock"}}), ["e Offer missing-required:price"]),
    (_ld(_PRODUCT | {"offers": {"@type": "AggregateOffer", "lowPrice": 3, "priceCurrency": "EUR"}}), ["w Offer missing-recommended:availability"]),
    (_ld(_PRODUCT | {"offers": {"@type": "AggregateOffer", "priceSpecification": {}, "availability": "x"}}), ["e Offer missing-required:price"]),
    (_ld(_PRODUCT | {"offers": [{"priceSpecification": {}}, {"price": 1}, 7]}), ["w Offer missing-recommended:availability"] * 2 + ["e Offer missing-required:priceCurrency"]),
    (_ld({"@type": ["Person", "http://schema.org/Nonsense"], "url": "https://x.example/"}), ["e Nonsense unknown-type"]),
    (_ld({"@type": "Person", "url": ["#", "null", "/ok", "https://a.example/"], "image": {"url": "pic.png"}, "sameAs": 4}), ["e Person invalid-url:url"] * 2 + ["w Person relative-url:url", "w Person relative-url:image.url", "e Person invalid-url:sameAs"]),
    (_ld({"@type": "Person", "@id": "_:b0", "logo": None}), []),
    (_ld({"@graph": [{"@type": "FAQPage"}, {"@type": "Person", "url": "https://"}]}), ["e FAQPage missing-required:mainEntity", "e Person invalid-url:url"]),
    ('<html><body><div itemscope itemtype="https://schema.org/Event"><span itemprop="name">N</span><time itemprop="startDate" datetime="2024-01-01">x</time><a itemprop="url" href="/e">e</a></div></body></html>', ["e Event missing-required:location"] + [f"w Event missing-recommended:{x}" for x in ("endDate", "description", "image", "offers")]),
    (_ld("{not json"), []),
]
#: The types that a page of ISSUES may name; a crawl's own list is a parameter of extract().
TYPES = ("Person", "WebPage", "Thing", "ListItem", "Offer", "AggregateOffer")

#: (HTML, price, currency, availability, sku, gtin, brand, has_image, has_review_or_rating); None for pages that sell nothing.
_SHOP = _ld
PRODUCTS: list[tuple[str, tuple | None]] = [
    (_ld({"@type": "Person", "name": "x"}), None),
    (_ld(_PRODUCT | {"sku": "S1", "gtin13": "4006381333931", "offers": _OFFER}), ("9.50", "EUR", "instock", "S1", "4006381333931", "Acme", True, True)),
    (_ld({"@type": "Product", "name": "Cup", "brand": "Plain", "offers": [{"price": 12}, {"price": 99, "priceCurrency": "USD", "sku": "O2"}]}), ("12", "USD", None, "O2", None, "Plain", False, False)),
    (_ld({"@type": "Product", "image": " ", "review": [], "aggregateRating": {}, "offers": {"@type": "AggregateOffer", "lowPrice": "3.10", "offers": [{"availability": "http://schema.org/OutOfStock"}]}}), ("3.10", None, "outofstock", None, None, None, False, False)),
    (_ld({"@type": "Product", "sku": 77, "isbn": "978", "manufacturer": {"name": "Maker"}, "image": ["a.png"]}), (None, None, None, "77", "978", "Maker", True, False)),
    ('<html><head><meta property="og:type" content="product"></head><body></body></html>', (None, None, None, None, None, None, False, False)),
    (_ld({"@type": "Product", "sku": "first", "gtin": "1", "image": "a"}, {"@type": "Product", "sku": "last"}), (None, None, None, "last", None, None, True, False)),
    ('<html><body><div itemscope itemtype="http://schema.org/Product"><span itemprop="name">N</span><img itemprop="image" src="p.png"><div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="5.00"><meta itemprop="priceCurrency" content="SEK"></div></div></body></html>', ("5.00", "SEK", None, None, None, None, True, False)),
]

#: (HTML, fact: value) as text; lists are joined by blanks.
FACTS: list[tuple[str, dict[str, str | None]]] = [
    ("<html><head><title> A  b </title><title>two</title></head><body><svg><title>pic</title></svg><h2>first</h2><h1>One</h1><h1>Two</h1><h2>more</h2></body></html>", {"title": "A b", "title_2": "two", "title_count": "2", "h1": "One", "h1_2": "Two", "h1_count": "2", "h2": "first", "h2_2": "more", "h2_count": "2", "h2_non_sequential": "true", "has_body_tag": "true"}),
    ('<html><head><meta name="description" content=" D "><meta name="description" content="E"><meta name="ROBOTS" content="noindex"><link rel="canonical" href=" /c "></head><body><h1>x</h1><h2>y</h2></body></html>', {"meta_description": "D", "meta_description_2": "E", "robots": "noindex", "canonical": "/c", "h2_non_sequential": "false"}),
    ('<html><head><link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="x-default" href="https://o.example/"><link rel="stylesheet" href="/s.css"><script src="https://cdn.example/a.js"></script></head><body></body></html>', {"hreflang_tags": "de=https://shop.example/de x-default=https://o.example/", "subresources": "https://shop.example/s.css=stylesheet https://cdn.example/a.js=script"}),
    ('<html><body><a href="/l#frag" rel="nofollow">Go  on</a><a href="mailto:x@y.z">m</a><a href="javascript:void(0)">j</a><a href="tel:1">t</a><a href="b"><img src="i.png" alt="Pic"></a><a href="#top">top</a><a>none</a><a href="https://e.example/" aria-label="Label">text</a></body></html>', {"outlinks": "https://shop.example/l:Go on:nofollow https://shop.example/a/b:Pic:- https://e.example/:Label:-"}),
    ('<html><body><img src="/1.png" alt="a" width="10" height="20"><img src="2.png"><img src="3.png" alt=""></body></html>', {"images": "https://shop.example/1.png:a:10:20:true https://shop.example/a/2.png:-:-:-:false https://shop.example/a/3.png::-:-:true"}),
    ('<html><head><script id="__sr_metrics">{"ttfb": 12, "lcp": 2500, "fcp": 900, "cls": 0.25}</script></head><body><p>Some words here</p><script>var hidden = 1;</script><style>p{}</style></body></html>', {"ttfb_ms": "12", "lcp_ms": "2500", "fcp_ms": "900", "cls": "0.25", "word_count": "3"}),
    ('<html><head><meta property="og:type" content="article"><meta http-equiv="Refresh" content="0;url=/n"></head><body><img src="http://o.example/i.png"></body></html>', {"og_type": "article", "meta_refresh": "true", "has_mixed_content": "true"}),
    ("<p>no body tag</p>", {"has_body_tag": "false", "word_count": "3", "title": None, "title_count": "0", "h1": None, "canonical": None, "robots": None, "og_type": None, "has_mixed_content": "false"}),
]
FACT_NAMES = sorted({n for _, x in FACTS for n in x})


def pages(spark: SparkSession, sf_dir: str, samples: list[str]) -> DataFrame:
    """page_id, url, html of a folder's pages, each with the HTML of the sample whose number is the rest of its id."""
    some = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return some.select("page_id", F.lit(URL).alias("url"), F.element_at(F.array(*map(F.lit, samples)), (F.pmod("page_id", F.lit(len(samples))) + 1).cast("int")).alias("html"))


def quoted(value) -> str:
    """A value in SQL."""
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def answers(rows: list[tuple], names: str, of: int) -> str:
    """SELECT of the answers (the first column is the sample's number) for each page of the pages table."""
    values = ", ".join("(" + ", ".join(str(x) if k == 0 else quoted(x) for k, x in enumerate(r)) + ")" for r in rows)
    return f"SELECT page_id, a.* EXCLUDE (sample) FROM pages JOIN (VALUES {values}) a(sample, {names}) ON page_id % {of} = a.sample"


# a site of blocks of ten pages each, every block under a folder of its own

ROOT = "https://site.example/"
_TEXT = " ".join(f"word{k}of{{b}}" for k in range(900))


def _doc(title: str, h1: str, links: str = "", head: str = "", text: str = "") -> str:
    return f"<html><head><title>{title}</title><meta name='description' content='About {title}'>{head}</head><body><h1>{h1}</h1>{links}<p>{text or ' '.join(w + h1.replace(' ', '') for w in ('own', 'words', 'of', 'it'))}</p></body></html>"


#: By place in a block: (status, content type, where it landed, Link header, HTML). {b} is the block's folder.
SITE: list[tuple[int | None, str | None, str | None, str | None, str | None]] = [
    (200, "text/html", None, None, _doc("Start {b}", "Hello {b}", "<a href='/{b}/1'>one{b}</a><a href='/{b}/2'>two{b}</a><a href='/{b}/2#x'>two{b} again{b}</a><a href='/{b}/4'> </a><a href='https://o.example/'>out{b}</a>")),
    (200, None, None, None, _doc("Copy of all", "First {b}", "<a href='/{b}/3'>three{b}</a>", text="{b} " + _TEXT)),
    (200, "text/html; charset=utf-8", None, None, _doc("Copy of all", "Second {b}", "<a href='/{b}/3'>three{b}</a><a href='/{b}/5' rel='nofollow'>five{b}</a>", text="{b} " + _TEXT + " more")),
    (200, "text/html", ROOT + "{b}/6", None, _doc("Target {b}", "Target {b}")),  # its answer is that of /6
    (404, "text/html", None, None, "<html><head><title>Lost {b}</title></head><body>nothing here</body></html>"),
    (302, "text/html", None, None, ""),
    (200, "text/html", None, '</{b}/7>; rel="alternate"; hreflang="de"', _doc("Target {b}", "Target {b}", head="<link rel='alternate' hreflang='en' href='/{b}/6'>")),
    (200, "text/html", None, None, _doc("German {b}", "Deutsch {b}", "<a href='/{b}/8'>next{b}</a>", head="<link rel='alternate' hreflang='de' href='/{b}/7'><link rel='alternate' hreflang='en' href='/{b}/6'><meta name='robots' content='noindex'>")),
    (200, "application/pdf", None, None, "<html><head><title>not read</title></head></html>"),
    (200, "text/html", None, None, ""),
]
#: By place in a block, as text: title, indexability, redirect_url, redirect_status, content_type, word_count, has_body_tag, depth, inlinks, unique inlinks, hreflang tags, their sources, kinds of issues, near duplicates, in sitemap.
SITE_ANSWERS: list[tuple] = [
    ("Start {b}", "Indexable", None, None, "text/html", 10, True, 1, 1, 1, "", "", "", None, True),
    ("Copy of all", "Indexable", None, None, "text/html", 902, True, 2, 1, 1, "", "", "", 1, False),
    ("Copy of all", "Indexable", None, None, "text/html; charset=utf-8", 904, True, 2, 2, 1, "", "", "", 1, False),
    (None, "Non-Indexable", ROOT + "{b}/6", 301, None, None, None, 3, 2, 2, "", "", "", None, False),
    ("Lost {b}", "Non-Indexable", None, None, "text/html", 2, True, 2, 1, 1, "", "", "", None, True),
    (None, "Non-Indexable", None, None, "text/html", None, None, 3, 1, 1, "", "", "", None, False),
    ("Target {b}", "Indexable", None, None, "text/html", 5, True, 4, 0, 0, "en de", "HTML HTTP", "MissingXDefault", None, False),
    ("German {b}", "Non-Indexable", None, None, "text/html", 6, True, None, 0, 0, "de en fr", "HTML Sitemap", "MissingXDefault", None, True),
    (None, "Indexable", None, None, "application/pdf", None, None, None, 1, 1, "", "", "", None, False),
    (None, "Indexable", None, None, "text/html", 0, False, None, 0, 0, "", "", "", None, False),
]
#: Rules with what they count: (for each block, for the start page).
SITE_ISSUES = {"Missing Page Title": (1, 0), "Duplicate Page Title": (2, 0), "Missing H1": (2, 0), "HTTP Errors (4xx/5xx)": (1, 0), "Redirects": (2, 0), "Non-Indexable Pages": (4, 0), "Missing <body> Tag": (1, 0), "Noindex": (1, 0), "Near Duplicate Content": (2, 0)}


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, url, final_url, status, content_type, headers, html: the start page, which links to every block, and ten rows a block."""
    numbers = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    block, place = F.floor(F.col("page_id") / 10).cast("string"), (F.pmod("page_id", F.lit(10)) + 1).cast("int")
    fill = lambda x: F.replace(x, F.lit("{b}"), block)
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in SITE)), place)
    header = F.when(pick(3).isNotNull(), F.array(F.struct(F.lit("Link").alias("k"), fill(pick(3)).alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    rows = numbers.select((F.col("page_id") + 1).cast("long").alias("row_id"), F.concat(F.lit(ROOT), block, F.lit("/"), F.pmod("page_id", F.lit(10)).cast("string")).alias("url"), fill(pick(2)).alias("final_url"), pick(0).cast("int").alias("status"), pick(1).alias("content_type"), header.alias("headers"), fill(pick(4)).alias("html"))
    links = numbers.where("page_id % 10 = 0").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<a href='/"), block, F.lit("/0'>b</a>")))), "").alias("l"))
    head, tail = "<html><head><title>The start page of the site</title><meta name='description' content='d'></head><body><h1>Start</h1>", "</body></html>"
    start = links.select(F.lit(0).cast("long").alias("row_id"), F.lit(ROOT).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.array().cast("array<struct<k:string,v:string>>").alias("headers"), F.concat(F.lit(head), "l", F.lit(tail)).alias("html"))
    return start.unionByName(rows)


def site_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's sitemap: each block's start, its lost page, and its German page with an alternate."""
    numbers = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 10 IN (0, 4, 7)")
    loc = F.concat(F.lit(ROOT), F.floor(F.col("page_id") / 10).cast("string"), F.lit("/"), F.pmod("page_id", F.lit(10)).cast("string"))
    alternates = F.when(F.col("page_id") % 10 == 7, F.array(F.struct(F.lit("fr").alias("lang"), F.lit("https://fr.example/").alias("url")))).otherwise(F.array().cast("array<struct<lang:string,url:string>>"))
    return numbers.select(loc.alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.lit(ROOT + "sitemap.xml").alias("sitemap"), F.col("page_id").cast("long").alias("pos"), alternates.alias("alternates"))


def site_answers() -> str:
    """SELECT of SITE_ANSWERS for each page of the pages table."""
    names = ["title", "indexability", "redirect_url", "redirect_status", "content_type", "word_count", "has_body_tag", "depth", "inlinks", "unique_inlinks", "langs", "sources", "issues", "near", "in_sitemap"]
    text = lambda x: "NULL" if x is None else f"replace({quoted(x)}, '{{b}}', CAST(page_id // 10 AS VARCHAR))" if isinstance(x, str) else f"'{str(x).lower()}'"
    pick = lambda k: "CASE page_id % 10 " + " ".join(f"WHEN {n} THEN {text(x[k])}" for n, x in enumerate(SITE_ANSWERS)) + " END"
    return "SELECT page_id + 1 AS row_id, " + ", ".join(f"CAST({pick(k)} AS VARCHAR) AS {n}" for k, n in enumerate(names)) + " FROM pages"


def site_issues() -> str:
    parts = [f"SELECT {quoted(name)} AS issue_name, {each} * (SELECT count(*) FROM pages) // 10 + {start} AS count" for name, (each, start) in SITE_ISSUES.items()]
    return " UNION ALL ".join(parts)
