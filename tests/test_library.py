"""Must and must-not rows for filters, passes and sources, on small synthetic crawls."""

import gzip

import pytest
from pyspark.sql import functions as F

from crawlmill import schema
from crawlmill.functions import predicates, text, urls
from crawlmill.operators import changes, extract, filters, graph, hreflang, rowfilter, similarity
from crawlmill.plans import rules, views
from crawlmill.sources import sitemaps, store
from crawlmill.streaming import counts

SITE = "https://site.example"


def crawl(spark, *rows):
    """Page records from dicts of a few fields."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema.PAGE)
    base = {"status": 200, "content_type": "text/html", "size_bytes": 100, "is_internal": True, "is_page": True, "is_resource": False, "response_time": 10}
    made = []
    for k, r in enumerate(rows):
        full = base | {"row_id": k} | r
        full["url"] = full["url"] if "://" in full["url"] else SITE + full["url"]
        made.append(tuple(full.get(f.name) for f in fields))
    return spark.createDataFrame(made, fields)


def hit(pages, view, name):
    return {r["url"].removeprefix(SITE) for r in filters.where(pages, view, name).select("url").collect()}


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, plain",
    [("HTTPS://Site.Example:443/a#x", "https://site.example/a"), ("http://a.b", "http://a.b/"), ("http://a.b:80/?q", "http://a.b/?q"), ("http://a.b:81/x/../y", "http://a.b:81/y"), ("ftp://a.b/", None), ("x", None), ("https://a.b/A%20b c", "https://a.b/A%20b%20c"), (None, None)],
)
def test_normalize(spark, raw, plain):
    assert one(spark, urls.normalize_url(F.col("u")), u=raw) == plain


@pytest.mark.parametrize("href, target", [("/x", "https://a.b/x"), ("y", "https://a.b/d/y"), ("../z?q#f", "https://a.b/z?q#f"), ("//c.d/e", "https://c.d/e"), ("?p", "https://a.b/d/p?p"), ("#f", "https://a.b/d/p?k#f"), ("http://e.f/", "http://e.f/"), (" ", "https://a.b/d/p?k")])
def test_resolve(spark, href, target):
    assert one(spark, urls.resolve_url(F.col("b"), F.col("h")), b="https://a.b/d/p?k", h=href) == target


def test_domains_and_paths(spark):
    same = lambda a, b: one(spark, urls.is_same_domain(F.col("a"), F.col("b")), a=a, b=b)
    assert same("http://www.a.b/x", "https://a.b:8080/") and not same("http://m.a.b/", "http://a.b/") and same("http://a.b/", "junk") and not same("junk", "http://a.b/")
    for path, folder in {"/": "/", "/a/b": "/a/b/", "/a/b.html": "/a/", "/x.html": "/", "/a//": "/a/"}.items():
        assert one(spark, urls.directory_path(F.col("p")), p=path) == folder
    assert one(spark, urls.url_verdict(F.col("u"), ["/shop/"], ["\\?"]), u="http://a.b/shop/1") and not one(spark, urls.url_verdict(F.col("u"), [], ["\\?"]), u="http://a.b/?x")


def test_texts(spark):
    assert one(spark, text.title_pixel_width(F.col("t")), t="Rust (programming language)") == pytest.approx(293.58, rel=0.01)
    assert one(spark, text.title_pixel_width(F.col("t")), t="日​") == 22
    for t, yes in {"a &amp; b": True, "R&D": False, "AT&T;": False, "&#39;": True, "&#x2F;": True, "&#;": False}.items():
        assert one(spark, text.contains_html_entity(F.col("t")), t=t) == yes
    assert one(spark, text.title_suffix(F.col("t")), t="USB-C - De Batterij Pro") == "debatterijpro" and one(spark, text.title_suffix(F.col("t")), t="USB-C") is None
    twice = lambda t, s: one(spark, text.names_site_twice(F.col("t"), F.col("s")), t=t, s=s)
    assert twice("DeBatterijPro | De Batterij Pro", "debatterijpro") and not twice("Prostore | Pro", "pro") and not twice("Pro", "pro")
    for g, ok in {"4006381333931": True, "4006381333932": False, "73 1234-5": False, "96385074": True, "": False, "x": False}.items():
        assert one(spark, text.gtin_is_valid(F.col("g")), g=g) == ok
    regions = text.regions(spark)
    for code, ok in {"en": True, "en-GB": True, "EN-uk": True, "zh-Hant-TW": True, "x-default": True, "es-419": True, "dk": False, "en-XX": False, "fil": True, "": False}.items():
        assert one(spark, text.is_valid_language(F.col("c"), regions), c=code) == ok
    assert one(spark, text.parse_number(F.col("t")), t="500ms") == 500 and one(spark, text.parse_size(F.col("t")), t="1.5 KB") == 1536
    assert [one(spark, text.format_size(F.col("n")), n=n) for n in (0, 12, 1536, 3 << 20)] == ["", "12 B", "1.5 KB", "3.0 MB"]


def test_indexability(spark):
    pages = crawl(spark, {"url": "/ok"}, {"url": "/none", "robots": "none"}, {"url": "/h", "headers": [("X-Robots-Tag", "googlebot: noindex")]}, {"url": "/c", "canonical": "/other"}, {"url": "/self", "canonical": "self"}, {"url": "/r", "status": 301, "canonical": "/x"}, {"url": "/404", "status": 404, "robots": "noindex"}, {"url": "/u", "status": None})
    got = {r["url"].removeprefix(SITE): r["s"] for r in pages.select("url", predicates.indexability_status().alias("s")).collect()}
    assert got == {"/ok": "Indexable", "/none": "Noindex", "/h": "Noindex", "/c": "Canonicalised", "/self": "Indexable", "/r": "Redirected", "/404": "Non-Indexable (404), Noindex", "/u": "N/A"}


def test_field_filters(spark):
    pages = crawl(spark, {"url": "/a", "title": "Same"}, {"url": "/b", "title": "Same"}, {"url": "/c", "title": ""}, {"url": "/d", "title": "x" * 61, "title_2": ""}, {"url": "/e", "title": "Same", "robots": "noindex"}, {"url": "/f", "content_type": "application/pdf"}, {"url": "/g", "status": 404})
    assert hit(pages, "PageTitles", "Duplicate") == {"/a", "/b"} and hit(pages, "PageTitles", "Missing") == {"/c", "/g"}
    assert hit(pages, "PageTitles", "OverLength") == {"/d"} == hit(pages, "PageTitles", "Multiple") and hit(pages, "PageTitles", "UnderLength") == {"/a", "/b"}
    assert hit(pages, "Internal", "Pdf") == {"/f"}


def test_redirects(spark):
    to = lambda a, b, s=301: {"url": a, "redirect_url": SITE + b, "status": s}
    pages = crawl(spark, to("/a", "/b"), to("/b", "/c", 302), {"url": "/c", "status": 404}, to("/l1", "/l2"), to("/l2", "/l1"), to("/in", "/l1"), to("/ok", "/fine#x"), {"url": "/fine"}, {"url": "/bare", "status": 301}, to("/tobare", "/bare"), *(to(f"/n{k}", f"/n{k + 1}") for k in range(40)))
    assert hit(pages, "ResponseCodes", "RedirectLoop") == {"/l1", "/l2", "/in"}
    assert hit(pages, "ResponseCodes", "RedirectToError") == {"/a", "/b"}
    assert hit(pages, "ResponseCodes", "RedirectChain") == {"/a", "/l1", "/l2", "/in", "/tobare", *(f"/n{k}" for k in range(39))}
    assert hit(pages, "ResponseCodes", "RedirectTemporary") == {"/b"}


def test_redirects_of_urls_with_several_rows(spark):
    """A row leads where it says, though a later row of its URL leads nowhere; loops go by the last row that leads anywhere."""
    to = lambda a, b: {"url": a, "redirect_url": SITE + b, "status": 301}
    pages = crawl(spark, to("/a", "/b"), {"url": "/a"}, to("/b", "/c"), {"url": "/c"}, to("/l1", "/l2"), {"url": "/l1"}, to("/l2", "/l1"))
    got = {(r["row_id"]) for r in filters.where(pages, "ResponseCodes", "RedirectChain").collect()}
    assert got == {0, 4}  # /l2 leads to a page by the last row of /l1
    assert {r["row_id"] for r in filters.where(pages, "ResponseCodes", "RedirectLoop").collect()} == {4, 5, 6}


def test_long_redirects_are_no_loops(spark):
    to = lambda a, b: {"url": a, "redirect_url": SITE + b, "status": 301}
    pages = crawl(spark, *(to(f"/n{k}", f"/n{k + 1}") for k in range(150)), {"url": "/n150", "status": 404}, *(to(f"/l{k}", f"/l{(k + 1) % 3}") for k in range(3)), *(to(f"/in{k}", f"/in{k + 1}" if k < 99 else "/l0") for k in range(100)))
    assert hit(pages, "ResponseCodes", "RedirectLoop") == {*(f"/l{k}" for k in range(3)), *(f"/in{k}" for k in range(100))}
    assert hit(pages, "ResponseCodes", "RedirectToError") == {f"/n{k}" for k in range(150)}


def test_canonicals_and_links(spark):
    link = lambda u, a=None, r=None: (u, a, r, False)
    pages = crawl(
        spark, {"url": "/a", "canonical": "/gone", "outlinks": [link(SITE + "/gone", "x"), link("http://site.example/h", "")]}, {"url": "/gone", "status": 404}, {"url": "/b", "canonical": "/r", "outlinks": [link(SITE + "/r", "x", "NoFollow")]}, {"url": "/r", "status": 301},
        {"url": "/c", "canonical": "/a", "outlinks": [link("https://else.example/", "x")]}, {"url": "/d", "canonical": "http://site.example/d"}, {"url": "/e", "canonical": "/unknown", "inlinks_complete": True, "unique_inlinks_count": 1},
    )
    assert hit(pages, "Canonicals", "CanonicalToError") == {"/a"} and hit(pages, "Canonicals", "CanonicalToRedirect") == {"/b"} and hit(pages, "Canonicals", "CanonicalChain") == {"/c"}
    assert hit(pages, "Canonicals", "CanonicalTargetNotIndexable") == {"/a", "/b", "/c"} and hit(pages, "Canonicals", "CanonicalToHttp") == {"/d"}
    assert hit(pages, "Links", "LinkBroken") == {"/a"} and hit(pages, "Links", "LinkRedirected") == {"/b"} == hit(pages, "Links", "LinkNofollow")
    assert hit(pages, "Links", "LinkExternal") == {"/c"} and hit(pages, "Links", "LinkToHttp") == {"/a"} == hit(pages, "Links", "LinkNoAnchorText")


def test_overview_and_badges(spark):
    pages = crawl(spark, {"url": "/a"}, {"url": "/b", "status": 500, "title": "t", "h1": "t"}, {"url": "http://site.example/c?x=1", "title": "t", "headers": [("Server", "x")]})
    got = {r["issue_name"]: (r["count"], r["population"]) for r in rules.overview(pages).collect()}
    assert len(got) == 79 == len(rules.RULES)
    assert got["Missing Page Title"] == (1, 3) and got["Duplicate Page Title"] == (2, 3) and got["HTTP Errors (4xx/5xx)"] == (1, 3) and got["Missing HTTPS"] == (1, 1) and got["URLs with Parameters"] == (1, 3)
    b = {r["view_name"]: (r["total"], r["errors"], r["warnings"]) for r in rules.badges(pages).collect()}
    assert b["ResponseCodes"] == (3, 1, 0) and b["PageTitles"] == (3, 0, 3) and b["Ecommerce"] == (3, 0, 0)


def test_every_filter_is_listed():
    assert len({n for of in filters.FILTERS.values() for n in of} | {"All"}) == 147


def test_row_filter(spark):
    rows = spark.createDataFrame([(1, "Alpha one", 5), (2, "beta", None), (3, None, 12)], "row_id int, name string, n int")
    C = rowfilter.Condition
    ids = lambda *c, **k: {r["row_id"] for r in rowfilter.row_filter(rows, list(c), **k).collect()}
    assert ids(C("name", "contains", "ALPHA")) == {1} and ids(C("n", "equals", "5.0")) == {1} and ids(C("n", ">", "5")) == {3} and ids(C("name", "is_empty")) == {3}
    assert ids(C("n", "not_in", "5,12")) == {2} and ids(C("zzz", "equals", "1"), C("name", "equals", "")) == {1, 2, 3}
    assert ids(C("n", "<", "6"), C("name", "starts_with", "b"), match_all=False) == {1, 2} and ids(search="one alpha") == {1} and ids(search="12") == set()
    assert [r["row_id"] for r in rowfilter.sort_by(rows, "n").collect()] == [1, 3, 2] and [r["row_id"] for r in rowfilter.sort_by(rows, "n", descending=True).collect()] == [2, 3, 1]


def test_changes(spark):
    then = crawl(spark, {"url": "/same"}, {"url": "/old"}, {"url": "/t", "title": "a", "word_count": 5})
    now = crawl(spark, {"url": "/same"}, {"url": "/new"}, {"url": "/t", "title": "b", "word_count": None}, {"url": "https://else.example/", "is_internal": False})
    got = {(r["change_url"].removeprefix(SITE), r["change_kind"], r["change_detail"]) for r in changes.changes(now, then).collect()}
    assert got == {("/old", "Removed", ""), ("/new", "Added", ""), ("/t", "Changed", "Title changed; Words 5 → -")}


def test_changes_of_urls_with_several_rows(spark):
    """Each row of now is held against each of then, as the SQL's join does; a changed layout counts once however often its URL is named."""
    then = crawl(spark, {"url": "/t", "title": "a"}, {"url": "/t", "title": "b"}, {"url": "/gone"}, {"url": "/gone"})
    now = crawl(spark, {"url": "/t", "title": "b"}, {"url": "/t", "title": "c"}, {"url": "/same"})
    got = sorted((r["change_url"].removeprefix(SITE), r["change_kind"], r["change_detail"]) for r in changes.changes(now, then).collect())
    assert got == [("/gone", "Removed", "")] * 2 + [("/same", "Added", "")] + [("/t", "Changed", "Title changed")] * 3
    layouts = spark.createDataFrame([(SITE + "/t", "Moved 1"), (SITE + "/t", "Added 1")], "url string, summary string")
    assert sorted(r["change_detail"] for r in changes.changes(now, then, layouts).where("change_kind = 'Changed'").collect()) == ["Layout: Added 1"] + ["Title changed; Layout: Added 1"] * 3


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "d"), ("a", "e"), ("e", "a")], "src string, dst string")
    assert {r["node"]: r["depth"] for r in graph.depths(edges, "a").collect()} == {"a": 0, "b": 1, "e": 1, "c": 2}
    nodes = "abcde"
    out = {"a": "bbe", "b": "c", "c": "", "d": "d", "e": "a"}
    rank = dict.fromkeys(nodes, 0.2)
    for _ in range(30):
        new = dict.fromkeys(nodes, 0.03)
        for n in nodes:
            for m in out[n] or nodes:
                new[m] += 0.85 * rank[n] / len(out[n] or nodes)
        rank = new
    got = {r["node"]: r["score"] for r in graph.page_rank(edges).collect()}
    assert got == pytest.approx({n: v / max(rank.values()) * 100 for n, v in rank.items()})


def test_hreflang(spark):
    tags = lambda *x: [(lang, SITE + u) for lang, u in x]
    pages = crawl(spark, {"url": "/a", "hreflang_tags": tags(("en", "/a"), ("dk", "/b"), ("x-default", "/a"))}, {"url": "/b", "hreflang_tags": tags(("de", "/b")), "canonical": "/c"}, {"url": "/c", "hreflang_tags": tags(("fr", "/not-crawled"))})
    got = {(r["url"].removeprefix(SITE), r["kind"]) for r in hreflang.issues(pages).collect()}
    assert got == {("/a", "InvalidLanguageCode"), ("/a", "MissingReturnTag"), ("/a", "NonCanonicalUrl"), ("/b", "MissingXDefault"), ("/b", "NonCanonicalUrl"), ("/c", "MissingXDefault"), ("/c", "MissingSelfReference")}


def test_near_duplicates(spark):
    body = " ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([("a", body), ("b", body), ("c", body + " end"), ("d", "quite different words stand here"), ("e", None)], "url string, text string")
    got = {r["url"]: (r["near_duplicate_count"], r["near_duplicates"]) for r in similarity.near_duplicates(docs, "url", "text").collect()}
    assert got == {"a": (1, ["c"]), "b": (1, ["c"]), "c": (2, ["a", "b"])}


PAGE = """<!doctype html><html><head><title> One  title </title><meta name=description content=" About "><link rel=canonical href="/c">
<script type="application/ld+json">{"@type": "Product", "name": "P", "gtin13": 4006381333931, "offers": {"price": "3", "priceCurrency": "EUR", "availability": "https://schema.org/SoldOut"}}</script></head>
<body><nav>skip <a href="/n">menu</a></nav><h2>Second</h2><h1>First</h1><p>Some words<p>more 42<img src="data:image/png;base64,AAAA" data-src="/i.png" alt=""><a href="mailto:x">m</a><a href="b.html#f" rel=nofollow><img alt="picture"></a></body>"""


def test_extract(spark):
    pages = spark.createDataFrame([(1, SITE + "/d/p", PAGE), (2, SITE + "/e", None)], "page_id int, url string, html string")
    r = {x["page_id"]: x for x in extract.extract(pages).collect()}
    a = r[1]
    assert (a["title"], a["meta_description"], a["h1"], a["h2"], a["h2_non_sequential"], a["canonical"]) == ("One title", "About", "First", "Second", True, "/c")
    assert a["body_text"] == "Second. First. Some words. more 42 m." and a["word_count"] == 6
    assert [(x["dst_url"].removeprefix(SITE), x["anchor"], x["rel"]) for x in a["outlinks"]] == [("/n", "menu", None), ("/d/b.html", "picture", "nofollow")]
    assert a["images"][0]["src"] == SITE + "/i.png" and a["images"][0]["has_alt_attr"] and a["sd_types"] == ["Product"]
    assert (a["ecommerce"]["price"], a["ecommerce"]["availability"], a["ecommerce"]["gtin"]) == ("3", "soldout", "4006381333931")
    assert r[2]["title"] is None and r[2]["word_count"] == 0 and not r[2]["has_body_tag"]


def test_sitemaps(spark):
    index = b"<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>s2</loc></sitemap></sitemapindex>"
    leaf = gzip.compress(f"<urlset><url><loc>{SITE}/a</loc><lastmod>2024</lastmod></url><url><lastmod>x</lastmod></url></urlset>".encode())
    fetched = spark.createDataFrame([("s1", index), ("s2", leaf), ("s3", b"junk")], "url string, body binary")
    got = sitemaps.sitemap_urls(fetched, ["s1"])
    assert [(r["loc"], r["lastmod"], r["sitemap"]) for r in got.collect()] == [(SITE + "/a", "2024", "s2")]
    pages = crawl(spark, {"url": "/a#x"}, {"url": "/b"})
    assert {r["url"].removeprefix(SITE): r["in_sitemap"] for r in sitemaps.in_sitemap(pages, got).collect()} == {"/a#x": True, "/b": False}
    assert sitemaps.robots_sitemaps("User-agent: *\nSitemap: a\n sitemap : b\nSitemap: a") == ["a", "b"]
    assert [r["url"] for r in sitemaps.orphans(pages, got).collect()] == [SITE + "/a"]


def test_store(spark, tmp_path):
    pages = crawl(spark, {"url": "/a", "title": 'x, "y"'}, {"url": "/a", "title": "second"})
    store.save_pages(pages, str(tmp_path))
    assert [r["title"] for r in store.load_pages(spark, str(tmp_path)).collect()] == ['x, "y"']
    text_ = store.csv_text(pages.select("url", "title").limit(1))
    assert text_.startswith("﻿URL,TITLE\r\n") and text_.endswith('"x, ""y"""\r\n')
    new = spark.createDataFrame([(SITE + "/a", 7)], "url string, depth int")
    assert {r["depth"] for r in store.updated(pages, new).collect()} == {7}
    over = rules.overview(pages)
    assert "Missing H1" in store.report_html("R", over, spark.createDataFrame([("Missing H1", SITE + "/a")], "issue_name string, url string"))


def test_streaming_counts(spark, tmp_path):
    first, second = crawl(spark, {"url": "/a", "title": "T"}, {"url": "/b", "status": 404}), crawl(spark, {"url": "/a", "title": "T", "row_id": 9}, {"url": "/c", "title": "T", "row_id": 10})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, df in enumerate((first, second)):
        df.coalesce(1).write.mode("append").parquet(src)
        counts.start_counts(counts.page_stream(spark, src, first.schema), out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = {(r["view_name"], r["filter_name"]): r["n"] for r in counts.current_counts(spark, out).collect()}
    assert got["ResponseCodes", "Status4xx"] == 1 and got["ResponseCodes", "Status2xx"] == 2 and got["PageTitles", "Duplicate"] == 2


def test_views(spark):
    pages = crawl(spark, {"url": "/a", "images": [("i", "", 1, None, True), ("data:x", None, None, None, False)], "a11y_issues": [("label", "minor", "t", "h")], "sd_items": [("JSON-LD", "Product", "{}")], "sd_types": ["Product"]}, {"url": "/b", "images": [("i", "alt", None, 2, True)]}, {"url": "i", "is_resource": True})
    image = views.view(pages, "Images").collect()
    assert [(r["image_src"], r["image_inlinks"], r["image_alt"], r["image_width"], r["image_height"], r["image_has_alt"]) for r in image] == [("i", 2, "alt", 1, 2, True)]
    assert views.view(pages, "StructuredData", "MissingStructuredData").count() == 0 and views.view(pages, "Accessibility", "A11yLabel").count() == 1
    for name in views.VIEWS:
        views.view(pages, name).collect()
