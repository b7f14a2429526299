"""Lookups, catalog, hops, drill-down, deep layouts and what a finished stream is reloaded as."""

import pytest

from crawlmill import schema
from crawlmill.operators import details, graph, layout
from crawlmill.plans import rules
from crawlmill.sources import store
from crawlmill.streaming import counts

SITE = "https://site.example"


def crawl(spark, *rows):
    base = [{"url": "/", "status": 200, "is_internal": True, "is_page": True, "is_resource": False, "content_type": "text/html", "row_id": k} | r for k, r in enumerate(rows)]
    made = [{**r, "url": SITE + r["url"]} for r in base]
    names = sorted({n for r in made for n in r})
    kinds = dict(x.split(" ", 1) for x in _columns(schema.PAGE))
    return schema.complete(spark.createDataFrame([tuple(r.get(n) for n in names) for r in made], ", ".join(f"{n} {kinds[n]}" for n in names)))


def _columns(text):
    out, depth, start = [], 0, 0
    for k, ch in enumerate(text + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(text[start:k].strip())
            start = k + 1
    return out


def test_redirect_rows_are_followed_hop_by_hop(spark):
    hops = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "b"), ("l", "m"), ("m", "l"), ("o", "https://other.example/")] + [(f"n{k}", f"n{k + 1}") for k in range(20)]
    full = lambda u: u if u.startswith("http") else f"{SITE}/{u}"
    responses = spark.createDataFrame([(full(a), 301, full(b)) for a, b in hops] + [(full("d"), 200, None)], "url string, status int, target string")
    starts = spark.createDataFrame([(full(u),) for u in ("a", "x", "l", "o", "n0", "d")], "url string")
    out = details.redirect_rows(starts, responses, SITE, starts).collect()
    got = {(r["hop"], r["url"].removeprefix(SITE + "/"), r["target"].removeprefix(SITE + "/")) for r in out}
    assert {(1, "a", "b"), (1, "x", "b"), (2, "b", "c"), (3, "c", "d"), (1, "l", "m"), (2, "m", "l"), (1, "o", "https://other.example/")} <= got
    assert len([g for g in got if g[1] == "b"]) == 1 and max(g[0] for g in got) == details.MOST_HOPS
    assert not any(g[0] == 3 and g[1] == "l" for g in got)


def test_start_url(spark):
    responses = spark.createDataFrame([("https://site.example/", 301, "https://www.site.example/"), ("https://www.site.example/", 302, "https://www.site.example/en")], "url string, status int, target string")
    assert details.start_url(responses, "https://site.example/") == "https://www.site.example/"
    assert details.start_url(responses, "https://site.example/", list_mode=True) == "https://site.example/"


def test_seeds_templates_and_times(spark):
    assert [tuple(r) for r in details.seeds(spark, [" a ", "b", "a", ""]).collect()] == [("a", 0), ("b", 0)]
    pages = crawl(spark, {"url": "/a"}, {"url": "/b"})
    told = details.with_templates(pages, spark.createDataFrame([(SITE + "/a", 1, "markup")], "url string, template_id int, assignment string"), spark.createDataFrame([(1, "T", "Product")], "template_id int, template string, template_type string"))
    assert {r["url"][-1]: r["layout"] and tuple(r["layout"]) for r in told.collect()} == {"a": ("T", "Product", "markup"), "b": None}
    times = spark.createDataFrame([(3,), (9,)], "crawled_at long")
    assert details.last_page_time(times).first()[0] == 9 and details.last_page_time(times.limit(0)).first()[0] is None


def test_items_in_order(spark):
    pages = crawl(spark, {"url": "/a", "sd_items": [("JSON-LD", "B", "{}"), ("Microdata", "A", "[]")]})
    assert [r["type_name"] for r in details.items(pages, SITE + "/a").collect()] == ["B", "A"]
    assert not details.items(pages, SITE + "/none").count()


def test_catalog(spark, tmp_path):
    crawls = spark.createDataFrame([], schema.CRAWLS)
    for k, root in enumerate(("r", "r", "s")):
        crawls = store.started(crawls, root, 100 + k)
    pages = crawl(spark, {"url": "/a"}, {"url": "/b", "status": None})
    crawls = store.closed(crawls, 1, store.row_counts(pages), 200)
    crawls = store.closed(crawls, 2, store.row_counts(pages.limit(1)), 300)
    rows = {r["id"]: r for r in crawls.collect()}
    assert (rows[1]["finished_at"], rows[1]["rows_count"], rows[1]["unfetched_count"], rows[2]["rows_count"]) == (200, 2, 1, 1) and rows[3]["rows_count"] is None
    done = {r["id"]: r for r in store.aborted(crawls, spark.createDataFrame([(3, 250)], "id long, last_crawled_at long")).collect()}
    assert (done[3]["aborted"], done[3]["finished_at"], done[1]["aborted"]) == (True, 250, False)
    assert sorted(r["id"] for r in store.without(crawls, 2).collect()) == [1, 3]
    assert {r["id"]: r["previous_id"] for r in store.previous(crawls).collect()} == {1: None, 2: 1, 3: None}
    assert [r["id"] for r in store.history(crawls).collect()] == [3, 2, 1]
    told = store.counts_of_crawls(spark.createDataFrame([(1, "Title.Missing", 4), (9, "x", 1)], "crawl_id long, filter string, n int"), crawls).collect()
    assert [(r["crawl_id"], r["root_url"]) for r in told] == [(1, "r")]
    store.save_pages(pages, str(tmp_path / "c1"))
    assert store.delete_crawl(spark, str(tmp_path / "c1")) and not store.delete_crawl(spark, str(tmp_path / "c1"))


def test_side_tables_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "url string, id int, kind string")
    assert {r["url"]: [x["kind"] for x in r["rows"]] for r in store.side_table(rows).collect()} == {"a": ["x", "y"], "b": ["z"]}
    counted = spark.createDataFrame([("V", "F", 3)], "view_name string, filter_name string, n int")
    store.store_counts(counted, str(tmp_path), 7)
    assert store.load_counts(spark, str(tmp_path), 7).select("n").collect()[0][0] == 3
    entries = spark.createDataFrame([("s", "u", None), ("s", "u", None)], "sitemap string, loc string, lastmod string")
    store.save_sitemap(entries, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/sitemap_urls").count() == 1


def test_every_view_is_exported(spark, tmp_path):
    pages = crawl(spark, {"url": "/a", "title": 'x "y", z'})
    names = store.export_views(pages, str(tmp_path))
    assert {"Overview", "PageTitles", "Images", "SiteStructure"} <= set(names) and "Changes" not in names
    text = "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "PageTitles").glob("*.csv"))
    assert text.startswith("﻿ROW_ID,") and '"x ""y"", z"' in text


def test_fetch_plans(spark):
    pages = crawl(spark, {"url": "/a", "images": [(SITE + "/i.png", None, None, None, False), ("data:x", None, None, None, False)], "subresources": [(SITE + "/s.css", "stylesheet"), (SITE + "/b", "script")], "canonical": "/c"}, {"url": "/b", "canonical": "https://o.example/"})
    assert [tuple(r) for r in store.planned_checks(pages).collect()] == [(SITE + "/i.png", "image"), (SITE + "/s.css", "stylesheet")]
    assert [r["url"] for r in store.planned_canonicals(pages).collect()] == [SITE + "/c"]


@pytest.mark.parametrize("rule", ["Missing Page Title", "Duplicate Page Title", "Page Title Below 30 Characters", "Images Missing Alt Attribute"])
def test_drill_down_has_as_many_rows_as_the_rule_counts(spark, rule):
    pages = crawl(spark, {"url": "/a", "title": "Same"}, {"url": "/b", "title": "Same"}, {"url": "/c", "images": [("/i.png", None, 1, 1, False)]}, {"url": "/d", "title": "Long enough to be no short title at all"})
    counted = {r["issue_name"]: r["count"] for r in rules.overview(pages).collect()}
    assert rules.pages_of(pages, rule).count() == counted[rule] > 0


def test_deep_layouts(spark):
    deep = 150
    boxes = spark.createDataFrame([("u", k, k - 1 if k else None, f"k{k % 3}", 0, 0, 1, 1, None, None, None) for k in range(deep)], schema.LAYOUT_BOXES)
    paths = {r["idx"]: r["path"] for r in layout.with_paths(boxes).collect()}
    assert all(paths[k] == " > ".join(f"k{j % 3}#1" for j in range(k + 1)) for k in range(deep))
    loop = spark.createDataFrame([("u", 0, 1, "a", 0, 0, 1, 1, None, None, None), ("u", 1, 0, "b", 0, 0, 1, 1, None, None, None)], schema.LAYOUT_BOXES)
    with pytest.raises(ValueError):
        layout.with_paths(loop)


def test_long_ways_have_depths(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(40)], "src string, dst string")
    assert {r["node"]: r["depth"] for r in graph.depths(edges, "n0").collect()} == {f"n{k}": k for k in range(41)}


def test_a_finished_stream_is_reloaded(spark, tmp_path):
    link = lambda u: (SITE + u, None, None, u == "/b")
    first, second = crawl(spark, {"url": "/a", "outlinks": [link("/b"), link("/b")]}), crawl(spark, {"url": "/b", "outlinks": [link("/a")], "row_id": 5})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for df in (first, second):
        df.coalesce(1).write.mode("append").parquet(src)
        counts.start_counts(counts.page_stream(spark, src, first.schema), out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["url"][-1]: (r["inlinks_count"], r["unique_inlinks_count"], r["csr_inlinks_count"], r["inlinks_complete"]) for r in counts.reloaded(spark, out).collect()}
    assert got == {"a": (1, 1, 0, True), "b": (2, 1, 2, True)}
    query = counts.running_inlinks(counts.page_stream(spark, src, first.schema)).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["url"][-1]: r["inlinks"] for r in spark.table("running").collect()} == {"a": 1, "b": 2}
