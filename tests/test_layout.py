"""Layout differences and templates on small captures."""

from crawlmill import schema
from crawlmill.operators import layout


def boxes(spark, pages):
    rows = []
    for url, items in pages.items():
        for i, (parent, key, x, y, w, h, *more) in enumerate(items):
            rows.append((url, i, parent, key, x, y, w, h, *(more + [None] * 3)[:3]))
    return spark.createDataFrame(rows, schema.LAYOUT_BOXES)


def test_differences(spark):
    base = [(None, "body", 0, 0, 100, 500), (0, "div", 0, 0, 100, 50, "red"), (0, "div", 0, 50, 100, 50), (2, "p", 0, 60, 90, 20, None, "old"), (0, "ul", 0, 200, 100, 90)]
    then = boxes(spark, {"a": base, "gone": base})
    now = boxes(spark, {"a": [(None, "body", 0, 0, 100, 502), (0, "div", 0, 0, 100, 50, "blue"), (0, "div", 0, 50, 100, 50), (2, "p", 30, 60, 90, 20, None, "new"), (0, "nav", 0, 150, 100, 30), (4, "a", 0, 150, 10, 10)]})
    got = {(r["path"], r["kind"]) for r in layout.differences(then, now).collect()}
    assert got == {("body#1 > div#1", "Restyled"), ("body#1 > div#2 > p#1", "Moved"), ("body#1 > nav#1", "Added"), ("body#1 > ul#1", "Removed")}


def test_templates(spark):
    def page(*kinds):
        return [(None, "body", 0, 0, 100, 100), (0, "header", 0, 0, 100, 10), *((0, k, 0, 10, 100, 50) for k in kinds)]

    pages = {f"p{k}": page("gallery", "price") for k in range(4)} | {f"a{k}": page("article", "author") for k in range(4)} | {"hidden": page("gallery", "price"), "odd": page("map")}
    types = spark.createDataFrame([(u, "Product" if u[0] == "p" else "Article") for u in pages if u[1:].isdigit()], "url string, template_type string")
    got = {r["url"]: (r["template_type"], r["assignment"]) for r in layout.templates(boxes(spark, pages), types).collect()}
    assert got["hidden"] == ("Product", "layout_without_markup") and got["odd"] == ("Layout 1", "shape") and got["p0"] == ("Product", "markup")


def test_template_rows_of_urls_with_several_rows(spark):
    """Pages are told by row where URLs repeat, and none is counted twice."""
    pages = spark.createDataFrame([(1, "/a", "T"), (2, "/a", "U"), (3, "/b", "U")], "row_id long, url string, template_type string").selectExpr("*", "'markup' AS assignment")
    changed = spark.createDataFrame([(1, "/a", "Moved 1"), (3, "/b", "Moved 1"), (3, "/b", "Added 1")], "row_id long, url string, summary string")
    shown = lambda rows: {tuple(r[c] for c in ("layout_template", "layout_pages", "layout_changed", "layout_common_change")) for r in rows.collect()}
    assert shown(layout.template_rows(pages.drop("url"), changed.drop("url"), by="row_id")) == {("T", 1, 1, "Moved 1"), ("U", 2, 1, "Added 1")}
    assert shown(layout.template_rows(pages.drop("row_id"), changed.drop("row_id"))) == {("T", 1, 1, "Moved 1"), ("U", 2, 2, "Added 1")}


def plain_templates(parts, types):
    """The same by loops over pages; parts: url to part to weight, without chrome."""
    def learn(urls, without=None):
        urls = [u for u in urls if u != without]
        counts = {}
        for u in urls:
            for part, w in parts[u].items():
                counts.setdefault(part, []).append(w)
        core = {x: sum(w) / len(w) for x, w in counts.items() if len(w) >= layout.CORE * len(urls)}
        some = {x for x, w in counts.items() if x not in core and len(w) >= layout.OPTIONAL * len(urls) and len(w) >= 2}
        return core, some

    def passes(u, template):
        core, some = template
        total, page = sum(core.values()), sum(parts[u].values())
        coverage = sum(w for x, w in core.items() if x in parts[u]) / total if total else 0.0
        share = sum(w for x, w in parts[u].items() if x in core or x in some) / page if page else 1.0
        return coverage if coverage >= layout.COVERED and share >= layout.EXPLAINED else None

    groups = {}
    for u, t in types.items():
        groups.setdefault(t, []).append(u)
    fits = {u: len(groups[t]) < 3 or passes(u, learn(groups[t], u)) is not None for u, t in types.items()}
    known = {t: learn([u for u in us if fits[u]]) for t, us in groups.items()}
    out = {}
    for u in parts:
        if fits.get(u):
            out[u] = (types[u], "markup")
            continue
        some = [(v, t) for t, x in known.items() if t != types.get(u) and (v := passes(u, x)) is not None]
        out[u] = (max(some)[1], "layout_over_type" if u in types else "layout_without_markup") if some else None
    return out


def test_templates_leave_a_page_out(spark):
    import random

    r, pages, types, parts = random.Random(5), {}, {}, {}
    for k in range(40):
        kind = "Product" if k % 2 else "Article"
        some = [x for x in (["gallery", "price", "buy", "stock"] if k % 2 else ["article", "author", "share", "date"]) if r.random() < 0.93] + [x for x in ("extra", "more", "note") if r.random() < 0.3]
        if k in (7, 8):
            some = ["gallery", "price", "buy", "stock"] if k == 8 else ["map"]
        pages[f"u{k}"] = [(None, "body", 0, 0, 100, 100)] + [(0, x, 0, 10, 100, 10 * (1 + len(x))) for x in some]
        parts[f"u{k}"] = {f"body > {x}": (100 * 10 * (1 + len(x))) ** 0.5 for x in some}
        if k % 5 or k in (7, 8):
            types[f"u{k}"] = kind
    types |= {"u0": "Recipe"}
    expected = plain_templates(parts, types)
    out = {x["url"]: (x["template_type"], x["assignment"]) for x in layout.templates(boxes(spark, pages), spark.createDataFrame(list(types.items()), "url string, template_type string")).collect()}
    assert len(out) == 40 and {a for _, a in out.values()} >= {"markup", "layout_over_type", "layout_without_markup", "shape"}
    assert {u: x for u, x in out.items() if x[1] != "shape"} == {u: x for u, x in expected.items() if x}


def test_clusters():
    a, b = {"x": 10.0, "y": 10.0}, {"x": 10.0, "y": 9.0, "z": 1.0}
    assert layout.clustered([a, {"q": 5.0}, b, {"q": 5.0, "r": 1.0}, a, {}]) == [[0, 4, 2], [1, 3], [5]]
    assert layout.clustered([]) == []
