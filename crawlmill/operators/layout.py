"""Page layouts as tables of boxes: differences between two captures of a page, and groups of pages that share a template.

A box is known by its path: the keys of the elements above it and its own, each with its place among equal siblings. Boxes are rows, so paths
are made by climbing one level a join for all pages at once, and both comparisons and templates are joins and aggregates on paths.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.operators.graph import cut, stored

c = F.col
TOLERANCE = 4
#: The shares that make a path part of every page, of a template's core, of its optional part, and a page a member.
CHROME, CORE, OPTIONAL, COVERED, EXPLAINED = 0.85, 0.75, 0.25, 0.85, 0.7
SAMPLE, CLUSTERED, SHAPE_CUT = 400, 600, 0.5
#: Classes that a build tool or a state puts on an element say nothing about what it is.
_UNSTABLE = r"^(is-|has-|js-|active$|open$|selected$|hover$|focus$|disabled$)|[0-9]{2,}|^[a-z]{0,3}[A-Z0-9][A-Za-z0-9_-]*[0-9]|__[A-Za-z0-9]{5,}$|^css-|^sc-"


def element_key(tag: Column, test_id: Column, classes: Column) -> Column:
    """tag, then [test id] if there is one, then the first stable class."""
    stable = F.get(F.filter(F.split(F.trim(F.coalesce(classes, F.lit(""))), r"\s+"), lambda x: (x != "") & ~x.rlike(_UNSTABLE)), F.lit(0))
    return F.concat(F.lower(tag), F.when(F.coalesce(test_id, F.lit("")) != "", F.concat(F.lit("["), test_id, F.lit("]"))).otherwise(""), F.coalesce(F.concat(F.lit("."), stable), F.lit("")))


def with_paths(boxes: DataFrame) -> DataFrame:
    """boxes with path: numbered keys from the root down; boxes whose parents are missing start at themselves.

    Paths are doubled: what is above a box so far is joined with what is above the topmost of it, so rounds grow as the logarithm of the
    depth. A box that is its own ancestor has no root; ValueError."""
    n = F.row_number().over(Window.partitionBy("url", "parent", "key").orderBy("idx"))
    own = cut(boxes.withColumn("step", F.concat("key", F.lit("#"), n)))
    known = own.select(c("url").alias("u"), c("idx").alias("i"))
    # at: the nearest box above the path so far, NULL at the root
    at = own.select("url", "idx", c("parent").alias("at"), c("step").alias("path"))
    at = cut(at.join(known, (c("url") == c("u")) & (c("at") == c("i")), "left").select("url", "idx", c("i").alias("at"), "path"))
    left, rounds = at.where("at is not null").count(), 0
    most = max(1, left).bit_length() + 1
    while left:
        if rounds > most:
            raise ValueError("boxes that are above themselves")
        up = at.select(c("url").alias("u"), c("idx").alias("i"), c("at").alias("next"), c("path").alias("above"))
        at = cut(at.join(up, (c("url") == c("u")) & (c("at") == c("i")), "left").select("url", "idx", c("next").alias("at"), F.when(c("i").isNotNull(), F.concat("above", F.lit(" > "), "path")).otherwise(c("path")).alias("path")))
        left, rounds = at.where("at is not null").count(), rounds + 1
    return own.join(at.select("url", "idx", "path"), ["url", "idx"])


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """url, path, kind, top: what changed in pages that both captures have.

    Added and Removed name the topmost such box only; Moved is left out where an earlier box of the same parent changed in height, or the
    parent moved as far; of one box the first of Resized, Moved, Restyled, Text, Image that applies is told."""
    fields = ("parent", "x", "y", "w", "h", "style", "text", "image")
    side = lambda df, s: with_paths(df).select("url", "path", *(c(k).alias(f"{k}_{s}") for k in fields), F.regexp_replace("path", " > [^>]*$", "").alias(f"up_{s}"), F.lit(True).alias(f"in_{s}"))
    common = before.select("url").distinct().join(after.select("url").distinct(), "url", "left_semi")
    b, a = side(before, "b").join(common, "url", "left_semi"), side(after, "a").join(common, "url", "left_semi")
    both = cut(b.join(a, ["url", "path"], "full_outer"))
    gone, new = c("in_a").isNull(), c("in_b").isNull()
    far = lambda k: F.abs(c(f"{k}_a") - c(f"{k}_b")) > TOLERANCE
    other = lambda k: ~c(f"{k}_a").eqNullSafe(c(f"{k}_b"))
    shift = F.struct((c("x_a") - c("x_b")).alias("dx"), (c("y_a") - c("y_b")).alias("dy"))
    up = both.select("url", c("path").alias("up"), F.when(gone, "gone").when(new, "new").alias("up_state"), shift.alias("up_shift"))
    told = both.withColumn("up", F.coalesce("up_a", "up_b")).withColumn("up", F.when(c("up") != c("path"), c("up"))).join(up, ["url", "up"], "left")
    pushed = F.coalesce(F.max(F.when(gone | new | far("h"), 1).otherwise(0)).over(Window.partitionBy("url", "up").orderBy(F.coalesce("y_a", "y_b"), "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = F.coalesce((F.abs(c("up_shift.dx") - (c("x_a") - c("x_b"))) <= TOLERANCE) & (F.abs(c("up_shift.dy") - (c("y_a") - c("y_b"))) <= TOLERANCE), F.lit(False))
    kind = (
        F.when(gone, F.when(c("up_state").isNull(), "Removed"))
        .when(new, F.when(c("up_state").isNull(), "Added"))
        .when(far("w") | far("h"), "Resized")
        .when((far("x") | far("y")) & ~carried & (c("pushed") == 0), "Moved")
        .when(other("style"), "Restyled")
        .when(other("text"), "Text")
        .when(other("image"), "Image")
    )
    return told.withColumn("pushed", pushed).withColumn("kind", kind).where("kind is not null").select("url", "path", "kind", F.coalesce("y_a", "y_b").alias("top"))


def summaries(of: DataFrame) -> DataFrame:
    """url, summary: each page's changes by kind, as `Added 2, Moved 1`."""
    kinds = of.groupBy("url", "kind").agg(F.count("*").alias("n"))
    return kinds.groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(" "), x["n"].cast("string"))), ", ").alias("summary"))


def _part(keys: Column) -> Column:
    """The last four keys of a path without their numbers."""
    return F.array_join(F.slice(keys, F.greatest(F.size(keys) - 3, F.lit(1)), F.lit(4)), " > ")


def shapes(boxes: DataFrame) -> DataFrame:
    """url, part, weight, above: the last four keys of each path, without numbers, the root of its largest box's area, and the parts above it."""
    keys = F.transform(F.split("path", " > "), lambda s: F.regexp_replace(s, "#[0-9]+$", ""))
    each = with_paths(boxes).select("url", keys.alias("keys"), F.sqrt((c("w") * c("h")).cast("double")).alias("area"))
    above = F.when(F.size("keys") > 1, F.transform(F.sequence(F.lit(1), F.size("keys") - 1), lambda n: _part(F.slice("keys", F.lit(1), n)))).otherwise(F.array().cast("array<string>"))
    each = each.select("url", _part(c("keys")).alias("part"), "area", above.alias("above"))
    return each.groupBy("url", "part").agg(F.max("area").alias("weight"), F.array_distinct(F.flatten(F.collect_set("above"))).alias("above"))  # of one page


def _explained(parts: DataFrame, contained: DataFrame, by: list[str]) -> DataFrame:
    """by, explained: how much of each page's weight lies in contained parts (by, part) or inside one."""
    sets = contained.groupBy(*by).agg(F.collect_set("part").alias("_in"))  # of one page and template
    inside = F.array_contains("_in", c("part")) | F.arrays_overlap("above", "_in")
    return parts.join(sets, "url").groupBy(*by).agg(F.sum(F.when(inside, c("weight")).otherwise(0.0)).alias("explained"))


def _learnt(parts: DataFrame, sample: DataFrame) -> DataFrame:
    """template_type, part, k, total, of: on how many of a type's `of` sampled pages a part is, and its weight there."""
    sizes = sample.groupBy("template_type").agg(F.count("*").alias("of"))
    counts = parts.join(sample, "url").groupBy("template_type", "part").agg(F.count("*").alias("k"), F.sum("weight").alias("total"))
    return counts.join(sizes, "template_type")


def _fit(parts: DataFrame, own: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """url, by, coverage, share of pages with the templates `known` (by, part, core, w) that they share a part with."""
    totals = known.groupBy(by).agg(F.sum(F.when(c("core"), c("w")).otherwise(0.0)).alias("core_total"))
    met = cut(parts.select("url", "part").join(known, "part"))
    hit = met.groupBy("url", by).agg(F.sum(F.when(c("core"), c("w")).otherwise(0.0)).alias("covered"))
    fit = hit.join(_explained(parts, met, ["url", by]), ["url", by]).join(totals, by).join(own, "url")
    return fit.select("url", by, F.when(c("core_total") > 0, c("covered") / c("core_total")).otherwise(0.0).alias("coverage"), (c("explained") / c("page_total")).alias("share"))


_passes = lambda: (c("coverage") >= COVERED) & (c("share") >= EXPLAINED)


def _judged(parts: DataFrame, own: DataFrame, typed: DataFrame, learnt: DataFrame) -> DataFrame:
    """url, template_type, in_sample, fits: whether a page fits the template of the type it names, learnt from other pages than itself.

    Leaving a page out takes one off the counts of its own parts; of all other parts only the number of pages changes, once a type."""
    alone = F.when(c("in_sample"), c("of") - 1).otherwise(c("of"))
    often = lambda k, n, share: (k > 0) & (k / F.greatest(n, F.lit(1)) >= share)
    for_n = lambda n: F.sum(F.when(often(c("k"), n, CORE), c("total") / c("k")).otherwise(0.0))
    base = learnt.groupBy("template_type").agg(for_n(c("of")).alias("whole"), for_n(c("of") - 1).alias("less"))
    k = F.when(c("in_sample"), c("k") - 1).otherwise(c("k"))
    w = F.when(c("in_sample"), c("total") - c("weight")).otherwise(c("total")) / F.greatest(k, F.lit(1))
    mine = parts.join(typed, "url").join(learnt, ["template_type", "part"])
    mine = mine.select("url", "template_type", "part", "weight", "in_sample", F.when(often(c("k"), alone, CORE), c("total") / c("k")).otherwise(0.0).alias("before"), often(k, alone, CORE).alias("core"), (often(k, alone, OPTIONAL) & (k >= 2)).alias("optional"), w.alias("w"))
    mine = cut(mine)
    hit = mine.groupBy("url").agg(F.sum(F.when(c("core"), c("w")).otherwise(0.0)).alias("covered"), F.sum("before").alias("before"))
    explained = _explained(parts, mine.where("core or optional").select("url", "part"), ["url"])
    out = typed.join(base, "template_type", "left").join(hit, "url", "left").join(explained, "url", "left").join(own, "url", "left")
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    total = F.when(c("in_sample"), zero("less") - zero("before") + zero("covered")).otherwise(zero("whole"))
    out = out.withColumns({"coverage": F.when(total > 1e-9, zero("covered") / total).otherwise(0.0), "share": F.when(c("page_total") > 0, zero("explained") / c("page_total")).otherwise(1.0)})
    return out.select("url", "template_type", "in_sample", ((c("members") < 3) | _passes()).alias("fits"))


def clustered(shapes_: list[dict[str, float]], least: float = SHAPE_CUT) -> list[list[int]]:
    """Clusters by average linkage of weighted Jaccard similarity until none are closer than `least`, the largest first."""
    names = {p: k for k, p in enumerate(dict.fromkeys(p for s in shapes_ for p in s))}
    m = np.zeros((len(shapes_), max(1, len(names))))
    for k, s in enumerate(shapes_):
        for part, weight in s.items():
            m[k, names[part]] = weight
    near = np.array([[1.0] * len(m)] * 0).reshape(0, len(m))
    for row in m:
        top = np.maximum(row, m).sum(axis=1)
        near = np.vstack((near, np.where(top > 0, np.minimum(row, m).sum(axis=1) / np.where(top > 0, top, 1), 1.0)))
    groups: list[list[int] | None] = [[k] for k in range(len(m))]
    upper = np.triu(np.ones(near.shape, bool), 1)
    while len(m) > 1:
        open_ = np.where(upper, near, -1.0)
        first, second = divmod(int(open_.argmax()), len(m))
        if open_[first, second] < least:
            break
        a, b = groups[first], groups[second]
        joined = (near[first] * len(a) + near[second] * len(b)) / (len(a) + len(b))
        near[first], near[:, first] = joined, joined
        upper[second], upper[:, second] = False, False
        groups[first], groups[second] = a + b, None
    return sorted((g for g in groups if g), key=len, reverse=True)


def templates(boxes: DataFrame, types: DataFrame) -> DataFrame:
    """url, template_type, assignment (markup, layout_without_markup, layout_over_type, shape, other).

    types: url, template_type of pages whose markup names one. Parts on most pages are left out. A type's template is learnt from SAMPLE pages
    at most, the first by hash: its core are parts on three quarters of them, its optional parts those on a quarter. A page that names a type
    belongs to it if it fits the template that the others make; types of one or two pages are believed. Other pages belong to the type, learnt
    from fitting pages, whose core they cover best. What is left is clustered by shape: the first CLUSTERED pages by hash make the clusters,
    named Layout 1, 2, ... by size, and the rest join the cluster they fit, or are other layouts."""
    all_parts = stored(shapes(boxes), "shapes")
    pages = boxes.select("url").distinct()
    n = pages.agg(F.count("*").alias("n_pages"))
    chrome = all_parts.groupBy("part").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).where(c("k") >= CHROME * c("n_pages")).select("part")
    parts = stored(all_parts.join(chrome, "part", "left_anti"), "parts")
    own = parts.groupBy("url").agg(F.sum("weight").alias("page_total"))
    rank = F.row_number().over(Window.partitionBy("template_type").orderBy(F.xxhash64("url"), "url"))
    members = types.join(pages, "url", "left_semi").groupBy("template_type").agg(F.count("*").alias("members"))
    ranked = types.join(pages, "url", "left_semi").withColumn("r", rank).where(c("r") <= SAMPLE).select("url", F.lit(True).alias("in_sample"))
    typed = types.join(pages, "url", "left_semi").join(members, "template_type").join(ranked, "url", "left").withColumn("in_sample", F.coalesce("in_sample", F.lit(False)))
    typed = cut(typed.select("url", "template_type", "members", "in_sample"))
    judged = cut(_judged(parts, own, typed, cut(_learnt(parts, typed.where("in_sample").select("url", "template_type")))))
    fitting = judged.where("in_sample and fits").select("url", "template_type")
    known = _template(_learnt(parts, fitting), "template_type")
    rest = pages.join(judged.where("fits").select("url"), "url", "left_anti").join(judged.select("url", c("template_type").alias("named")), "url", "left")
    fit = _fit(parts.join(rest.select("url"), "url", "left_semi"), own, known, "template_type").where(_passes())
    fit = fit.join(rest, "url").where(~c("template_type").eqNullSafe(c("named")))
    best = fit.groupBy("url").agg(F.max_by(F.struct("template_type", "named"), F.struct("coverage", "template_type")).alias("b"))
    best = cut(best.select("url", "b.template_type", F.when(c("b.named").isNotNull(), "layout_over_type").otherwise("layout_without_markup").alias("assignment")))
    told = judged.where("fits").select("url", "template_type", F.lit("markup").alias("assignment")).unionByName(best)
    return told.unionByName(_by_shape(parts, own, cut(rest.join(best.select("url"), "url", "left_anti").select("url"))))


def _template(learnt: DataFrame, by: str) -> DataFrame:
    core, some = c("k") >= CORE * c("of"), (c("k") >= OPTIONAL * c("of")) & (c("k") >= 2)
    return cut(learnt.where(core | some).select(by, "part", core.alias("core"), (c("total") / c("k")).alias("w")))


def _by_shape(parts: DataFrame, own: DataFrame, left: DataFrame) -> DataFrame:
    """url, template_type, assignment of pages that fit no type. The driver gets the parts of CLUSTERED pages."""
    first = left.orderBy(F.xxhash64("url"), "url").limit(CLUSTERED)
    got = first.join(parts.select("url", "part", "weight"), "url", "left").orderBy("url", "part").collect()
    shapes_: dict[str, dict[str, float]] = {}
    for r in got:
        own_ = shapes_.setdefault(r["url"], {})
        if r["part"] is not None:
            own_[r["part"]] = r["weight"]
    names = list(shapes_)
    rows = [(names[k], f"Layout {number}") for number, group in enumerate(clustered(list(shapes_.values())), 1) for k in group]
    made = left.sparkSession.createDataFrame(rows, "url string, template_type string")
    fit = _fit(parts.join(left.join(made, "url", "left_anti"), "url", "left_semi"), own, _template(_learnt(parts, made), "template_type"), "template_type").where(_passes())
    best = fit.groupBy("url").agg(F.max_by("template_type", F.struct("coverage", "template_type")).alias("joined"))
    out = left.join(made, "url", "left").join(best, "url", "left")
    name = F.coalesce("template_type", "joined")
    return out.select("url", F.coalesce(name, F.lit("Other layouts")).alias("template_type"), F.when(name.isNotNull(), "shape").otherwise("other").alias("assignment"))


def template_rows(assigned: DataFrame, changed: DataFrame | None = None, by: str = "url") -> DataFrame:
    """layout_template, layout_pages, layout_missing_markup, layout_changed, layout_common_change: a row a template, most pages first.

    changed: summary of the pages that changed, told by the column `by` (URLs may repeat among pages, row ids don't); of several the first by text."""
    if changed is not None:
        assigned = assigned.join(changed.groupBy(by).agg(F.min("summary").alias("summary")), by, "left")
    else:
        assigned = assigned.withColumn("summary", F.lit(None).cast("string"))
    modal = assigned.where("summary is not null").groupBy("template_type", "summary").agg(F.count("*").alias("n")).groupBy("template_type").agg(F.min_by("summary", F.struct(-c("n"), c("summary"))).alias("layout_common_change"))
    rows = assigned.groupBy("template_type").agg(F.count("*").alias("layout_pages"), F.count_if(c("assignment") == "layout_without_markup").alias("layout_missing_markup"), F.count("summary").alias("layout_changed"))
    return rows.join(modal, "template_type", "left").withColumnRenamed("template_type", "layout_template").orderBy(F.desc("layout_pages"), "layout_template")
