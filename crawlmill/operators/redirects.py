"""Redirects followed to their ends by pointer doubling: rounds grow as the logarithm of the longest chain, and no path is ever carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.functions import predicates as p
from crawlmill.functions import urls
from crawlmill.operators.graph import cut

c = F.col


def hops(pages: DataFrame) -> DataFrame:
    """node, to, status, redirect: one hop a URL, by its normalised form and, as "raw " and the URL, by its raw one; of several rows the last.

    By its raw form a URL hops to where the last of its rows that leads anywhere does. Both forms go through one table, so chains are followed once."""
    key = urls.normalized_or_trimmed
    raw = lambda u: F.concat(F.lit("raw "), u)
    forms = F.array(*(F.struct(form(c("url")).alias("node"), form(c("redirect_url")).alias("to"), F.lit(form is raw).alias("raw")) for form in (key, raw)))
    each = pages.select("row_id", "status", p.is_redirect().alias("redirect"), F.explode(forms).alias("hop")).where(~c("hop.raw") | c("hop.to").isNotNull())
    return each.groupBy("hop.node").agg(F.max_by(F.struct("hop.to", "status", "redirect"), "row_id").alias("last")).select("node", "last.*")


def ends(edges: DataFrame) -> DataFrame:
    """node, at: the last place on the way from node, which has no hop, or some place of the loop that the way leads into.

    A way of more hops than have been followed passes a node that the next round brings to its end; if a round brings none, all that
    still moves goes round in loops."""
    at = cut(edges.select("node", c("to").alias("at")))
    nodes = at.select(c("node").alias("at"))
    moving, before = at.join(nodes, "at", "left_semi").count(), None
    while moving and moving != before:
        step = at.select(c("node").alias("at"), c("at").alias("next"))
        at = cut(at.join(step, "at", "left").select("node", F.coalesce("next", "at").alias("at")))
        moving, before = at.join(nodes, "at", "left_semi").count(), moving
    return at


def ways(pages: DataFrame) -> DataFrame:
    """row_id, _to_redirect (its target redirects as well), _in_loop (by raw URLs), _end_status (of the last row of its chain) of rows that have any.

    Only URLs with a hop and those that hops lead to are followed: few next to all pages."""
    every = hops(pages)
    some = cut(every.where(c("to").isNotNull()).select("node", "to"))
    at = ends(some)
    # what rows lead to that aren't the last of their URL counts too
    asked = pages.select(urls.normalized_or_trimmed(c("redirect_url")).alias("node")).where("node is not null")
    met = every.join(asked.unionByName(at.select(c("at").alias("node"))).distinct(), "node", "left_semi")
    known = cut(met.select("node", "status", "redirect"))
    stop = at.join(known.where(~c("redirect")).select(c("node").alias("at"), c("status").alias("_end_status")), "at").select("node", "_end_status")
    loops = at.join(some.select(c("node").alias("at")), "at", "left_semi").where(c("node").startswith("raw ")).select(F.substr("node", F.lit(5)).alias("_url"), F.lit(True).alias("_in_loop"))
    key = urls.normalized_or_trimmed
    rows = pages.select("row_id", c("url").alias("_url"), key(c("url")).alias("_u"), key(c("redirect_url")).alias("_t"))
    joined = rows.join(known.select(c("node").alias("_t"), c("redirect").alias("_to_redirect")), "_t", "left").join(stop.select(c("node").alias("_u"), "_end_status"), "_u", "left").join(loops, "_url", "left")
    return joined.select("row_id", "_to_redirect", "_in_loop", "_end_status").where("_to_redirect is not null or _in_loop or _end_status is not null")
