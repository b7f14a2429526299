"""Sitemaps as a source: robots.txt lines, urlsets and indexes, followed at most three levels deep."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlmill import schema

MOST_LEVELS = 3


def robots_sitemaps(text: str) -> list[str]:
    """The URLs of a robots.txt's Sitemap lines, in order, once each."""
    return list(dict.fromkeys(m[1] for line in text.splitlines() if (m := re.match(r"(?i)\s*sitemap\s*:\s*(\S+)", line))))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def parse(body: bytes) -> tuple[str, list[dict]]:
    """('urlset' | 'sitemapindex' | '', entries). Gzip is recognised by its first bytes; entries without a loc are dropped; broken XML has none."""
    try:
        if body[:2] == b"\x1f\x8b":
            body = gzip.decompress(body)
        root = ElementTree.fromstring(body.strip())
    except (ElementTree.ParseError, OSError, EOFError, ValueError):
        return "", []
    out = []
    for entry in root:
        kids = {_local(k.tag): (k.text or "").strip() for k in entry if _local(k.tag) in ("loc", "lastmod")}
        alternates = [{"lang": k.attrib["hreflang"], "url": k.attrib["href"]} for k in entry if _local(k.tag) == "link" and k.attrib.get("rel") == "alternate" and k.attrib.get("hreflang") and k.attrib.get("href")]
        if kids.get("loc"):
            out.append({"loc": kids["loc"], "lastmod": kids.get("lastmod") or None, "alternates": alternates})
    return _local(root.tag), out


def entries(fetched: DataFrame) -> DataFrame:
    """kind, sitemap, pos, loc, lastmod, alternates of fetched sitemaps (url, body)."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(kind, url, k, e["loc"], e["lastmod"], e["alternates"]) for url, body in zip(frame["url"], frame["body"]) for kind, es in [parse(bytes(body or b""))] for k, e in enumerate(es)]
            yield pd.DataFrame(rows, columns=["kind", "sitemap", "pos", "loc", "lastmod", "alternates"])

    return fetched.select("url", F.col("body").cast("binary").alias("body")).mapInPandas(parsed, f"kind string, sitemap string, pos long, loc string, lastmod string, alternates array<{schema.HREFLANG}>")


def sitemap_urls(fetched: DataFrame, starts: list[str], levels: int = MOST_LEVELS) -> DataFrame:
    """The entries of all urlsets reachable from starts through at most `levels` indexes. fetched: url, body of every file there is."""
    known = entries(fetched)
    front = fetched.sparkSession.createDataFrame([(s,) for s in starts], "sitemap string").distinct()
    seen = front
    for _ in range(levels):
        inner = known.where("kind = 'sitemapindex'").join(front, "sitemap").select(F.col("loc").alias("sitemap")).distinct()
        front = inner.join(seen, "sitemap", "left_anti")
        seen = seen.unionByName(front)
    return known.where("kind = 'urlset'").join(seen, "sitemap").select("loc", "lastmod", "sitemap", "pos", "alternates")


def first_entries(of: DataFrame, key: Column) -> DataFrame:
    """The first entry of each URL by key."""
    return of.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("sitemap", "pos"))).where("_n = 1").drop("_n")


def in_sitemap(pages: DataFrame, of: DataFrame) -> DataFrame:
    """pages with in_sitemap (NULL if the crawl has no sitemap), sitemap_url and sitemap_lastmod, matched by normalised URL."""
    from crawlmill.functions.urls import normalized_or_trimmed as key

    first = first_entries(of, key(F.col("loc"))).select("_k", F.col("sitemap").alias("sitemap_url"), F.col("lastmod").alias("sitemap_lastmod"))
    some = of.agg((F.count("*") > 0).alias("_any"))  # one row
    base = pages.drop("in_sitemap", "sitemap_url", "sitemap_lastmod")
    joined = base.withColumn("_u", key(F.col("url"))).join(first, F.col("_u") == F.col("_k"), "left").crossJoin(F.broadcast(some))
    return joined.withColumn("in_sitemap", F.when(F.col("_any"), F.col("_k").isNotNull())).drop("_u", "_k", "_any")


def orphans(pages: DataFrame, of: DataFrame) -> DataFrame:
    """Sitemap URLs that no page row has, by raw URL."""
    return of.select(F.col("loc").alias("url")).distinct().join(pages.select("url"), "url", "left_anti")


def known_urls(pages: DataFrame, of: DataFrame, blocked: DataFrame) -> DataFrame:
    """pages with rows for what a crawl knows of and didn't fetch: sitemap URLs without a row, then URLs that robots.txt blocks (a column url).

    A blocked URL that has a row of either kind is marked there and gets no second one."""
    base = pages.drop("blocked_by_robots").join(blocked.select("url", F.lit(True).alias("blocked_by_robots")).distinct(), "url", "left")
    alone = orphans(pages, of).join(blocked.select("url", F.lit(True).alias("blocked_by_robots")).distinct(), "url", "left").withColumn("in_sitemap", F.lit(True))
    rest = blocked.select("url").distinct().join(pages.select("url"), "url", "left_anti").join(alone.select("url"), "url", "left_anti").withColumn("blocked_by_robots", F.lit(True))
    return base.unionByName(alone, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)
