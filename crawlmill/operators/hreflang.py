"""Defects of hreflang clusters, by joins of tags with the pages they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.functions import predicates as p
from crawlmill.functions import text as t
from crawlmill.functions import urls

c = F.col


def issues(pages: DataFrame) -> DataFrame:
    """row_id, url, kind, lang, target_url: a row for each defect of each page with tags. A target that wasn't crawled is not judged.

    Of several rows that normalise to one URL the last stands for it."""
    key = urls.normalized_or_trimmed
    tagged = pages.where(~p.empty("hreflang_tags"))
    tags = tagged.select("row_id", "url", key(c("url")).alias("me"), F.posexplode("hreflang_tags").alias("pos", "tag")).select("row_id", "url", "me", "pos", c("tag.lang").alias("lang"), c("tag.url").alias("target_url"), key(c("tag.url")).alias("to"))
    none = F.lit(None).cast("string")
    valid = t.is_valid_language(c("lang"), t.regions(pages.sparkSession))
    per_page = tags.groupBy("row_id", "url").agg(F.bool_or(c("lang") == "x-default").alias("x"), F.bool_or((c("lang") != "x-default") & (c("to") == c("me"))).alias("self"))
    whole = per_page.select("row_id", "url", F.explode(F.array_compact(F.array(F.when(~c("x"), "MissingXDefault"), F.when(~c("self"), "MissingSelfReference")))).alias("kind"), none.alias("lang"), none.alias("target_url"))
    wrong = tags.where((c("lang") != "x-default") & ~valid).select("row_id", "url", F.lit("InvalidLanguageCode").alias("kind"), "lang", none.alias("target_url"))
    crawled = pages.groupBy(key(c("url")).alias("to")).agg(F.max_by(F.struct("hreflang_tags", "canonical"), "row_id").alias("page")).select("to", F.transform(F.coalesce("page.hreflang_tags", F.array().cast("array<struct<lang:string,url:string>>")), lambda x: key(x["url"])).alias("back"), "page.canonical")
    met = tags.join(crawled, "to")
    no_return = met.where(~F.array_contains("back", c("me"))).select("row_id", "url", F.lit("MissingReturnTag").alias("kind"), "lang", "target_url")
    resolved = F.coalesce(urls.resolve_url(c("target_url"), c("canonical")), c("canonical"))
    other = met.where(p.yes((F.trim("canonical") != "") & (key(resolved) != c("to")))).select("row_id", "url", F.lit("NonCanonicalUrl").alias("kind"), none.alias("lang"), "target_url")
    return whole.unionByName(wrong).unionByName(no_return).unionByName(other)


def with_issues(pages: DataFrame) -> DataFrame:
    """pages with hreflang_issues made anew."""
    found = issues(pages).groupBy("row_id").agg(F.collect_list(F.struct("kind", "lang", "target_url")).alias("hreflang_issues"))  # of one page
    return pages.drop("hreflang_issues").join(found, "row_id", "left")
