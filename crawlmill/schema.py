"""Schemas of a crawl's tables. Absent lists are empty arrays or NULL; every operator treats both alike."""

from __future__ import annotations

IMAGE = "struct<src:string,alt:string,width:int,height:int,has_alt_attr:boolean>"
OUTLINK = "struct<dst_url:string,anchor:string,rel:string,csr_only:boolean>"
HEADER = "struct<k:string,v:string>"
HREFLANG = "struct<lang:string,url:string>"
HREFLANG_ISSUE = "struct<kind:string,lang:string,target_url:string>"
A11Y = "struct<rule:string,impact:string,target:string,html:string>"
SD_ITEM = "struct<format:string,type_name:string,raw_json:string>"
SD_ISSUE = "struct<severity:string,type_name:string,code:string,message:string>"
ECOMMERCE = "struct<price:string,currency:string,availability:string,sku:string,gtin:string,brand:string,has_image:boolean,has_review_or_rating:boolean>"
LAYOUT = "struct<template:string,template_type:string,assignment:string>"

#: A page record: one crawled URL and what is known of it.
PAGE = ", ".join(
    (
        "url string, status int, content_type string, size_bytes long, response_time long, title string, meta_description string, h1 string, h2 string",
        "canonical string, robots string, word_count int, depth int, is_internal boolean, is_page boolean, is_resource boolean, resource_initiator string",
        "indexability string, h1_count int, h2_count int, h2_non_sequential boolean, network_fetches int, revalidated_fetches int, transfer_bytes long, title_count int",
        f"hreflang_tags array<{HREFLANG}>, sd_types array<string>, sd_errors int, sd_warnings int, ttfb_ms long, lcp_ms long, cls double, fcp_ms long",
        f"sd_jsonld_count int, sd_microdata_count int, sd_items array<{SD_ITEM}>, sd_issues array<{SD_ISSUE}>, images array<{IMAGE}>, content_hash string, simhash long",
        "closest_similarity int, near_duplicate_count int, near_duplicate_urls array<string>, hreflang_sources array<string>, in_sitemap boolean, sitemap_url string, sitemap_lastmod string",
        f"og_type string, ecommerce {ECOMMERCE}, outlinks array<{OUTLINK}>, subresources array<struct<url:string,kind:string>>, inlinks_count int, unique_inlinks_count int",
        "csr_inlinks_count int, unique_csr_inlinks_count int, inlinks_complete boolean, a11y_errors int, a11y_warnings int",
        f"a11y_issues array<{A11Y}>, headers array<{HEADER}>, redirect_url string, redirect_status int, link_score double",
        "backlinks array<struct<source_url:string,anchor:string,rel:string>>, title_2 string, meta_description_2 string, h1_2 string, h2_2 string",
        f"title_pixel_width int, meta_description_pixel_width int, hreflang_issues array<{HREFLANG_ISSUE}>, ssr_word_count int, ssr_h1 string, ssr_content_missing boolean",
        f"blocked_by_robots boolean, has_mixed_content boolean, has_body_tag boolean, layout {LAYOUT}, row_id long",
    )
)
LINKS = "src string, dst string, anchor string, rel string, internal boolean, csr_only boolean, pos long"
SITEMAP_URLS = "loc string, lastmod string, sitemap string, pos long, alternates array<struct<lang:string,url:string>>"
LAYOUT_BOXES = "url string, idx int, parent int, key string, x int, y int, w int, h int, style string, text string, image string"
CRAWLS = "id long, root_url string, started_at long, finished_at long, config_json string, aborted boolean"


def complete(pages):
    """pages with every column of PAGE, absent ones as NULL of their type."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    return pages.withColumns({f.name: F.lit(None).cast(f.dataType) for f in _parse_datatype_string(PAGE).fields if f.name not in pages.columns})
