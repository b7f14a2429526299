"""A crawl with every kind of fact, derived from the `pages` table by arithmetic on page_id.

Raw pages hold URLs and HTML only. For queries and their SQL twins the other facts of a page record follow from its number, in one SELECT that is
written once and rendered for Spark and for DuckDB; the two differ only in how they spell arrays, structs and a few functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlmill.operators.graph import stored


class Dialect:
    """How one engine spells nested values."""

    def __init__(self, duck: bool):
        self.duck = duck

    def arr(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def none(self, like: str) -> str:
        """An empty array of such items."""
        return f"([{like}])[1:0]" if self.duck else f"slice(array({like}), 1, 0)"

    def obj(self, **fields: str) -> str:
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")" if self.duck else "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def match(self, text: str, pattern: str) -> str:
        return f"regexp_extract({text}, '{pattern}', 1)"

    def text(self, kind: str = "VARCHAR") -> str:
        return kind if self.duck else {"VARCHAR": "STRING"}.get(kind, kind)


def _case(by: str, *choices: str, other: str = "NULL") -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(choices)) + f" ELSE {other} END"


def select(d: Dialect, source: str = "pages") -> str:
    """The page records as a SELECT over the pages table; row_id is page_id."""
    s = d.text()
    header = lambda k, v: d.obj(k=f"'{k}'", v=v)
    image = lambda src, n: d.obj(src=src, alt=_case(f"({n}) % 4", f"CAST(NULL AS {s})", "''", "repeat('alt ', 30)", other="'A picture'"), width=f"CASE WHEN ({n}) % 3 = 0 THEN NULL ELSE 100 END", height="50", has_alt_attr=f"({n}) % 4 <> 0")
    link = lambda dst, anchor, rel: d.obj(dst_url=dst, anchor=f"CAST({anchor} AS {s})", rel=f"CAST({rel} AS {s})", csr_only="id % 2 = 0")
    tag = lambda lang, url: d.obj(lang=lang, url=url)
    issue = lambda *kinds: d.arr(*(d.obj(kind=f"'{k}'") for k in kinds))
    names = lambda *x: d.arr(*(f"'{k}'" for k in x))
    rule = lambda r, i: d.obj(rule=f"'{r}'", impact=f"'{i}'", target="'main > p'", html="'<p>'")
    all_headers = [header("Strict-Transport-Security", "'max-age=1'"), header("Content-Security-Policy", "'x'"), header("X-Frame-Options", "'DENY'"), header("X-Content-Type-Options", "'nosniff'"), header("Referrer-Policy", "'no-referrer'")]
    return f"""
WITH p0 AS (
  SELECT page_id AS id, html, {d.match("html", "<title>([^<]*)</title>")} AS title0, {d.match("html", "<h1[^>]*>([^<]*)</h1>")} AS h10,
    CASE page_id % 31 WHEN 3 THEN url || '/Upper_Case' WHEN 5 THEN url || '//double' WHEN 7 THEN url || '/a space' WHEN 11 THEN url || '/é' WHEN 13 THEN url || '/' || repeat('x', 100) WHEN 17 THEN url || '/Style_1.css' ELSE url END AS url
  FROM {source}),
p1 AS (
  SELECT p.*, coalesce(n.url, p.url) AS nxt, coalesce(b.url, p.url) AS prv, coalesce(b2.url, p.url) AS prv2, coalesce(h.url, p.url) AS half, coalesce(r.url, p.url) AS res,
    CASE WHEN p.id % 20 = 0 THEN 404 WHEN p.id % 20 = 1 THEN 301 WHEN p.id % 20 = 2 THEN 302 WHEN p.id % 40 = 3 THEN 500 WHEN p.id % 20 = 4 THEN NULL ELSE 200 END AS status
  FROM p0 p LEFT JOIN p0 n ON n.id = p.id + 1 LEFT JOIN p0 b ON b.id = p.id - 1 LEFT JOIN p0 b2 ON b2.id = p.id - 2
    LEFT JOIN p0 h ON h.id = p.id - p.id % 50 LEFT JOIN p0 r ON r.id = p.id - p.id % 13)
SELECT CAST(id AS BIGINT) AS row_id, url, status,
  {_case("id % 13", "'text/css'", "'application/javascript'", "'image/png'", "'application/pdf'", "NULL", other="'text/html; charset=utf-8'")} AS content_type,
  CASE WHEN id % 37 = 0 THEN CAST(2500000 AS BIGINT) ELSE CAST(length(html) + id * 10 AS BIGINT) END AS size_bytes,
  CAST((id * 37) % 1500 AS BIGINT) AS response_time,
  {_case("id % 17", f"CAST(NULL AS {s})", "''", "'Shared title | Acme Store'", "h10", "'Acme Store ' || title0 || ' | AcmeStore'", "title0 || ' &amp; more | Acme Store'", "'Tiny'", other="title0 || ' | Acme Store'")} AS title,
  CASE WHEN id % 19 = 0 THEN 'Second' END AS title_2, CASE WHEN id % 19 = 1 THEN 3 ELSE 1 END AS title_count,
  {_case("id % 11", f"CAST(NULL AS {s})", "'Same description'", "repeat('long words ', 20)", "'R&#233;sum&#233; of the page'", other="'Description of ' || title0")} AS meta_description,
  CASE WHEN id % 23 = 0 THEN 'x' END AS meta_description_2,
  {_case("id % 15", f"CAST(NULL AS {s})", "'Shared heading'", "''", "'A &amp; B ' || h10", "repeat('h1 ', 30)", other="h10")} AS h1,
  CASE WHEN id % 14 = 0 THEN '' END AS h1_2, CASE WHEN id % 15 = 6 THEN 2 ELSE 1 END AS h1_count,
  {_case("id % 7", f"CAST(NULL AS {s})", "'Section'", "repeat('h2 ', 30)", other=f"'Part ' || CAST(id AS {s})")} AS h2,
  CASE WHEN id % 18 = 0 THEN 'two' END AS h2_2, CASE WHEN id % 18 = 1 THEN 4 ELSE 1 END AS h2_count, CASE WHEN id % 9 = 8 THEN NULL ELSE id % 9 = 0 END AS h2_non_sequential,
  {_case("id % 9", f"CAST(NULL AS {s})", "''", "url", "half", "'/local/path'", "nxt", "prv", "' '", other="'http://other.example/x'")} AS canonical,
  {_case("id % 12", "'noindex'", "'NOINDEX, nofollow'", "'none'", "'noarchive,nosnippet'", "'googlebot: nofollow'", other=f"CAST(NULL AS {s})")} AS robots,
  {_case("id % 6", d.none(all_headers[0]), d.arr(all_headers[0]), d.arr(*all_headers[:3]), d.arr(all_headers[3], header("referrer-policy", "'unsafe-url'")), d.arr(header("X-Robots-Tag", "'bot: noindex'"), header("x-robots-tag", "'nosnippet'")), other=d.arr(*all_headers))} AS headers,
  {_case("id % 10", "0", "NULL", other="CAST((id * 53) % 900 AS INT)")} AS word_count,
  CASE WHEN id % 25 < 2 THEN 'same' ELSE md5(html) END AS content_hash,
  CASE WHEN id % 27 = 0 THEN 2 WHEN id % 27 = 1 THEN 0 END AS near_duplicate_count, CASE WHEN id % 27 = 0 THEN 93 END AS closest_similarity,
  id % 10 <> 9 AS is_internal, id % 13 > 2 AS is_page, id % 13 <= 2 AS is_resource,
  CASE WHEN id % 13 = 1 AND id % 2 = 0 THEN 'fetch' WHEN id % 13 <= 2 THEN 'link' END AS resource_initiator,
  CASE WHEN status IS NULL THEN 'N/A' WHEN status = 200 AND id % 12 > 2 THEN 'Indexable' ELSE 'Non-Indexable' END AS indexability,
  CASE WHEN status = 301 AND id % 40 = 1 THEN nxt WHEN status = 301 AND id % 60 = 21 THEN nxt WHEN status = 302 AND id % 40 = 2 THEN prv WHEN status = 302 AND id % 60 = 22 THEN prv2 WHEN id % 77 = 5 THEN half END AS redirect_url,
  CASE WHEN id % 40 = 22 THEN 307 END AS redirect_status,
  CAST((id * 97) % 2500 AS BIGINT) AS ttfb_ms, CAST((id * 151) % 6000 AS BIGINT) AS lcp_ms, CAST(id % 50 AS DOUBLE) / 100 AS cls, CASE WHEN id % 4 > 0 THEN CAST((id * 131) % 4000 AS BIGINT) END AS fcp_ms,
  {_case("id % 9", d.arr(tag("'en'", "url"), tag("'de'", "nxt")), d.arr(tag("'x-default'", "url"), tag("'xx-yy'", "nxt"), tag("'en-GB'", "prv")), d.arr(tag("'fr'", "prv"), tag("'zh-Hant-TW'", "url")), other=d.none(tag("'en'", "url")))} AS hreflang_tags,
  {_case("id % 9", issue("MissingXDefault", "MissingReturnTag"), issue("InvalidLanguageCode"), issue("MissingSelfReference"), issue("NonCanonicalUrl", "NonCanonicalUrl"), other=d.none(d.obj(kind="'x'")))} AS hreflang_issues,
  {_case("id % 8", names("Product"), names("Article", "BreadcrumbList"), names("FAQPage", "HowTo"), names("Recipe", "VideoObject"), names("LocalBusiness", "Product"), other=d.none("'x'"))} AS sd_types,
  CASE WHEN id % 16 = 0 THEN 2 ELSE 0 END AS sd_errors, CASE WHEN id % 16 < 3 THEN 1 ELSE 0 END AS sd_warnings, CASE WHEN id % 8 < 4 THEN 1 ELSE 0 END AS sd_jsonld_count, CASE WHEN id % 8 = 4 THEN 1 ELSE 0 END AS sd_microdata_count,
  {_case("id % 5", d.none(image("res", "id")), d.arr(image("res", "id"), image("res", "id + 1")), d.arr(image("'https://img.example/logo.png'", "id")), d.arr(image("'data:image/png;base64,AAAA'", "id"), image("res", "id + 2")), other=d.arr(image("'https://img.example/' || CAST(id % 7 AS " + s + ")", "id + 3")))} AS images,
  CASE WHEN id % 6 = 5 THEN NULL ELSE id % 3 <> 0 END AS in_sitemap, CASE WHEN id % 3 <> 0 THEN 'https://www.example.com/sitemap.xml' END AS sitemap_url, CASE WHEN id % 3 = 1 THEN '2024-01-0' || CAST(1 + id % 9 AS {s}) END AS sitemap_lastmod,
  CASE WHEN id % 7 = 0 THEN {d.obj(price=f"CASE WHEN id % 2 = 0 THEN CAST(id AS {s}) || '.50' END", currency="'EUR'", availability="CASE id % 4 WHEN 0 THEN 'instock' WHEN 1 THEN ' OutOfStock' WHEN 2 THEN 'discontinued' END", sku=f"CASE WHEN id % 3 = 0 THEN 'S' || CAST(id AS {s}) END", gtin=f"CASE WHEN id % 5 = 0 THEN '4006381333931' WHEN id % 5 = 1 THEN '73 1234-5' || CAST(id % 10 AS {s}) WHEN id % 5 = 2 THEN '12345' END", brand="CASE WHEN id % 6 < 4 THEN 'Acme' END", has_image="id % 4 < 2", has_review_or_rating="id % 8 < 3")} END AS ecommerce,
  {_case("id % 6", d.none(link("url", "NULL", "NULL")), d.arr(link("nxt", "'Next'", "NULL"), link("prv", "' '", "'nofollow ugc'")), d.arr(link("half", "NULL", "NULL"), link("nxt", "'Next'", "NULL"), link("nxt", "'Again'", "NULL")), d.arr(link("'https://partner.example/a'", "'Partner'", "'NoFollow'")), d.arr(link("replace(url, 'https://', 'http://')", "'Self'", "NULL"), link("prv2", "'Two back'", "'sponsored'")), other=d.arr(link("url", "''", "NULL"), link("res", "'Resource'", "NULL")))} AS outlinks,
  CAST(id % 5 AS INT) AS inlinks_count, CAST(id % 4 AS INT) AS unique_inlinks_count, CAST(id % 3 AS INT) AS csr_inlinks_count, CAST(id % 2 AS INT) AS unique_csr_inlinks_count, id % 2 = 0 AS inlinks_complete,
  {_case("id % 10", d.arr(rule("image-alt", "critical")), d.arr(rule("label", "serious"), rule("link-name", "moderate")), d.arr(rule("button-name", "critical"), rule("color-contrast", "serious")), d.arr(rule("html-has-lang", "minor"), rule("heading-order", "moderate")), other=d.none(rule("x", "y")))} AS a11y_issues,
  CASE WHEN id % 10 IN (0, 1) THEN 1 WHEN id % 10 = 2 THEN 2 ELSE 0 END AS a11y_errors, CASE WHEN id % 10 = 1 THEN 1 WHEN id % 10 = 3 THEN 2 ELSE 0 END AS a11y_warnings,
  CAST((id * 29) % 800 AS INT) AS title_pixel_width, CAST((id * 41) % 1200 AS INT) AS meta_description_pixel_width,
  CASE WHEN id % 34 = 0 THEN true WHEN id % 34 = 1 THEN false END AS ssr_content_missing, CASE WHEN id % 33 = 0 THEN true END AS blocked_by_robots, id % 21 = 0 AS has_mixed_content, CASE WHEN id % 22 = 1 THEN NULL ELSE id % 22 <> 0 END AS has_body_tag,
  CAST(id % 4 AS INT) AS network_fetches, CAST(id % 2 AS INT) AS revalidated_fetches, CAST(id % 6 AS INT) AS depth, CAST(id % 101 AS DOUBLE) AS link_score, CAST(id * 7 AS BIGINT) AS transfer_bytes, CAST((id * 53) % 700 AS INT) AS ssr_word_count,
  CASE WHEN id % 5 < 3 THEN {d.obj(template="'T' || CAST(id % 3 AS " + s + ")", template_type="CASE WHEN id % 2 = 0 THEN 'Product' ELSE 'Article' END", assignment="CASE WHEN id % 4 = 0 THEN 'layout_without_markup' WHEN id % 4 = 1 THEN 'joined_by_layout' ELSE 'markup' END")} END AS layout
FROM p1"""


_stored: dict[tuple[str, str], DataFrame] = {}


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived page records of a folder's pages table. They are stored once an application, as a finished crawl is, and then read from Parquet."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("derived_pages_source")
        _stored[key] = stored(spark.sql(select(Dialect(False), "derived_pages_source")), "crawl")
    return _stored[key]


def before(pages: DataFrame) -> DataFrame:
    """An earlier state of a derived crawl: rows of every 17th id are new since then, some facts were different, and some URLs are gone."""
    from pyspark.sql import functions as F

    i = F.col("row_id")
    return pages.where(i % 17 != 4).withColumns(
        {
            "url": F.when(i % 19 == 5, F.concat("url", F.lit("/gone"))).otherwise(F.col("url")),
            "title": F.when(i % 7 == 1, F.lit("Old title")).otherwise(F.col("title")),
            "h1": F.when(i % 11 == 2, F.lit("Old heading")).otherwise(F.col("h1")),
            "status": F.when(i % 13 == 6, F.lit(503)).otherwise(F.col("status")),
            "word_count": F.when(i % 5 == 3, F.lit(7)).otherwise(F.col("word_count")),
        }
    )
