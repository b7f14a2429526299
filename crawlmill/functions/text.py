"""Measures and tests of texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Glyph advances of the two fonts that search results use, in font units, from U+0020 to U+007E and from U+00A0 to U+00FF,
#: then single characters beyond.
TITLE_ASCII = (
    "232 236 320 640 540 828 623 177 321 321 425 556 236 439 236 300 643 430 524 533 591 559 555 527 550 555 236 236 "
    "495 566 495 487 882 670 600 736 701 544 529 806 696 243 530 627 505 864 706 822 574 822 591 555 530 667 633 944 "
    "619 585 570 316 300 316 463 476 397 531 600 540 600 561 362 595 562 209 209 504 209 873 559 594 600 600 370 471 "
    "364 559 508 775 473 508 486 311 235 311 534 "
)
TITLE_LATIN1 = (
    "232 236 529 523 609 570 235 544 392 530 472 546 571 0 530 399 322 542 298 318 397 629 612 236 403 233 513 546 "
    "677 718 770 462 670 670 670 670 670 670 953 736 544 544 544 544 243 243 243 243 713 706 822 822 822 822 822 544 "
    "822 667 667 667 667 585 574 553 531 531 531 531 531 531 919 540 561 561 561 561 209 209 209 209 566 559 594 594 "
    "594 594 594 542 594 559 559 559 559 508 600 508 "
)
TITLE_EXTRA = {0x0152: 1158, 0x0153: 1001, 0x0160: 555, 0x0161: 471, 0x0178: 585, 0x017D: 570, 0x017E: 486, 0x0192: 573, 0x02C6: 395, 0x02DC: 398, 0x2013: 600, 0x2014: 900, 0x2018: 222, 0x2019: 222, 0x201A: 222, 0x201C: 391, 0x201D: 391, 0x201E: 391, 0x2020: 432, 0x2021: 432, 0x2022: 379, 0x2026: 696, 0x2030: 1093, 0x2039: 346, 0x203A: 346, 0x20AC: 634, 0x2122: 497, 0x2212: 556}
TEXT_ASCII = (
    "569 569 727 1139 1139 1821 1366 391 682 682 797 1196 569 682 569 569 1139 1139 1139 1139 1139 1139 1139 1139 1139 1139 569 569 "
    "1196 1196 1196 1139 2079 1366 1366 1479 1479 1366 1251 1593 1479 569 1024 1366 1139 1706 1479 1593 1366 1593 1479 1366 1251 1479 1366 1933 "
    "1366 1366 1251 569 569 569 961 1139 682 1139 1139 1024 1139 1139 569 1139 1139 455 455 1024 455 1706 1139 1139 1139 1139 682 1024 "
    "569 1139 1024 1479 1024 1024 1024 684 532 684 1196 "
)
TEXT_LATIN1 = (
    "569 682 1139 1139 1139 1139 532 1139 682 1509 758 1139 1196 682 1509 1131 819 1124 682 682 682 1180 1100 569 682 682 748 1139 "
    "1708 1708 1708 1251 1366 1366 1366 1366 1366 1366 2048 1479 1366 1366 1366 1366 569 569 569 569 1479 1479 1593 1593 1593 1593 1593 1196 "
    "1593 1479 1479 1479 1479 1366 1366 1251 1139 1139 1139 1139 1139 1139 1821 1024 1139 1139 1139 1139 569 569 569 569 1139 1139 1139 1139 "
    "1139 1139 1139 1124 1251 1139 1139 1139 1139 1024 1139 1024 "
)
TEXT_EXTRA = {0x0152: 2048, 0x0153: 1933, 0x0160: 1366, 0x0161: 1024, 0x0178: 1366, 0x017D: 1251, 0x017E: 1024, 0x0192: 1139, 0x02C6: 682, 0x02DC: 682, 0x2013: 1139, 0x2014: 2048, 0x2018: 455, 0x2019: 455, 0x201A: 455, 0x201C: 682, 0x201D: 682, 0x201E: 682, 0x2020: 1139, 0x2021: 1139, 0x2022: 717, 0x2026: 2048, 0x2030: 2048, 0x2039: 682, 0x203A: 682, 0x20AC: 1139, 0x2122: 2048, 0x2212: 1196}
#: The languages that an hreflang code may name.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr "
    "fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln "
    "lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk "
    "sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu "
).split()
LONG_LANGUAGES = "ast ceb chr fil gsw haw hmn ilo kok lus mai nso pap sco syr tlh yue zxx".split()
#: What stands between a page's own title and the site's name.
SEPARATORS = [" | ", " - ", " \u2013 ", " \u2014 ", " \u00b7 ", " \u2022 ", " \u00bb ", " :: ", " / "]
LEAST_SITE_PAGES = 5
WIDE = [(0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x20000, 0x3FFFD)]


def _width(text: Column, ascii_: str, latin1: str, extra: dict[int, int], em: int, size: int, other: int) -> Column:
    table = dict(zip(range(0x20, 0x7F), map(int, ascii_.split()))) | dict(zip(range(0xA0, 0x100), map(int, latin1.split()))) | extra
    known = F.create_map(*(F.lit(x) for c, n in table.items() for x in (chr(c), n)))

    def advance(c: Column) -> Column:
        code = F.ascii(c)  # of a single character: its code point
        wide = F.lit(False)
        for a, b in WIDE:
            wide = wide | code.between(a, b)
        none = (code < 0x20) | code.between(0x200B, 0x200F) | code.isin(0x2060, 0xFEFF)
        return F.coalesce(F.try_element_at(known, c), F.when(none, 0).when(wide, em).otherwise(other))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    units = F.aggregate(chars, F.lit(0), lambda total, c: total + advance(c))
    return F.floor(units * F.lit(float(size)) / F.lit(float(em)) + 0.5).cast("int")


def title_pixel_width(text: Column) -> Column:
    """Pixels of a title as search results show it."""
    return _width(text, TITLE_ASCII, TITLE_LATIN1, TITLE_EXTRA, 1000, 22, 559)


def description_pixel_width(text: Column) -> Column:
    return _width(text, TEXT_ASCII, TEXT_LATIN1, TEXT_EXTRA, 2048, 14, 1139)


def word_count(text: Column) -> Column:
    """Words between white space that hold a letter."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w.rlike(r"\p{L}")))


def contains_html_entity(text: Column) -> Column:
    return text.rlike("&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);")


def title_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def title_suffix(title: Column) -> Column:
    """What follows the last separator, as one run of letters and digits; NULL without a separator or a letter."""
    last = F.regexp_extract(title, "(?s)^.*(?:" + "|".join(r"\Q" + s + r"\E" for s in SEPARATORS) + ")(.*)$", 1)
    name = F.array_join(title_words(last), "")
    return F.when(name.rlike(r"\p{L}"), name)


def names_site_twice(title: Column, site: Column) -> Column:
    """Whether the site's name stands in the title more than once, as whole words, written as one word or several.

    The words become a text of marked words; a name's letters may have marks between them but must start and end at one."""
    marked = F.concat(F.lit("\x01"), F.array_join(title_words(title), "\x01"), F.lit("\x01"))
    spread = F.concat(F.lit("\x01"), F.array_join(F.filter(F.split(site, ""), lambda c: c != ""), "\x01?"), F.lit("(?=\x01)"))
    return F.coalesce(F.regexp_count(marked, spread) > 1, F.lit(False))


def gtin_is_valid(gtin: Column) -> Column:
    """8, 12, 13 or 14 digits, spaces and hyphens aside, whose last digit is the check digit."""
    digits = F.regexp_replace(gtin, "[ -]", "")
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.try_cast("int"))
    total = F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 1, d * 3).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return F.coalesce(digits.rlike("^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})$") & (total % 10 == 0), F.lit(False))


def regions(spark: SparkSession) -> list[str]:
    """The countries of ISO 3166-1 as the JVM lists them, with two that search engines accept."""
    return sorted({*spark._jvm.java.util.Locale.getISOCountries(), "UK", "EU"})


def is_valid_language(code: Column, regions_: list[str]) -> Column:
    """x-default, or a known language with an optional script and an optional region behind it."""
    c = F.lower(F.trim(code))
    region = "(" + "|".join(r.lower() for r in regions_) + "|[0-9]{3})"
    return (c == "x-default") | c.rlike("^(" + "|".join(LANGUAGES + LONG_LANGUAGES) + f")(-[a-z]{{4}})?(-{region})?$")


def format_size(size: Column) -> Column:
    """'' for none, else bytes, KB or MB with one decimal."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("")).when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.format_string("%.1f KB", size / F.lit(1024.0))).otherwise(F.format_string("%.1f MB", size / F.lit(1048576.0)))


def parse_number(text: Column) -> Column:
    """A number, also with a unit behind it (`500ms`, `12%`); NULL if there is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.regexp_replace(F.trim(text), "[^0-9]+$", "").try_cast("double"))


def parse_size(text: Column) -> Column:
    """Bytes of `12`, `3 B`, `4.5 KB`, `1 MB` or `2 GB`."""
    n = F.regexp_extract(F.trim(text), r"^([0-9.]+)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(F.trim(text), r"([A-Za-z]*)$", 1))
    return n * F.when(unit == "KB", 1024.0).when(unit == "MB", 1048576.0).when(unit == "GB", 1073741824.0).otherwise(1.0)


def ssr_diff_label(ssr: Column, csr: Column) -> Column:
    """How much of a page's words only scripts bring, in percent."""
    return F.when(csr > 0, F.concat(F.round(F.greatest(csr - ssr, F.lit(0)) / csr * 100).cast("int").cast("string"), F.lit("%")))


def percent(part: Column, whole: Column) -> Column:
    """A rounded percentage; NULL for none."""
    return F.when((part > 0) & (whole > 0), F.concat(F.round(part / whole * 100).cast("int").cast("string"), F.lit("%")))
