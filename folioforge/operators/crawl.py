"""Crawl policy over tables of pages and links: content scores, priorities, what to visit next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import urls
from folioforge.functions.text import contains_any

# What marks documentation in a page's source, and words of API descriptions.
CODE_MARKS = ("<code[^>]*>", "<pre[^>]*>", "```[\\w]*\\n", "class\\s+\\w+", "function\\s+\\w+", "def\\s+\\w+", "@param\\s+", ":param\\s+", "@returns?\\s+", ":returns?:", "import\\s+", "require\\s*\\(", "#include\\s*<")
API_WORDS = ("parameter", "returns", "throws", "exception", "example", "usage", "syntax", "arguments", "options", "configuration")


def content_scores(page: Column) -> Column:
    """struct(code_density, api_indicators, navigation_ratio, overall), each between 0 and 1."""
    marks = sum((F.regexp_count(page, F.lit(f"(?i){m}")) for m in CODE_MARKS), F.lit(0))
    code = F.least(F.lit(1.0), marks / F.greatest(F.lit(1.0), F.length(page) / 1_000))
    low = F.lower(page)
    api = F.least(F.lit(1.0), sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in API_WORDS), F.lit(0)) / 5)
    plain = F.length(F.regexp_replace(page, "<[^>]+>", ""))
    navigation = F.when(plain > 0, 1 - F.least(F.lit(1.0), F.regexp_count(page, F.lit(r"(?i)<a\s+[^>]*href=")) * 50 / plain)).otherwise(0.0)
    overall = code * 0.4 + api * 0.3 + navigation * 0.3
    return F.when(F.length(page) > 0, F.struct(code.alias("code_density"), api.alias("api_indicators"), navigation.alias("navigation_ratio"), overall.alias("overall")))


def depth_after(overall: Column, depth: int, strategy: str = "auto") -> Column:
    """How deep to go on from a page of this score; 0 stops."""
    if strategy == "manual":
        return F.lit(depth)
    if strategy == "conservative":
        return F.when(overall < 0.6, 0).otherwise(min(2, depth))
    if strategy == "aggressive":
        return F.when(overall < 0.2, 0).otherwise(depth)
    return F.when(overall > 0.7, max(3, depth)).when(overall > 0.4, min(2, depth)).when(overall > 0.2, 1).otherwise(0)


def next_links(links: DataFrame, visited: DataFrame, depth: int, per_page: int | None = None, strategy: str = "auto") -> DataFrame:
    """(page, link, priority, rank) of the links of (page, position, link) to follow, best first, that weren't visited."""
    decided = links.withColumn("d", urls.link_decision(F.col("link"), F.col("page"), depth, strategy)).where("d.follow")
    new = decided.join(visited.select(F.col("url").alias("link")).distinct(), "link", "left_anti")
    once = new.groupBy("page", "link").agg(F.min("position").alias("position"), F.max("d.priority").alias("priority"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("priority"), "position")))
    ranked = ranked if per_page is None else ranked.where(F.col("rank") <= per_page)
    return ranked.select("page", "link", "priority", "rank")


def plain_links(page: Column) -> Column:
    """Distinct http links of a page's source in their order, without styles, scripts, images and anchors."""
    found = F.array_distinct(F.regexp_extract_all(page, F.lit(r"""href=["']([^"'\s>]+)["']"""), F.lit(1)))
    skipped = ("css", "js", ".png", ".jpg", ".gif", ".svg", ".ico", "#", "mailto:", "javascript:")
    return F.filter(found, lambda x: x.rlike("^https?://") & ~contains_any(F.lower(x), skipped))


def kept_sections(segments: DataFrame, wanted: list[str]) -> DataFrame:
    """Segments whose title holds one of the wanted names; all of them when none is wanted."""
    return segments.where(contains_any(F.lower(F.coalesce("section_title", F.lit(""))), tuple(w.lower() for w in wanted))) if wanted else segments


def cache_decision(status: Column, etag_same: Column, modified: Column, last_seen: Column) -> Column:
    """What a conditional answer of a server means: ``unchanged``, ``changed`` or ``unknown``."""
    return F.when((status == 304) | F.coalesce(etag_same, F.lit(False)), "unchanged").when(F.coalesce(modified <= last_seen, F.lit(False)), "unchanged").when(status == 200, "changed").otherwise("unknown")
