"""Lines repeated across the documents of one site (problem 7).

Lines are normalised (lower case, trimmed, white-space runs as one blank) and
hashed to 128 bits together with their site.  Distinct documents per site and
line are counted in two aggregations, both combined before their shuffle, so a
line that stands in a third of all rows is spread over its documents first.
Frequent lines are joined back, by broadcast while their number is within a
bound and by a shuffle join (with AQE's skew split) beyond it.

Defined results: a line counts if it has at least ``min_chars`` characters after
normalising; a document without a host gives no site and no case; copies of a
row count once; null contents have no lines; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.copies import once
from folioforge.plans.session import cut

MIN_CHARS = 15
MIN_DOCUMENTS = 5
#: Frequent lines up to this number (24 bytes each) are broadcast.
BROADCAST_LINES = 500_000
#: Segments with such lines (a few line numbers each) up to this number are broadcast.
BROADCAST_SEGMENTS = 500_000


def host(url: Column) -> Column:
    """Host of a URL in lower case without port and leading ``www.``; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    found = F.regexp_replace(found, r"^www\.", "")
    return F.when(F.length(found) > 0, found)


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), r"(?U)\s+", " "))


def line_rows(segments: DataFrame, documents: DataFrame, id_col: str, document_col: str, content_col: str, min_chars: int) -> DataFrame:
    """(segment_id, line_no, document_id, site, k1, k2) of each line long enough; site is hashed, k1 and k2 hash site and line."""
    sites = documents.select(F.col("doc_id").alias("document_id"), host(F.col("url")).alias("site")).where(F.col("site").isNotNull()).groupBy("document_id").agg(F.min("site").alias("site"))
    lines = segments.select(F.col(id_col).cast("long").alias("segment_id"), F.col(document_col).cast("long").alias("document_id"), F.posexplode(F.split(content_col, "\n", -1)).alias("line_no", "raw"))
    lines = lines.where(F.length("raw") >= min_chars).select("segment_id", "document_id", "line_no", normal_line(F.col("raw")).alias("line")).where(F.length("line") >= min_chars)
    hashed = lines.select("segment_id", "document_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    return hashed.join(sites, "document_id").select("segment_id", "line_no", "document_id", F.xxhash64("site").alias("site"), F.xxhash64("site", "h1").alias("k1"), F.xxhash64("h2", "site").alias("k2"))


def repeated_lines(
    segments: DataFrame, documents: DataFrame, id_col: str = "id", document_col: str = "document_id", content_col: str = "content", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, min_share: float = 0.0
) -> DataFrame:
    """(segment_id, line_no) of each line that stands in ``min_documents`` documents of its site, and in ``min_share`` of those with lines."""
    rows = line_rows(segments, documents, id_col, document_col, content_col, min_chars)
    site = ["site"] if min_share > 0 else []
    rows = cut(rows.select("segment_id", "line_no", "document_id", "k1", "k2", *site), "lines")
    counted = rows.select("k1", "k2", *site, "document_id").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("documents"), *[F.first(c).alias(c) for c in site]).where(F.col("documents") >= min_documents)
    if site:
        sizes = rows.select("site", "document_id").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("all"))
        counted = counted.join(sizes, "site").where(F.col("documents") >= min_share * F.col("all"))
    frequent = counted.select("k1", "k2")
    frequent = cut(frequent, "frequent")
    if frequent.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    return rows.join(frequent, ["k1", "k2"], "left_semi").select("segment_id", "line_no").distinct()


def without_repeated_lines(segments: DataFrame, documents: DataFrame, id_col: str = "id", content_col: str = "content", **options) -> DataFrame:
    """(segment_id, content, removed): each content rebuilt without its site's repeated lines."""
    found = cut(repeated_lines(segments, documents, id_col=id_col, content_col=content_col, **options).groupBy("segment_id").agg(F.collect_set("line_no").alias("gone")), "gone")
    if found.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS:
        found = F.broadcast(found)
    base = once(segments.select(F.col(id_col).cast("long").alias("segment_id"), F.col(content_col).alias("content")), "segment_id", "content")
    kept = F.filter(F.split("content", "\n", -1), lambda line, i: ~F.array_contains("gone", i))
    return base.join(found, "segment_id", "left").select(
        "segment_id", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed")
    )
