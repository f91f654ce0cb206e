"""Relevance-ranked text search, filter-only listing and contextual preference.

A search is one lazy plan: scan, filter, join of the small dimension, a window
that keeps one hit per section path, and a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import query_terms

#: Documents with a term in their title, up to this number, are broadcast.
BROADCAST_DOCUMENTS = 1_000_000


@dataclass(frozen=True)
class SearchOptions:
    """How to search; ``dedup`` keeps one hit per ``section_path`` of all documents, or per ``document_section``."""

    limit: int = 5
    min_score: float = 0.0
    max_terms: int = 3
    dedup: str = "section_path"
    filters: tuple[Column, ...] = field(default=())


def segment_view(segments: DataFrame, documents: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """Segments beside their document (and library).

    Copies of a row stay here, since telling them apart would shuffle every
    content; the searches below keep one row of each section anyway.
    """
    seg = segments.select("id", "document_id", "content", "section_title", "section_path", "section_level", "segment_type", "position")
    doc = documents.select(F.col("doc_id").alias("document_id"), "title", "url", "version", "library_id", "is_library_doc", "scraped_at", "updated_at")
    view = seg.join(doc, "document_id")
    if libraries is not None:
        view = view.join(libraries.select(F.col("id").alias("library_id"), F.col("name").alias("library_name")), "library_id", "left")
    return view


def relevance(terms: list[str]) -> Column:
    """First matching rule in term order: content and section title, content and document title, content, else 0.5."""
    content, section, title = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("content", "section_title", "title"))
    score = F.lit(0.5)
    for i, term in reversed(list(enumerate(terms))):
        inside = F.contains(content, F.lit(term))
        score = F.when(inside & F.contains(section, F.lit(term)), 10.0 - 0.5 * i).when(inside & F.contains(title, F.lit(term)), 8.0 - 0.5 * i).when(inside, 5.0 - 0.5 * i).otherwise(score)
    return score


def matches(terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        for column in ("content", "title", "section_title"):
            out = out | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(term))
    return out


def _one_per_section(hits: DataFrame, order: list[Column], dedup: str) -> DataFrame:
    keys = ["section_path"] if dedup == "section_path" else ["document_id", "section_path"]
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") == 1).drop("rn")


def text_search(view: DataFrame, query: str, options: SearchOptions | None = None) -> DataFrame:
    """Hits of a query in ``segment_view``, best first; empty query gives no rows."""
    options = options or SearchOptions()
    terms = query_terms(query, options.max_terms)
    hits = view.where(matches(terms))
    for condition in options.filters:
        hits = hits.where(condition)
    hits = hits.withColumn("score", relevance(terms))
    first = Window.partitionBy("document_id", "section_path").orderBy("id")
    hits = hits.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1).drop("rn")
    hits = _one_per_section(hits, [F.desc("score"), F.asc("document_id"), F.asc("id")], options.dedup)
    return hits.where(F.col("score") >= options.min_score).orderBy(F.desc("score"), "document_id", "id").limit(options.limit)


def candidates(segments: DataFrame, documents: DataFrame, query: str, max_terms: int = 3) -> DataFrame:
    """The segments that hold a term in content or section title, or whose document has one in its title.

    The terms are looked for before segments and documents are joined, so only hits
    take part in the join; of the documents only the ids of title hits meet the
    segments, by broadcast while they are few.
    """
    terms = query_terms(query, max_terms)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    own, titled = F.lit(False), F.lit(False)
    for term in terms:
        own = own | F.contains(low("content"), F.lit(term)) | F.contains(low("section_title"), F.lit(term))
        titled = titled | F.contains(low("title"), F.lit(term))
    named = documents.where(titled).select(F.col("doc_id").alias("document_id")).distinct().withColumn("_titled", F.lit(True))
    if named.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS:
        named = F.broadcast(named)
    return segments.join(named, "document_id", "left").where(own | F.coalesce("_titled", F.lit(False))).drop("_titled")


def find(segments: DataFrame, documents: DataFrame, query: str, options: SearchOptions | None = None, libraries: DataFrame | None = None) -> DataFrame:
    """``text_search`` over tables of any size."""
    options = options or SearchOptions()
    return text_search(segment_view(candidates(segments, documents, query, options.max_terms), documents, libraries), query, options)


def filter_only(view: DataFrame, options: SearchOptions) -> DataFrame:
    """Segments that pass the filters, one per section, smallest id first."""
    hits = view
    for condition in options.filters:
        hits = hits.where(condition)
    return _one_per_section(hits, [F.asc("id")], options.dedup).orderBy("id").limit(options.limit)


def contextual_first(hits: DataFrame, context: DataFrame, limit: int) -> DataFrame:
    """Hits with a contextual score before those without; the better of both scores counts.

    ``hits`` has (id, score), ``context`` (id, context_score).
    """
    both = hits.join(context, "id", "left")
    return (
        both.withColumn("is_contextual", F.col("context_score").isNotNull())
        .withColumn("score", F.coalesce("context_score", "score"))
        .drop("context_score")
        .orderBy(F.desc("is_contextual"), F.desc("score"), "id")
        .limit(limit)
    )
