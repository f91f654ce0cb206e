"""Compositions over several operators: search with fallbacks, suggestions from all sources, results by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.extract import identifiers
from folioforge.operators import search, suggest, vector

SUGGESTION_COLUMNS = ("identifier", "kind", "document_id", "segment_id", "text", "score")


# ---- search


def vector_hits(view: DataFrame, vectors: DataFrame, query: list[float], limit: int, min_score: float = 0.0, filters: tuple[Column, ...] = ()) -> DataFrame:
    """Nearest segments by (1 + cosine) / 2, one for each section path, from ten times as many candidates; segments without a path are left out."""
    near = vector.knn(vectors, query, limit * 10).select("id", ((1 + F.col("score")) / 2).alias("score"))
    hits = view.where(F.col("section_path").isNotNull()).join(F.broadcast(near), "id")
    for condition in filters:
        hits = hits.where(condition)
    order = Window.partitionBy("section_path").orderBy(F.desc("score"), "document_id", "id")
    one = hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == 1).drop("rn")
    return one.where(F.col("score") >= min_score).orderBy(F.desc("score"), "document_id", "id").limit(limit)


def first_source(*sources: tuple[str, DataFrame]) -> DataFrame:
    """The rows of the first source that has any, with its name in ``source``; each has a bounded number of rows."""
    out = None
    for place, (name, rows) in enumerate(sources):
        part = rows.withColumn("source", F.lit(name)).withColumn("_place", F.lit(place))
        out = part if out is None else out.unionByName(part)
    best = out.agg(F.min("_place").alias("_best"))
    return out.join(F.broadcast(best), F.col("_place") == F.col("_best")).drop("_place", "_best")


def search_segments(view: DataFrame, query: str | None, options: search.SearchOptions, vectors: DataFrame | None = None, embedding: list[float] | None = None) -> DataFrame:
    """(id, document_id, section_path, score, source): vector hits, else text hits, else what the filters alone leave."""
    columns = ("id", "document_id", "section_path", "score")
    sources = []
    if vectors is not None and embedding is not None:
        sources.append(("vector", vector_hits(view, vectors, embedding, options.limit, options.min_score, options.filters).select(*columns)))
    if query:
        sources.append(("text", search.text_search(view, query, options).select(*columns)))
    listing = search.filter_only(view, options).withColumn("score", F.lit(0.0)).select(*columns)
    sources.append(("listing", listing))
    return first_source(*sources)


def by_document(hits: DataFrame) -> DataFrame:
    """One row for each document of (id, document_id, title, section_path, score): its sections, each with its hits, best document first.

    Hits are what a search returned, so a group is bounded by its limit.
    """
    path = F.coalesce("section_path", F.lit("0"))
    sections = hits.groupBy("document_id", path.alias("section_path")).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("score").alias("best"), F.first("title", ignorenulls=True).alias("title"))
    grouped = sections.groupBy("document_id").agg(
        F.coalesce(F.max("title"), F.lit("Untitled")).alias("title"), F.sort_array(F.collect_list(F.struct("section_path", "ids"))).alias("sections"), F.sum(F.size("ids")).alias("hits"), F.max("best").alias("score")
    )
    return grouped.orderBy(F.desc("score"), "document_id")


def in_both(asked: DataFrame, members: DataFrame) -> DataFrame:
    """Documents that are asked for and belong to a collection."""
    return asked.select("document_id").intersect(members.select("document_id"))


# ---- suggestions


def category_suggestions(segments: DataFrame, documents: DataFrame, category: str, query: str, limit: int = 10) -> DataFrame:
    """Identifiers of the segments that match most of the query's words and the category's first two, three of each segment."""
    words = query.lower().split()
    language = suggest.language_of(query)
    terms = [*words, *([language] if language else []), *suggest.TASK_WORDS[category][:2]][:5]
    titled = segments.join(documents.select(F.col("doc_id").alias("document_id"), "title"), "document_id")
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("content", "section_title", "title")]
    matches = F.lit(0)
    for term in terms:
        matches = matches + F.when(low[0].contains(term) | low[1].contains(term) | low[2].contains(term), 1).otherwise(0)
    best = titled.withColumn("matches", matches).where(F.col("matches") > 0).orderBy(F.desc("matches"), "title", "segment_id").limit(limit)
    named = best.select("document_id", "segment_id", "title", "content", "matches", F.explode(F.slice(identifiers(F.col("content")), 1, 3)).alias("i"))
    base = F.least(F.lit(0.9), 0.4 + F.col("matches") * 0.15)
    asked = F.lit(False)
    for word in words:
        asked = asked | F.lower("i.name").contains(word)
    return named.select(
        F.col("i.name").alias("identifier"), F.col("i.kind").alias("kind"), "document_id", "segment_id", F.concat_ws(" ", F.substring("content", 1, 200), "title").alias("text"),
        F.when(asked, F.least(F.lit(1.0), base + 0.2)).otherwise(base).alias("score"),
    )


def name_suggestions(anchors: DataFrame, segments: DataFrame, query: str) -> DataFrame:
    """Anchors named like the query (0.7 of the similarity) or like its opposite (0.8)."""
    low = query.lower()
    at = anchors.select(F.col("anchor_name").alias("identifier"), F.col("anchor_type").alias("kind"), "document_id", "segment_id").distinct()
    at = at.join(segments.select("segment_id", F.substring("content", 1, 200).alias("text")), "segment_id")
    near = suggest.similar_names(at.select("identifier"), low)
    like = at.join(near, "identifier").where(F.lower("identifier").contains(low))
    opposite = suggest.paired_name(F.lit(low))
    pair = at.where(opposite.isNotNull() & F.contains(F.lower("identifier"), opposite)).withColumn("score", F.lit(0.8))
    return like.select(*SUGGESTION_COLUMNS).unionByName(pair.select(*SUGGESTION_COLUMNS))


def reference_suggestions(resolved: DataFrame, segments: DataFrame, query: str) -> DataFrame:
    """What segments that mention the query refer to (0.8)."""
    targets = suggest.linked(resolved, segments, query).select(F.col("target_segment_id").alias("segment_id"), "score")
    named = resolved.select(F.col("target_segment_id").alias("segment_id"), F.col("reference_text").alias("identifier"), F.col("reference_type").alias("kind")).distinct()
    return targets.join(named, "segment_id").join(segments.select("segment_id", "document_id", F.substring("content", 1, 200).alias("text")), "segment_id").select(*SUGGESTION_COLUMNS)


def suggestions(segments: DataFrame, documents: DataFrame, anchors: DataFrame, resolved: DataFrame, query: str, limit: int = 10, semantic: DataFrame | None = None) -> DataFrame:
    """(identifier, kind, document_id, score): all sources together, weighed by the query's language, the best of each, best first.

    ``segments`` has (document_id, segment_id, section_title, content), each id once;
    ``semantic`` brings further suggestions, as from a vector search.
    """
    parts = [name_suggestions(anchors, segments, query), reference_suggestions(resolved, segments, query)]
    parts += [category_suggestions(segments, documents, category, query) for category in suggest.task_categories(query)]
    if semantic is not None:
        parts.append(semantic.limit(limit // 2).select(*SUGGESTION_COLUMNS))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return suggest.best_of(suggest.by_language(every, suggest.language_of(query)), limit)


# ---- references


def find_definitions(anchors: DataFrame, documents: DataFrame, segments: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Where a name is defined: (document_id, title, segment_id, section_title, kind, signature)."""
    named = anchors.where(F.col("anchor_name") == name)
    if kind is not None:
        named = named.where(F.col("anchor_type") == kind)
    titles = documents.select(F.col("doc_id").alias("document_id"), "title")
    places = segments.select("segment_id", "section_title")
    return named.join(titles, "document_id").join(places, "segment_id").select("document_id", "title", "segment_id", "section_title", F.col("anchor_type").alias("kind"), F.coalesce("anchor_signature", "anchor_name").alias("signature"))


def find_references(references: DataFrame, documents: DataFrame, segments: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Where a name is referred to: (document_id, title, segment_id, section_title, kind)."""
    named = references.where(F.col("reference_text") == name)
    if kind is not None:
        named = named.where(F.col("reference_type") == kind)
    titles = documents.select(F.col("doc_id").alias("document_id"), "title")
    places = segments.select("segment_id", "document_id", "section_title")
    return named.select("segment_id", F.col("reference_type").alias("kind")).join(places, "segment_id").join(titles, "document_id").select("document_id", "title", "segment_id", "section_title", "kind")
