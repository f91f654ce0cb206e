"""Point lookups and ordered scans by key; each is a filter that reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document(documents: DataFrame, doc_id: int) -> DataFrame:
    return documents.where(F.col("doc_id") == doc_id)


def document_by_url(documents: DataFrame, url: str) -> DataFrame:
    """The first document of a URL, of any version."""
    return documents.where(F.col("url") == url).orderBy("doc_id").limit(1)


def document_exists(documents: DataFrame, libraries: DataFrame, key: str) -> bool:
    """Whether ``id`` or ``library:version`` names a document."""
    name, colon, version = key.partition(":")
    if colon:
        known = libraries.where((F.col("name") == name) & (F.col("version") == version)).select(F.col("id").alias("library_id"))
        return documents.join(known, "library_id", "left_semi").limit(1).count() > 0
    return key.isdigit() and document(documents, int(key)).limit(1).count() > 0


def segment(segments: DataFrame, segment_id: int) -> DataFrame:
    return segments.where(F.col("id") == segment_id).dropDuplicates(["id"])


def segments_of(segments: DataFrame, doc_id: int) -> DataFrame:
    return segments.where(F.col("document_id") == doc_id).dropDuplicates(["id"]).orderBy("position", "id")


def sections_of(segments: DataFrame, doc_id: int, order: str = "lexical") -> DataFrame:
    """Titled segments of a document by path, ``lexical`` or ``numeric``."""
    from folioforge.operators.sections import path_key

    key = F.col("section_path") if order == "lexical" else path_key(F.col("section_path"))
    return segments.where((F.col("document_id") == doc_id) & F.col("section_title").isNotNull()).dropDuplicates(["id"]).orderBy(key, "id")


def library_documents(documents: DataFrame, library_id: int) -> DataFrame:
    return documents.where(F.col("library_id") == library_id).orderBy("doc_id")


def library(libraries: DataFrame, name: str, version: str) -> DataFrame:
    return libraries.where((F.col("name") == name) & (F.col("version") == version))


def sources(table: DataFrame, active_only: bool = True) -> DataFrame:
    return (table.where("is_active") if active_only else table).orderBy("name")


def by_name(table: DataFrame, name: str, column: str = "name") -> DataFrame:
    return table.where(F.lower(F.trim(column)) == name.strip().lower())


def references_from(resolved: DataFrame, segments: DataFrame, documents: DataFrame, segment_id: int) -> DataFrame:
    """References of a segment with the titles of what they name."""
    target = segments.select(F.col("id").alias("target_segment_id"), F.col("section_title").alias("target_section")).distinct()
    home = documents.select(F.col("doc_id").alias("target_document_id"), F.col("title").alias("target_title"), F.col("url").alias("target_url"))
    return resolved.where(F.col("segment_id") == segment_id).join(target, "target_segment_id", "left").join(home, "target_document_id", "left")


def references_to(resolved: DataFrame, segments: DataFrame, documents: DataFrame, segment_id: int) -> DataFrame:
    """References that name a segment, with the titles of where they stand."""
    source = segments.select(F.col("id").alias("segment_id"), F.col("section_title").alias("source_section")).distinct()
    home = documents.select(F.col("doc_id").alias("document_id"), F.col("title").alias("source_title"), F.col("url").alias("source_url"))
    return resolved.where(F.col("target_segment_id") == segment_id).join(source, "segment_id").join(home, "document_id")


def similar_by_metadata(vectors: DataFrame, query: list[float], own_id: int, k: int, role: str | None = None) -> DataFrame:
    """The k nearest other segments by their metadata vectors (id, embedding, metadata as JSON), of one role if given."""
    from folioforge.operators.vector import knn

    other = vectors.where(F.col("id") != own_id)
    if role is not None:
        other = other.where(F.get_json_object("metadata", "$.semantic_role") == role)
    return knn(other, query, k, "l2")
