"""Changes as new DataFrames: upserts, deletes with their children, positions, embeddings.

Parquet has no MERGE, so a change is an anti-join and a union; ``plans.session.cut``
or an ordinary write stores the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those with the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def keep_latest(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return table.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") == 1).drop("rn")


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """All tables without the rows of the documents in ``gone`` (document_id); ``keys`` names each table's column."""
    return {name: df.join(gone.select(F.col("document_id").alias(keys[name])), keys[name], "left_anti") if name in keys else df for name, df in tables.items()}


def with_segment_defaults(segments: DataFrame) -> DataFrame:
    """Missing titles, paths and levels filled: a heading's own text or ``Introduction``, the position, 1."""
    heading = F.lower(F.coalesce("segment_type", F.lit(""))).rlike("^h[1-6]$")
    return segments.withColumns(
        {
            "section_title": F.coalesce("section_title", F.when(heading, F.col("content")).otherwise("Introduction")),
            "section_path": F.coalesce("section_path", F.col("position").cast("string")),
            "section_level": F.coalesce(F.col("section_level").cast("string").try_cast("int"), F.lit(1)),
        }
    )


def append_members(members: DataFrame, added: DataFrame) -> DataFrame:
    """Collection members with new documents at the end of their collections; those already there stay."""
    new = added.select("collection", "document_id").distinct().join(members, ["collection", "document_id"], "left_anti")
    last = members.groupBy("collection").agg(F.max("position").alias("last"))
    order = Window.partitionBy("collection").orderBy("document_id")
    placed = new.join(last, "collection", "left").select("collection", "document_id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(order)).cast("int").alias("position"))
    return members.unionByName(placed, allowMissingColumns=True)


def reorder(members: DataFrame, positions: DataFrame) -> DataFrame:
    """Members with the positions of (collection, document_id, new_position); others keep theirs."""
    return members.join(positions, ["collection", "document_id"], "left").withColumn("position", F.coalesce("new_position", "position")).drop("new_position")


def set_vectors(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Segments with the vectors of (id, new_embedding)."""
    return segments.join(vectors, "id", "left").withColumn("embedding", F.coalesce("new_embedding", "embedding")).drop("new_embedding")


def missing_segments(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidates (document_id, content) that aren't stored yet."""
    return candidates.join(segments.select("document_id", "content"), ["document_id", "content"], "left_anti")
