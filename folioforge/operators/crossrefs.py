"""Cross references: resolution against anchors, links in both directions, the reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(references: DataFrame, anchors: DataFrame) -> DataFrame:
    """The best anchor of each reference: same document first, then the greatest segment id.

    ``references`` has (document_id, segment_id, reference_type, reference_text);
    an anchor fits by name and type, a link by name alone.  References are joined
    by distinct name, and each name keeps its best anchor per document and
    overall before the join, so a name that is called everywhere stays one row.
    """
    wanted = references.select("document_id", "segment_id", "reference_type", "reference_text").distinct()
    kinds = anchors.select("anchor_name", "anchor_type", "document_id", "segment_id")
    kinds = kinds.unionByName(kinds.withColumn("anchor_type", F.lit("link")))
    local = kinds.groupBy("anchor_name", "anchor_type", "document_id").agg(F.max("segment_id").alias("local_id"))
    best = Window.partitionBy("anchor_name", "anchor_type").orderBy(F.desc("segment_id"), F.desc("document_id"))
    overall = kinds.withColumn("rn", F.row_number().over(best)).where(F.col("rn") == 1).select("anchor_name", "anchor_type", F.col("segment_id").alias("far_id"), F.col("document_id").alias("far_document"))
    name = [F.col("reference_text") == F.col("anchor_name"), F.col("reference_type") == F.col("anchor_type")]
    near = wanted.join(local.withColumnRenamed("document_id", "home"), [*name, F.col("document_id") == F.col("home")], "left").drop("anchor_name", "anchor_type", "home")
    both = near.join(overall, name, "left")
    return both.where(F.col("far_id").isNotNull()).select(
        "document_id", "segment_id", "reference_type", "reference_text", F.coalesce("local_id", "far_id").alias("target_segment_id"), F.when(F.col("local_id").isNotNull(), F.col("document_id")).otherwise(F.col("far_document")).alias("target_document_id")
    )


def graph(resolved: DataFrame) -> DataFrame:
    """(source_segment_id, target_segment_id, references): edges between segments, without loops."""
    return resolved.where(F.col("segment_id") != F.col("target_segment_id")).groupBy(F.col("segment_id").alias("source_segment_id"), "target_segment_id").agg(F.count(F.lit(1)).alias("references"))


def degrees(edges: DataFrame) -> DataFrame:
    """(segment_id, outgoing, incoming) of every segment in the graph."""
    out = edges.groupBy(F.col("source_segment_id").alias("segment_id")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = edges.groupBy(F.col("target_segment_id").alias("segment_id")).agg(F.count(F.lit(1)).alias("incoming"))
    return out.join(into, "segment_id", "full").select("segment_id", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))
