"""Dropping exact copies of rows without moving their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.session import cut

#: Repeated keys up to this number (16 bytes each) are broadcast.
BROADCAST_KEYS = 500_000


def once(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with one row of each (``key``, ``text``).

    Only keys and hashes of the texts are shuffled to find what is repeated; the
    texts of repeated rows alone move.  ``df`` has no other columns.
    """
    named = df.withColumn("_h", F.xxhash64(text))
    again = cut(named.groupBy(key, "_h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col(key).alias("_k"), F.col("_h").alias("_g")), "copies")
    if again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        again = F.broadcast(again)
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g"))
    return named.join(again, same, "left_anti").drop("_h").unionByName(named.join(again, same, "left_semi").drop("_h").dropDuplicates([key, text]))
