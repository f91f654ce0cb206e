"""Neighbours in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.session import cut


def neighbours(rows: DataFrame, group: Column, order: list[Column], value: Column) -> DataFrame:
    """(group, value, prev, next): each row's value with those before and after it in its group; the order must be total and without nulls.

    Rows are range-partitioned by group and order, so a group of any size is spread
    over many tasks; neighbours are taken inside a partition, and only the first and
    last row of each partition, as many as there are partitions, meet in one place.
    """
    keyed = rows.select(group.alias("group"), F.struct(group.alias("g"), *[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("at"), value.alias("value"))
    placed = cut(keyed.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "ranges")
    edges = placed.groupBy("part").agg(F.min(F.struct("at", "group", "value")).alias("first"), F.max(F.struct("at", "group", "value")).alias("last"))
    along = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    inside = Window.partitionBy("part").orderBy("at")
    one = placed.select(
        "part", "group", "value", F.lag("group").over(inside).alias("pg"), F.lag("value").over(inside).alias("pv"), F.lead("group").over(inside).alias("ng"), F.lead("value").over(inside).alias("nv"),
        F.row_number().over(inside).alias("rn"),
    ).join(F.broadcast(edges), "part")
    prev = F.when(F.col("rn") == 1, F.when(F.col("before.group").eqNullSafe(F.col("group")), F.col("before.value"))).when(F.col("pg").eqNullSafe(F.col("group")), F.col("pv"))
    # the last row of a partition has no next one there
    after = F.when(F.col("nv").isNotNull(), F.when(F.col("ng").eqNullSafe(F.col("group")), F.col("nv"))).when(F.col("after.group").eqNullSafe(F.col("group")), F.col("after.value"))
    return one.select("group", "value", prev.alias("prev"), after.alias("next"))
