"""Section trees by dotted path: contents, neighbours, ancestors, subtrees, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import adjacent


def path_key(path: Column) -> Column:
    """Array of numbers for numeric order (1.2 before 1.10); parts that are no numbers sort first."""
    return F.transform(F.split(F.coalesce(path, F.lit("")), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))


def parent_path(path: Column) -> Column:
    """Path without its last part; null at the top."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", ""))


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def titled(segments: DataFrame) -> DataFrame:
    """(id, document_id, section_title, section_path, section_level, position, content) of segments with a title and a path, each id once.

    Only the columns that a plan goes on to use take part in the shuffle.
    """
    found = segments.where(F.col("section_title").isNotNull() & (F.col("section_path") != ""))
    return found.select("id", "document_id", "section_title", "section_path", "section_level", "position", "content").dropDuplicates(["id"])


def toc(sections: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Sections with their parent's id (nearest path prefix in the document) and number of children."""
    one = sections.withColumn("rn", F.row_number().over(Window.partitionBy("document_id", "section_path").orderBy("id"))).where(F.col("rn") == 1).drop("rn")
    up = one.select(F.col("document_id"), F.col("section_path").alias("up_path"), F.col("id").alias("parent_id"))
    linked = one.withColumn("up_path", parent_path(F.col("section_path"))).join(up, ["document_id", "up_path"], "left")
    children = linked.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    out = linked.join(children, "id", "left").select("document_id", "id", "section_title", "section_path", depth(F.col("section_path")).alias("depth"), "parent_id", F.coalesce("children", F.lit(0)).alias("children"))
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def ancestors(sections: DataFrame) -> DataFrame:
    """(document_id, id, ancestor_id, distance): every section that a path prefix names."""
    parts = F.split("section_path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("p"), (F.size(parts) - n).alias("d")))
    exploded = sections.where(F.size(parts) > 1).select("document_id", "id", F.explode(prefixes).alias("up"))
    named = sections.select("document_id", F.col("section_path").alias("p"), F.col("id").alias("ancestor_id"))
    return exploded.select("document_id", "id", F.col("up.p").alias("p"), F.col("up.d").alias("distance")).join(named, ["document_id", "p"]).select("document_id", "id", "ancestor_id", "distance")


def subtree(sections: DataFrame, document_id: int, path: str) -> DataFrame:
    """A section and all below it."""
    return sections.where((F.col("document_id") == document_id) & ((F.col("section_path") == path) | F.col("section_path").startswith(path + ".")))


def siblings(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """(document_id, id, sibling_id) of the sections in ``asked``: those with the same parent path."""
    keyed = lambda df: df.withColumn("up", F.coalesce(parent_path(F.col("section_path")), F.lit("")))
    other = keyed(sections).select("document_id", "up", F.col("id").alias("sibling_id"))
    return keyed(asked).join(other, ["document_id", "up"]).where(F.col("id") != F.col("sibling_id")).select("document_id", "id", "sibling_id")


def sibling_groups(sections: DataFrame) -> DataFrame:
    """(document_id, parent_path, id, siblings): every section with its group and the number of others in it; a group isn't expanded into pairs."""
    keyed = sections.select("document_id", F.coalesce(parent_path(F.col("section_path")), F.lit("")).alias("parent_path"), "id")
    sizes = keyed.groupBy("document_id", "parent_path").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    return keyed.join(sizes, ["document_id", "parent_path"])


def neighbours(sections: DataFrame) -> DataFrame:
    """(document_id, id, prev_id, next_id) in numeric path order."""
    near = adjacent.neighbours(sections, F.col("document_id"), [path_key(F.col("section_path")), F.col("id")], F.col("id"))
    return near.select(F.col("group").alias("document_id"), F.col("value").alias("id"), F.col("prev").alias("prev_id"), F.col("next").alias("next_id"))


def roll_up(hits: DataFrame) -> DataFrame:
    """Hits (document_id, section_path, section_title, section_level, id, score) per section."""
    return hits.groupBy("document_id", "section_path").agg(
        F.count(F.lit(1)).alias("match_count"),
        F.sum("score").alias("total_score"),
        F.avg("score").alias("avg_score"),
        F.min_by("section_title", "id").alias("section_title"),
        F.min_by("section_level", "id").alias("section_level"),
    )


def find_by_title(sections: DataFrame, pattern: str) -> DataFrame:
    return sections.where(F.contains(F.lower("section_title"), F.lit(pattern.lower()))).orderBy("document_id", path_key(F.col("section_path")), "id")


def search(sections: DataFrame, query: str, kind: str = "all", limit: int = 20) -> DataFrame:
    """Sections that match in all, code, headings, examples or content; title matches first, then path."""
    needle = F.lit(query.lower())
    title, content = F.contains(F.lower("section_title"), needle), F.contains(F.lower("content"), needle)
    code = F.contains(F.col("content"), F.lit("```"))
    kinds = {
        "all": title | content,
        "code": content & (code | F.contains(F.lower("content"), F.lit("def ")) | F.contains(F.lower("content"), F.lit("function "))),
        "headings": title,
        "examples": content & (F.contains(F.lower("section_title"), F.lit("example")) | F.contains(F.lower("content"), F.lit("example"))),
        "content": content,
    }
    return sections.where(kinds[kind]).withColumn("title_first", F.when(title, 0).otherwise(1)).orderBy("title_first", "section_path", "id").limit(limit)
