"""Relational operators of the store: lookups, filters, tags, collections, libraries, statistics, caching, updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import freshness

# Columns that may be sorted or filtered by name.
ALLOWED_COLUMNS = frozenset(
    "id doc_id url version title html_path markdown_path content_hash scraped_at updated_at library_id is_library_doc lang source n_chars name doc_url is_available last_checked".split()
)


def require_column(name: str) -> str:
    if name not in ALLOWED_COLUMNS:
        raise ValueError(f"unknown column {name!r}")
    return name


class FilterSet:
    """Conditions that all must hold; an empty set holds everywhere."""

    operators = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}

    def __init__(self) -> None:
        self.conditions: list[Column] = []

    def where(self, column: str, operator: str, value) -> FilterSet:
        self.conditions.append(getattr(F.col(require_column(column)), self.operators[operator])(F.lit(value)))
        return self

    def among(self, column: str, values: list) -> FilterSet:
        """No values: no condition."""
        if values:
            self.conditions.append(F.col(require_column(column)).isin(values))
        return self

    def like(self, column: str, part: str) -> FilterSet:
        self.conditions.append(F.contains(F.lower(require_column(column)), F.lit(part.lower())))
        return self

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, self.conditions, F.lit(True))


def document_filter(documents: DataFrame, libraries: DataFrame | None = None, members: DataFrame | None = None, **keys) -> DataFrame:
    """Documents by version, is_library_doc, title_contains, updated_after, document_ids, library_name or collection."""
    found = FilterSet()
    if keys.get("version") is not None:
        found.where("version", "=", keys["version"])
    if keys.get("is_library_doc") is not None:
        found.where("is_library_doc", "=", keys["is_library_doc"])
    if keys.get("title_contains"):
        found.like("title", keys["title_contains"])
    if keys.get("updated_after") is not None:
        found.conditions.append(F.col("updated_at") >= F.lit(keys["updated_after"]).cast("timestamp"))
    found.among("doc_id", keys.get("document_ids") or ([keys["document_id"]] if keys.get("document_id") else []))
    out = documents.where(found.column())
    if keys.get("library_name") and libraries is not None:
        named = libraries.where(F.col("name") == keys["library_name"]).select(F.col("id").alias("library_id"))
        out = out.join(named, "library_id", "left_semi")
    if keys.get("collection") is not None and members is not None:
        out = out.join(members.where(F.col("collection") == keys["collection"]).select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
    return out


def page(documents: DataFrame, limit: int, offset: int = 0, text: str | None = None) -> DataFrame:
    """A page of the listing, newest first; ``text`` in title or URL."""
    if text:
        low = F.lit(text.lower())
        documents = documents.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), low) | F.contains(F.lower("url"), low))
    return documents.orderBy(F.desc_nulls_last("scraped_at"), "doc_id").offset(offset).limit(limit)


# tags and collections


def document_tags(documents: DataFrame) -> DataFrame:
    """(document_id, tag): language, host and library kind of each document as tags, lower-cased and trimmed."""
    kinds = F.array(F.col("lang"), F.col("source"), F.when(F.col("is_library_doc"), "library"))
    return documents.select(F.col("doc_id").alias("document_id"), F.explode(kinds).alias("tag")).select("document_id", F.lower(F.trim("tag")).alias("tag")).where(F.col("tag") != "").distinct()


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("document_id").alias("documents"))


def documents_with_any(tags: DataFrame, names: list[str]) -> DataFrame:
    wanted = [n.strip().lower() for n in names]
    return tags.where(F.col("tag").isin(wanted)).select("document_id").distinct()


def documents_with_all(documents: DataFrame, tags: DataFrame, names: list[str], strict: bool = False) -> DataFrame:
    """Relational division; names that no document has are ignored unless ``strict``."""
    wanted = tags.where(F.col("tag").isin([n.strip().lower() for n in names]))
    known = wanted.select("tag").distinct()
    need = known.agg(F.count(F.lit(1)).alias("need")) if not strict else known.agg(F.lit(len({n.strip().lower() for n in names})).cast("long").alias("need"))
    have = wanted.groupBy("document_id").agg(F.count_distinct("tag").alias("have"))
    base = documents.select(F.col("doc_id").alias("document_id")).join(have, "document_id", "left")
    return base.join(F.broadcast(need)).where(F.coalesce("have", F.lit(0)) >= F.col("need")).select("document_id")


def collection_members(documents: DataFrame, libraries: DataFrame) -> DataFrame:
    """(collection, document_id, position, added_at): each library's documents as a collection, in order of scraping."""
    named = documents.join(libraries.select(F.col("id").alias("library_id"), F.col("name").alias("collection")), "library_id")
    order = Window.partitionBy("collection").orderBy(F.asc_nulls_last("scraped_at"), "doc_id")
    return named.select("collection", F.col("doc_id").alias("document_id"), (F.row_number().over(order) - 1).alias("position"), F.col("scraped_at").alias("added_at"))


def collection_counts(members: DataFrame, libraries: DataFrame) -> DataFrame:
    names = libraries.select(F.col("name").alias("collection")).distinct()
    return names.join(members, "collection", "left").groupBy("collection").agg(F.count("document_id").alias("documents"))


def next_position(members: DataFrame) -> DataFrame:
    return members.groupBy("collection").agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("next_position"))


# libraries


def version_class(version: Column) -> Column:
    """0 stable, 1 three numbers, 2 two numbers, 3 other."""
    return F.when(version == "stable", 0).when(version.rlike(r"^[0-9].*\.[0-9].*\.[0-9]"), 1).when(version.rlike(r"^[0-9].*\.[0-9]"), 2).otherwise(3)


def latest_versions(libraries: DataFrame) -> DataFrame:
    """Of each library the version that counts as latest: class, then the string downwards, then the last check."""
    order = Window.partitionBy("name").orderBy(version_class(F.col("version")), F.desc("version"), F.desc_nulls_last("last_checked"), "id")
    usable = libraries.where((F.col("version") != "latest") & F.coalesce("is_available", F.lit(True)))
    return usable.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == 1).drop("rn")


def find_library(libraries: DataFrame, name: str, version: str | None = None) -> DataFrame:
    out = libraries.where(F.lower("name") == name.lower())
    if version is not None:
        out = out.where(F.col("version") == version)
    return out.orderBy(F.desc("version"), "id").limit(1)


def search_libraries(libraries: DataFrame, text: str, limit: int = 20) -> DataFrame:
    low = F.lit(text.lower())
    hit = F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("doc_url", F.lit(""))), low)
    return libraries.where(hit & F.coalesce("is_available", F.lit(False))).orderBy("name", F.desc("version"), "id").limit(limit)


# statistics and caching


def store_counts(**tables: DataFrame) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def segments_per_document(documents: DataFrame, segments: DataFrame, limit: int = 20) -> DataFrame:
    counts = segments.select("id", "document_id").distinct().groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("segments"))
    return documents.select("doc_id", "title").join(counts, "doc_id", "left").select("doc_id", "title", F.coalesce("segments", F.lit(0)).alias("segments")).orderBy(F.desc("segments"), "doc_id").limit(limit)


def coverage(segments: DataFrame) -> DataFrame:
    """Share of segments with a vector, in one pass."""
    one = segments.groupBy("id").agg(F.max(F.when(F.size("embedding") > 0, 1).otherwise(0)).alias("has"), F.min("document_id").alias("document_id"))
    return one.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("has").alias("with_vector"),
        F.count_distinct(F.when(F.col("has") == 1, F.col("document_id"))).alias("documents"),
        F.round(F.when(F.count(F.lit(1)) > 0, F.sum("has") * 100.0 / F.count(F.lit(1))).otherwise(0.0), 2).alias("percent"),
    )


def cache_statistics(libraries: DataFrame, as_of: Column) -> DataFrame:
    status = freshness.cache_status(F.col("last_checked"), as_of)
    return libraries.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("libraries"), F.round(F.avg(freshness.age_seconds(F.col("last_checked"), as_of) / freshness.DAY), 1).alias("avg_age_days"))


def stale_documents(documents: DataFrame, as_of: Column, limit: int, statuses: tuple[str, ...] = ("stale", "outdated")) -> DataFrame:
    status = freshness.cache_status(F.col("scraped_at"), as_of, F.coalesce(F.col("is_library_doc"), F.lit(False)))
    return documents.withColumn("status", status).where(F.col("status").isin(list(statuses))).orderBy(F.asc_nulls_first("scraped_at"), "doc_id").limit(limit)


def version_history(documents: DataFrame) -> DataFrame:
    """Versions of each page (URL without its version), newest first, with the latest marked."""
    page_of = F.regexp_replace(F.lower("url"), r"/v?\d+(\.\d+)*(?=/|$)|/(stable|latest)(?=/|$)", "")
    order = Window.partitionBy("page").orderBy(F.desc_nulls_last("scraped_at"), F.desc("doc_id"))
    return documents.withColumn("page", page_of).select("page", "doc_id", "version", "scraped_at", (F.row_number().over(order) == 1).alias("is_latest"))


# updates and caching


def check_due(last_checked: Column, as_of: Column, days: Column | int = 7) -> Column:
    """Whether a document has to be checked again: never checked, or not within its number of days."""
    days = F.lit(days) if isinstance(days, int) else F.coalesce(days, F.lit(7))
    return F.coalesce(freshness.age_seconds(last_checked, as_of) >= days * freshness.DAY, F.lit(True))


def pending_updates(documents: DataFrame, checks: DataFrame) -> DataFrame:
    """Documents with an update waiting, last checked first; ``checks`` has (document_id, needs_update, latest_available_version, last_checked)."""
    wanted = documents.where(F.coalesce("check_for_updates", F.lit(False)))
    waiting = checks.where(F.coalesce("needs_update", F.lit(False))).select(F.col("document_id").alias("doc_id"), "latest_available_version", "last_checked")
    return wanted.join(waiting, "doc_id").orderBy(F.desc_nulls_last("last_checked"), "doc_id")


def mark_checked(documents: DataFrame, ids: Column, as_of: Column) -> DataFrame:
    """Sets ``last_checked`` of the rows that ``ids`` names, and their status by age."""
    checked = F.when(ids, as_of).otherwise(F.col("last_checked"))
    return documents.withColumn("last_checked", checked).withColumn("staleness_status", freshness.cache_status(F.col("last_checked"), as_of, F.coalesce("is_pinned", F.lit(False))))


def mark_updated(documents: DataFrame, ids: Column, as_of: Column) -> DataFrame:
    """The named rows were fetched anew: scraped and checked now, fresh."""
    for column in ("scraped_at", "last_checked"):
        documents = documents.withColumn(column, F.when(ids, as_of).otherwise(F.col(column)))
    return documents.withColumn("staleness_status", F.when(ids, F.lit("fresh")).otherwise(F.col("staleness_status")))


def pin(documents: DataFrame, ids: Column, pinned: bool = True) -> DataFrame:
    """Pins rows, which keeps them fresh, or lets them go."""
    documents = documents.withColumn("is_pinned", F.when(ids, F.lit(pinned)).otherwise(F.col("is_pinned")))
    return documents.withColumn("staleness_status", F.when(F.coalesce("is_pinned", F.lit(False)), F.lit("fresh")).otherwise(F.col("staleness_status")))


def update_staleness(documents: DataFrame, as_of: Column) -> DataFrame:
    """``staleness_status`` of every row by its last check."""
    return documents.withColumn("staleness_status", freshness.cache_status(F.col("last_checked"), as_of, F.coalesce("is_pinned", F.lit(False))))


def vector_cache(entries: DataFrame, as_of: Column, keep_seconds: int) -> DataFrame:
    """Entries, valid and expired ones, and bytes of a cache of (created_at, vector) with four bytes a value."""
    valid = F.coalesce(freshness.age_seconds(F.col("created_at"), as_of) < keep_seconds, F.lit(False))
    size = F.when(F.col("vector").isNotNull(), F.size("vector")).otherwise(0) * 4
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("expired"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"))


def without_context(documents: DataFrame, segments: DataFrame, context: Column) -> DataFrame:
    """Documents with a segment that has no context, or without segments; ``context`` reads a segment."""
    lacking = segments.select(F.col("document_id").alias("doc_id"), context.isNull().alias("lacks")).groupBy("doc_id").agg(F.max("lacks").alias("lacks"))
    return documents.select("doc_id", "title").join(lacking, "doc_id", "left").where(F.coalesce("lacks", F.lit(True))).select("doc_id", "title").distinct().orderBy("doc_id")


def context_models(segments: DataFrame, context: Column, model: Column) -> DataFrame:
    """(model, documents, segments): where the contexts come from, and all of them together (model null)."""
    have = segments.where(context.isNotNull()).select("id", "document_id", model.alias("model"))
    one = have.groupBy("model").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("id").alias("segments"))
    every = have.agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("id").alias("segments"), F.count_distinct("model").alias("models"))
    return one.where(F.col("model").isNotNull()).withColumn("models", F.lit(1).cast("long")).unionByName(every.select(F.lit(None).cast("string").alias("model"), "documents", "segments", "models"))


def store_summary(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """Documents, segments, segments a document on average, and the share of segments with a vector."""
    one = segments.groupBy("id").agg(F.max(F.when(F.size("embedding") > 0, 1).otherwise(0)).alias("has"))
    counts = one.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("has"), F.lit(0)).alias("with_vector"))
    docs = documents.agg(F.count_distinct("doc_id").alias("documents"))
    share = lambda a, b, times: F.when(b > 0, F.round(a * times / b, 2)).otherwise(F.lit(0.0))
    both = docs.join(F.broadcast(counts))
    return both.select("documents", "segments", share(F.col("segments"), F.col("documents"), 1.0).alias("per_document"), share(F.col("with_vector"), F.col("segments"), 100.0).alias("coverage_percent"))


def recent_documents(documents: DataFrame, limit: int = 5) -> DataFrame:
    return documents.orderBy(F.desc_nulls_last("scraped_at"), "doc_id").limit(limit)


# llms.txt resources


def search_resources(resources: DataFrame, documents: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Resources (document_id, title, description, url) with the text in title or description, beside their document."""
    low = F.lit(text.lower())
    hit = F.contains(F.lower(F.coalesce("title", F.lit(""))), low) | F.contains(F.lower(F.coalesce("description", F.lit(""))), low)
    parents = documents.select(F.col("doc_id").alias("document_id"), F.col("title").alias("document_title"), F.col("url").alias("document_url"))
    return resources.where(hit).join(parents, "document_id").orderBy("title", "document_id", "url").limit(limit)


def documents_with_resources(documents: DataFrame, metadata: DataFrame, limit: int = 20) -> DataFrame:
    """Documents with an llms.txt and what it says of itself, newest first; ``metadata`` has (document_id, llms_title, llms_summary)."""
    told = metadata.select(F.col("document_id").alias("doc_id"), "llms_title", "llms_summary")
    return documents.join(told, "doc_id").orderBy(F.desc_nulls_last("scraped_at"), "doc_id").limit(limit)


# encoded columns


def tags_to_json(tags: Column) -> Column:
    """A list of tags as JSON text; null stays null."""
    return F.to_json(tags)


def tags_from_json(text: Column) -> Column:
    """The list of tags of JSON text; null, blank and malformed text give the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def text_values(metadata: dict[str, Column]) -> Column:
    """Metadata of any types as a map of texts: texts as they are, other values as JSON where they are nested; nulls are left out."""
    keys, values = [], []
    for key, value in metadata.items():
        keys.append(F.lit(key))
        values.append(value.cast("string"))
    return F.map_filter(F.map_from_arrays(F.array(*keys), F.array(*values)), lambda k, v: v.isNotNull())


class Select:
    """A query on a DataFrame, part by part; conditions must all hold, columns and directions are checked."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.found, self.keys, self.sums, self.sorts, self.shown, self.first = rows, FilterSet(), [], [], [], [], None

    def columns(self, *names: str) -> Select:
        self.shown += [require_column(n) for n in names]
        return self

    def where(self, column: str, operator: str, value) -> Select:
        self.found.where(column, operator, value)
        return self

    def where_in(self, column: str, values: list) -> Select:
        self.found.among(column, values)
        return self

    def join(self, other: DataFrame, on: str, how: str = "inner") -> Select:
        self.rows = self.rows.join(other, on, how)
        return self

    def group_by(self, *names: str, **aggregates: Column) -> Select:
        self.keys += [require_column(n) for n in names]
        self.sums += [c.alias(n) for n, c in aggregates.items()]
        return self

    def order_by(self, column: str, direction: str = "asc") -> Select:
        if direction.lower() not in ("asc", "desc"):
            raise ValueError(f"unknown direction {direction!r}")
        self.sorts.append(F.asc_nulls_first(column) if direction.lower() == "asc" else F.desc_nulls_last(column))
        return self

    def limit(self, n: int) -> Select:
        self.first = n
        return self

    def build(self) -> DataFrame:
        out = self.rows.where(self.found.column())
        if self.keys:
            out = out.groupBy(*self.keys).agg(*(self.sums or [F.count(F.lit(1)).alias("rows")]))
        elif self.shown:
            # sort columns needn't be shown
            out = out.orderBy(*self.sorts) if self.sorts else out
            out = out.select(*self.shown)
            return out if self.first is None else out.limit(self.first)
        out = out.orderBy(*self.sorts) if self.sorts else out
        return out if self.first is None else out.limit(self.first)
