"""Suggestions: co-occurring functions, task categories, similar names, paired names, language context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.extract import called_names
from folioforge.functions.text import charset_similarity

# Words of each language, in the order in which a query is tested, by substring.
LANGUAGE_WORDS = {
    "python": ("python", "py", "pip", "django", "flask", "pandas", "requests", "numpy"),
    "javascript": ("javascript", "js", "node", "npm", "react", "vue", "express", "axios"),
    "typescript": ("typescript", "ts", "node", "npm", "react", "vue", "express"),
    "java": ("java", "maven", "gradle", "spring", "hibernate", "junit"),
    "c#": ("csharp", "dotnet", "nuget", "asp.net", "entity"),
    "rust": ("rust", "cargo", "tokio", "serde", "actix"),
    "go": ("golang", "go", "mod", "gin", "gorilla"),
    "php": ("php", "composer", "laravel", "symfony", "psr"),
    "ruby": ("ruby", "gem", "rails", "sinatra", "rspec"),
}
# Words of each task category.
TASK_WORDS = {
    "data_processing": ("parse", "process", "transform", "filter", "map", "reduce", "convert"),
    "file_operations": ("read", "write", "open", "save", "load", "file", "path"),
    "web_requests": ("request", "http", "get", "post", "api", "client", "fetch", "url", "response"),
    "database": ("query", "select", "insert", "update", "delete", "connection", "cursor"),
    "async_programming": ("async", "await", "coroutine", "future", "thread", "concurrent"),
    "error_handling": ("exception", "error", "try", "catch", "handle", "raise"),
    "testing": ("test", "assert", "mock", "fixture", "unittest", "pytest"),
    "configuration": ("config", "settings", "environment", "parameter", "option"),
}
# Words that name opposite operations; the first one found counts.
PAIRS = (("get", "set"), ("set", "get"), ("open", "close"), ("create", "delete"))


def language_of(query: str) -> str | None:
    low = query.lower()
    return next((language for language, words in LANGUAGE_WORDS.items() if any(w in low for w in words)), None)


def task_categories(task: str) -> list[str]:
    low = task.lower()
    return [category for category, words in TASK_WORDS.items() if any(w in low for w in words)]


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for word in words:
        out = out + F.when(F.contains(text, F.lit(word)), 1).otherwise(0)
    return out


def by_language(suggestions: DataFrame, language: str | None) -> DataFrame:
    """Score of (…, text, score): +0.2 for each word of the language up to 1, else -0.3 down to 0.1 for words of others."""
    if language is None:
        return suggestions
    low = F.lower("text")
    own = _hits(low, LANGUAGE_WORDS[language])
    others = sum((_hits(low, words) for other, words in LANGUAGE_WORDS.items() if other != language), F.lit(0))
    return suggestions.withColumn("score", F.when(own > 0, F.least(F.lit(1.0), F.col("score") + own * 0.2)).when(others > 0, F.greatest(F.lit(0.1), F.col("score") - 0.3)).otherwise(F.col("score")))


def best_of(suggestions: DataFrame, limit: int) -> DataFrame:
    """The best score of each (identifier, kind, document_id), best first."""
    one = suggestions.groupBy("identifier", "kind", "document_id").agg(F.max("score").alias("score"))
    return one.orderBy(F.desc("score"), "identifier", "kind", "document_id").limit(limit)


def co_occurring(segments: DataFrame, name: str) -> DataFrame:
    """(identifier, document_id, segment_id, score): functions called in segments that mention ``name``; more often, better."""
    near = segments.where(F.contains("content", F.lit(name))).select("document_id", "segment_id", F.explode(called_names(F.col("content"))).alias("identifier"))
    near = near.where((F.col("identifier") != name) & (F.length("identifier") > 2))
    times = near.groupBy("identifier").agg(F.count(F.lit(1)).alias("times"))
    return near.distinct().join(times, "identifier").select("identifier", "document_id", "segment_id", F.least(F.lit(1.0), 0.5 + F.col("times") * 0.1).alias("score"))


def category_matches(segments: DataFrame, categories: list[str], limit: int) -> DataFrame:
    """(category, id, match_count): segments by the number of a category's words in content or title."""
    out = None
    for category in categories:
        low = F.lower(F.concat_ws(" ", "content", "section_title"))
        part = segments.select(F.lit(category).alias("category"), "id", _hits(low, TASK_WORDS[category]).alias("match_count")).where(F.col("match_count") > 0)
        out = part if out is None else out.unionByName(part)
    rank = Window.partitionBy("category").orderBy(F.desc("match_count"), "id")
    return out.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= limit).drop("rn")


def similar_names(names: DataFrame, name: str, least: float = 0.5) -> DataFrame:
    """(identifier, score): other names that share more than ``least`` of their characters, at 0.7 of that."""
    other = names.where(F.col("identifier") != name).select("identifier").distinct()
    return other.withColumn("similarity", charset_similarity(F.col("identifier"), F.lit(name))).where(F.col("similarity") > least).select("identifier", (F.col("similarity") * 0.7).alias("score"))


def paired_name(name: Column) -> Column:
    """The opposite of a name (get and set, open and close, create and delete), else null."""
    out = F.lit(None).cast("string")
    for word, opposite in reversed(PAIRS):
        out = F.when(F.contains(F.lower(name), F.lit(word)), F.replace(F.lower(name), F.lit(word), F.lit(opposite))).otherwise(out)
    return out


def linked(resolved: DataFrame, segments: DataFrame, query: str) -> DataFrame:
    """(target_segment_id, score): what segments that mention the query refer to."""
    sources = segments.where(F.contains(F.lower("content"), F.lit(query.lower()))).select("segment_id")
    return resolved.join(sources, "segment_id", "left_semi").select("target_segment_id", F.lit(0.8).alias("score")).distinct()
