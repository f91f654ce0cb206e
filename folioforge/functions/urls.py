"""URL functions: versions, document scores, link decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns of documentation and of other pages, and file endings that are skipped.
DOC_PATHS = ("/docs?/", "/api/", "/reference/", "/guide/", "/manual/", "/tutorial/", "/documentation/", "/resources/docs/", "/developer/", "/dev-?guide/", "/learn/", "/getting-?started/")
OTHER_PATHS = (
    "/blog/", "/news/", "/about/", "/careers?/", "/jobs?/", "/pricing/", "/contact/", "/support/", "/terms/", "/privacy/",
    "/legal/", "/press/", "/events?/", "/community/", "/forum/", "/download/", "/signin/", "/login/", "/register/", "/account/",
)
SKIPPED_ENDINGS = (
    ".pdf", ".zip", ".tar", ".gz", ".exe", ".dmg", ".pkg", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".mp3", ".mp4", ".avi", ".mov", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
# What marks a version in a path, in order.
VERSION_PATHS = (r"/v\d+(?:\.\d+)*/", r"/\d+(?:\.\d+)*/", "/stable/", "/latest/", "/dev/", "/master/")


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_version(of: Column) -> Column:
    """First version mark of a path, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(of, f"({p})", 1), F.lit("")) for p in VERSION_PATHS))


# Forms of a version in a URL, in order.
URL_VERSIONS = (
    r"/v?(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)",
    r"/(\d+\.\d+(?:\.\d+)?(?:\.\d+)?)/",
    r"version[=/](\d+\.\d+(?:\.\d+)?)",
    r"tag[=/]v?(\d+\.\d+(?:\.\d+)?)",
)


def url_version(url: Column) -> Column:
    """Version number in a URL by the first form that it has, in any case, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(url, f"(?i){p}", 1), F.lit("")) for p in URL_VERSIONS))


def repository_document(path: Column) -> Column:
    """Whether a file of a repository is documentation: below ``docs/`` or Markdown or reStructuredText, but not the top readme."""
    low = F.lower(path)
    return (low.startswith("docs/") | low.endswith(".md") | low.endswith(".rst")) & (low != "readme.md")


def document_score(of: Column) -> Column:
    """Sum of the pattern marks of a path, between -1 and 1, in tenths."""
    low = F.lower(of)
    tenths = F.lit(0)
    for p in DOC_PATHS:
        tenths = tenths + F.when(low.rlike(p), 3).otherwise(0)
    for p in OTHER_PATHS:
        tenths = tenths - F.when(low.rlike(p), 5).otherwise(0)
    tenths = tenths + F.when(F.contains(low, F.lit("/api/")) & low.rlike("reference|docs|v1|v2"), 3).otherwise(0)
    tenths = tenths - F.when(F.length(low) - F.length(F.replace(low, F.lit("/"))) > 6, 2).otherwise(0)
    return F.greatest(F.lit(-10), F.least(F.lit(10), tenths)) / 10


def link_decision(url: Column, base: Column, depth: int, strategy: str = "auto") -> Column:
    """struct(follow, priority, reason, suggested_depth) of a link from ``base``."""
    target, origin = path(url), path(base)
    score = document_score(target)
    mine, other = path_version(origin), path_version(target)
    consistent = mine.isNull() | other.isNull() | (mine == other)
    a, b = (F.filter(F.split(p, "/"), lambda x: x != "") for p in (origin, target))
    child = (F.size(a) > 0) & (F.size(b) > F.size(a)) & (F.slice(b, 1, F.greatest(F.size(a), F.lit(1))) == a)
    ending = F.lit(None).cast("string")
    for e in reversed(SKIPPED_ENDINGS):
        ending = F.when(F.lower(target).endswith(e), e).otherwise(ending)

    def row(follow, priority, reason) -> Column:
        follow = F.lit(follow) if isinstance(follow, bool) else follow
        suggested = F.when(follow, F.when(score > 0.8, 3).when(score > 0.5, 2).otherwise(1))
        reason = F.lit(reason) if isinstance(reason, str) else reason
        priority = F.lit(priority) if isinstance(priority, float) else priority
        return F.struct(follow.alias("follow"), priority.cast("double").alias("priority"), reason.alias("reason"), suggested.cast("int").alias("suggested_depth"))

    none = F.lit(None).cast("int")
    if strategy == "manual":
        chosen = F.struct(F.lit(depth > 0).alias("follow"), F.lit(0.5).alias("priority"), F.lit("manual depth").alias("reason"), none.alias("suggested_depth"))
    elif strategy == "conservative":
        sure = (score > 0.7) & consistent
        chosen = row(sure, F.when(sure, score).otherwise(0.0), F.when(sure, "clear documentation link").otherwise("not clearly documentation"))
    elif strategy == "aggressive":
        fine = (score > -0.5) & F.lit(depth > 0)
        chosen = row(fine, F.greatest(F.lit(0.1), (score + 1) / 2), F.when(fine, "acceptable link").otherwise("clearly no documentation"))
    else:
        chosen = (
            F.when(score > 0.5, row(True, F.least(F.lit(1.0), score + F.when(child, 0.2).otherwise(0.0)), "documentation path"))
            .when(score < -0.5, row(False, 0.0, "other path"))
            .when(child & consistent, row(True, 0.5, "child of the same section"))
            .otherwise(row(depth > 1, 0.3, "uncertain"))
        )
    refused = lambda why: F.struct(F.lit(False).alias("follow"), F.lit(0.0).alias("priority"), why.alias("reason"), none.alias("suggested_depth"))
    return F.when(domain(url) != domain(base), refused(F.lit("other domain"))).when(ending.isNotNull(), refused(F.concat(F.lit("file type "), ending))).otherwise(chosen)
