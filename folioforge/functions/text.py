"""Text functions as column expressions: previews, labels, stems, highlights, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that the query stemmer strips, in order.
STEM_SUFFIXES = ("ing", "ed", "s", "ly")

# Semantic roles of a segment, first match wins.
ROLE_MARKS = (
    ("code_example", ("```",)),
    ("example", ("example:", "usage:", "demo:")),
    ("api_reference", ("class ", "function ", "def ", "method ")),
    ("setup_guide", ("install", "setup", "configure")),
)

# Kinds of a title, first match wins.
TITLE_KINDS = (
    ("api_reference", ("api", "function", "method", "class", "module")),
    ("tutorial", ("example", "tutorial", "guide")),
    ("setup", ("install", "setup", "config")),
)


def query_terms(query: str, max_terms: int | None = 3) -> list[str]:
    """Lower-case words of a query, then the stems of its longer words; at most ``max_terms``."""
    words = query.lower().split()
    stems = []
    for word in words:
        if len(word) > 5:
            suffix = next((s for s in STEM_SUFFIXES if word.endswith(s)), None)
            if suffix:
                stems.append(word[: -len(suffix)])
    terms = words + stems
    return terms if max_terms is None else terms[:max_terms]


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """True where the lower-cased text holds one of the needles."""
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(text, F.lit(needle))
    return out


def first_label(text: Column, table: tuple[tuple[str, tuple[str, ...]], ...], default: str | None) -> Column:
    low = F.lower(text)
    out = F.lit(default)
    for name, needles in reversed(table):
        out = F.when(contains_any(low, needles), name).otherwise(out)
    return out


def semantic_role(content: Column) -> Column:
    return F.coalesce(first_label(content, ROLE_MARKS, "general"), F.lit("general"))


def title_kind(title: Column) -> Column:
    return first_label(title, TITLE_KINDS, None)


def preview(content: Column, size: int = 100) -> Column:
    """Markup signs removed, white space collapsed, cut at ``size`` with an ellipsis."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(content, r"[#*`_\[\]()]", ""), r"\s+", " "))
    return F.when(F.length(plain) > size, F.concat(F.substring(plain, 1, size), F.lit("..."))).otherwise(plain)


def result_preview(content: Column, size: int = 200) -> Column:
    """The start of a result's content as it stands, with an ellipsis where it goes on."""
    return F.when(F.length(content) > size, F.concat(F.substring(content, 1, size), F.lit("..."))).otherwise(content)


def clean_lines(content: Column) -> Column:
    """Lines trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != ""), "\n")


def highlight(content: Column, terms: list[str]) -> Column:
    """``**term**`` at word boundaries, case kept, one term after the other."""
    for term in terms:
        content = F.regexp_replace(content, rf"(?i)\b({re.escape(term)})\b", "**$1**")
    return content


def storage_name(url: Column) -> Column:
    """Name of a stored page: its host with signs as underscores, and the MD5 of the URL."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.concat(F.regexp_replace(host, r"[^a-zA-Z0-9]", "_"), F.lit("_"), F.md5(url))


def charset_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the characters of two names; 1 if they are equal."""
    left, right = (F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != "")) for c in (a, b))
    either = F.size(F.array_union(left, right))
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / either)


def metadata_line(title: Column, section: Column, level: Column, kind: Column) -> Column:
    """One line that describes a segment; missing parts are left out."""
    return F.concat_ws(
        " | ",
        F.when(title.isNotNull(), F.concat(F.lit("Document: "), title)),
        F.when(section.isNotNull(), F.concat(F.lit("Section L"), F.coalesce(level, F.lit(0)).cast("string"), F.lit(": "), section)),
        F.when(kind.isNotNull(), F.concat(F.lit("Type: "), kind)),
    )
