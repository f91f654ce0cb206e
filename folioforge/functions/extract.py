"""Extraction of names, references, anchors, links and code from Markdown and source text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of references by type.
REFERENCE_PATTERNS = {
    "function": (r"\b(\w+)\s*\(", r"`(\w+)\(\)`", r"`(\w+)\(`"),
    "class": (r"\bclass\s+(\w+)", r"`(\w+)`\s+class", r"\b([A-Z]\w+)\s+class"),
    "method": (r"\.(\w+)\s*\(", r"`\.(\w+)\(\)`", r"\b(\w+)\.(\w+)\s*\("),
    "module": (r"import\s+(\w+)", r"from\s+(\w+)\s+import", r"`(\w+)`\s+module"),
}
# Patterns of anchors by type.
ANCHOR_PATTERNS = {"function": r"(?:def|function)\s+(\w+)\s*\(([^)]*)\)", "class": r"class\s+(\w+)(?:\s*\([^)]*\))?", "method": r"(?m)^\s{4,}def\s+(\w+)\s*\("}

_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
REFERENCE_SCHEMA = "segment_id long, reference_type string, reference_text string, reference_context string, confidence double"


def references_in(text: str) -> Iterator[tuple[str, str, str, float]]:
    """(type, name, 50 characters around, confidence) of every match of every pattern, links to anchors last."""
    for kind, patterns in REFERENCE_PATTERNS.items():
        for pattern in patterns:
            for m in re.finditer(pattern, text, re.IGNORECASE):
                yield kind, ".".join(m.groups()), text[max(0, m.start() - 50) : m.end() + 50].strip(), 0.8
    for m in _LINK.finditer(text):
        if m.group(2).startswith("#"):
            yield "link", m.group(1), m.group(2), 1.0


def reference_names(segments: DataFrame) -> DataFrame:
    """(segment_id, reference_type, reference_text, confidence) of (segment_id, content): as ``references`` without the text around, by expressions alone.

    Words are runs of ASCII letters, digits and underscores here.
    """
    out = None

    def found(kind: str, pattern: str) -> DataFrame:
        pattern = f"(?i){pattern}"
        first = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        if re.compile(pattern).groups == 2:
            first = F.zip_with(first, F.regexp_extract_all("content", F.lit(pattern), F.lit(2)), lambda a, b: F.concat(a, F.lit("."), b))
        return segments.select("segment_id", F.lit(kind).alias("reference_type"), F.explode(first).alias("reference_text"), F.lit(0.8).alias("confidence"))

    for kind, patterns in REFERENCE_PATTERNS.items():
        for pattern in patterns:
            part = found(kind, pattern)
            out = part if out is None else out.unionByName(part)
    links = segments.select("segment_id", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(_LINK.pattern), F.lit(1)).alias("text"), F.regexp_extract_all("content", F.lit(_LINK.pattern), F.lit(2)).alias("target"))).alias("m"))
    return out.unionByName(links.where(F.col("m.target").startswith("#")).select("segment_id", F.lit("link").alias("reference_type"), F.col("m.text").alias("reference_text"), F.lit(1.0).alias("confidence")))


def _reference_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in REFERENCE_SCHEMA.split(", ")]
    for frame in frames:
        yield pd.DataFrame([(i, *r) for i, text in zip(frame["segment_id"], frame["content"]) for r in references_in(text)], columns=columns)


def references(segments: DataFrame) -> DataFrame:
    """References of (segment_id, content)."""
    return segments.where(F.length("content") > 0).select("segment_id", "content").mapInPandas(_reference_batches, REFERENCE_SCHEMA)


def anchors(segments: DataFrame) -> DataFrame:
    """(document_id, segment_id, anchor_type, anchor_name, anchor_signature) of (document_id, segment_id, content)."""
    out = None
    for kind, pattern in ANCHOR_PATTERNS.items():
        names = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        whole = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        params = F.regexp_extract_all("content", F.lit(pattern), F.lit(2)) if kind == "function" else whole
        pair = F.explode(F.arrays_zip(names.alias("name"), whole.alias("whole"), params.alias("params"))).alias("m")
        rows = segments.select("document_id", "segment_id", pair)
        signature = {"function": F.concat("m.name", F.lit("("), "m.params", F.lit(")")), "class": F.col("m.whole"), "method": F.lit(None).cast("string")}[kind]
        part = rows.select("document_id", "segment_id", F.lit(kind).alias("anchor_type"), F.col("m.name").alias("anchor_name"), signature.alias("anchor_signature"))
        out = part if out is None else out.unionByName(part)
    return out


def called_names(content: Column) -> Column:
    """Names before an opening bracket, without the words of control flow; repeated ones stay."""
    return F.filter(F.regexp_extract_all(content, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)), lambda x: ~x.isin("if", "for", "while", "with"))


def identifiers(content: Column) -> Column:
    """Array of struct(name, kind): functions, classes, methods and modules, in this order; functions and methods have three characters or more, functions no capital first."""

    def named(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit(kind).alias("kind")))

    functions = F.filter(named(r"\b(\w+)\s*\(", "function"), lambda x: (F.length(x["name"]) > 2) & ~x["name"].rlike("^[A-Z]"))
    methods = F.filter(named(r"\.(\w+)\s*\(", "method"), lambda x: F.length(x["name"]) > 2)
    return F.concat(functions, named(r"\bclass\s+(\w+)", "class"), methods, named(r"import\s+(\w+)", "module"))


def clean_signature(text: Column) -> Column:
    """White space as one blank, one blank after each comma and none before, a closing pilcrow dropped."""
    one = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(one, r"\s*,\s*", ", "), r"¶\s*$", ""))


def code_blocks(content: Column) -> Column:
    """Array of struct(language, code) of the fenced blocks."""
    pattern = F.lit(r"(?s)```(\w*)[^\n]*\n(.*?)```")
    return F.arrays_zip(F.regexp_extract_all(content, pattern, F.lit(1)).alias("language"), F.regexp_extract_all(content, pattern, F.lit(2)).alias("code"))


def markdown_links(content: Column) -> Column:
    """Array of struct(text, target) of the Markdown links."""
    pattern = F.lit(r"\[([^\]]+)\]\(([^)\s]+)\)")
    return F.arrays_zip(F.regexp_extract_all(content, pattern, F.lit(1)).alias("text"), F.regexp_extract_all(content, pattern, F.lit(2)).alias("target"))


def key_concepts(content: Column) -> Column:
    """Distinct bold phrases and code words, sorted."""
    bold = F.regexp_extract_all(content, F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1))
    code = F.regexp_extract_all(content, F.lit(r"`([A-Za-z_][\w.]*)`"), F.lit(1))
    return F.array_sort(F.array_union(bold, code))
