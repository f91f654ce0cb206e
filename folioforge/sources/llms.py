"""llms.txt files as a source and a sink."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECTION = re.compile(r"^##\s+(.+)$")
_ENTRY = re.compile(r"^[-*]\s*\[([^\]]+)\]\(([^)]+)\)(?::\s*(.+))?$")
META_SCHEMA = "document_id long, title string, summary string, introduction string, sections array<string>, errors array<string>"
ENTRY_SCHEMA = "document_id long, section string, position int, title string, url string, description string, is_optional boolean"


def parse(text: str, url: str | None = None) -> dict:
    """Title (first H1), summary (first quote), introduction, and the links of each section."""
    out: dict = {"title": "", "summary": "", "introduction": "", "sections": {}}
    section: str | None = None
    intro: list[str] = []
    quote: list[str] | None = None
    for raw in text.split("\n"):
        line = raw.strip()
        if quote is not None:
            if line.startswith(">"):
                quote.append(line[1:].strip())
                continue
            out["summary"], quote = " ".join(quote), None
        if not line:
            continue
        if line.startswith("# ") and not out["title"]:
            out["title"] = line[2:].strip()
        elif line.startswith(">") and not out["summary"]:
            quote = [line[1:].strip()]
        elif m := _SECTION.match(line):
            section = m.group(1).strip()
        elif m := _ENTRY.match(line):
            if section is not None:
                target = m.group(2).strip()
                if url and not urlparse(target).scheme:
                    target = urljoin(url, target)
                out["sections"].setdefault(section, []).append((m.group(1).strip(), target, m.group(3).strip() if m.group(3) else None, "optional" in section.lower()))
        elif section is None:
            intro.append(line)
    if quote:
        out["summary"] = " ".join(quote)
    out["introduction"] = "\n".join(intro)
    return out


def problems(doc: dict) -> list[str]:
    out = [] if doc["title"] else ["no title"]
    if not (doc["sections"] or doc["introduction"] or doc["summary"]):
        out.append("nothing but a title")
    out += [f"no url: {title}" for entries in doc["sections"].values() for title, url, _, _ in entries if not url]
    return out


def _meta(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for i, url, text in zip(frame["document_id"], frame["url"], frame["text"]):
            d = parse(text, url)
            rows.append((i, d["title"], d["summary"], d["introduction"], list(d["sections"]), problems(d)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in META_SCHEMA.split(", ")])


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(i, s, k, *e) for i, url, text in zip(frame["document_id"], frame["url"], frame["text"]) for s, es in parse(text, url)["sections"].items() for k, e in enumerate(es)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY_SCHEMA.split(", ")])


def metadata(files: DataFrame) -> DataFrame:
    """One row per (document_id, url, text)."""
    return files.where(F.col("text").isNotNull()).select("document_id", "url", "text").mapInPandas(_meta, META_SCHEMA)


def entries(files: DataFrame) -> DataFrame:
    return files.where(F.col("text").isNotNull()).select("document_id", "url", "text").mapInPandas(_entries, ENTRY_SCHEMA)


def entry_line(title: Column, url: Column, description: Column) -> Column:
    return F.concat(F.lit("- ["), F.coalesce(title, url), F.lit("]("), url, F.lit(")"), F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(": "), description)).otherwise(""))


def render(documents: DataFrame, group: str) -> DataFrame:
    """(group, text): an llms.txt for each group of (group, doc_id, title, url, description)."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", entry_line(F.col("title"), F.col("url"), F.col("description")).alias("line")))), lambda x: x["line"]), "\n")
    name = F.col(group)
    return documents.where(name.isNotNull()).groupBy(group).agg(lines.alias("lines")).select(
        group, F.concat(F.lit("# "), name, F.lit("\n\nThis is the documentation collection for "), name, F.lit(".\n\n## Docs\n\n"), "lines", F.lit("\n")).alias("text")
    )
