"""Versions of a page: differences, similarity, update candidates."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators import adjacent

DIFF_SCHEMA = "old_id long, new_id long, similarity double, line_similarity double, added int, removed int, added_functions int, removed_functions int, change string"


def compare(old: str, new: str) -> tuple[float, float, int, int, int, int, str]:
    """(similarity by characters, share of characters in equal lines, lines added, removed, functions added, removed, in words)."""
    if old == new:
        return 1.0, 1.0, 0, 0, 0, 0, "no significant changes"
    a, b = old.splitlines(), new.splitlines()
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    added, removed, same = [], [], 0
    for tag, i1, i2, j1, j2 in matcher.get_opcodes():
        if tag == "equal":
            same += sum(map(len, a[i1:i2]))
        else:
            removed += a[i1:i2]
            added += b[j1:j2]
    total = sum(map(len, a)) + sum(map(len, b))
    functions = [sum("def " in x or "function " in x for x in lines) for lines in (added, removed)]
    parts = [f"{word} {n} {what}" for word, n, what in (("added", len(added), "lines"), ("removed", len(removed), "lines"), ("added", functions[0], "functions"), ("removed", functions[1], "functions")) if n]
    return difflib.SequenceMatcher(None, old, new).ratio(), (2 * same / total if total else 1.0), len(added), len(removed), *functions, "; ".join(parts) or "no significant changes"


def _diff_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(i, j, *compare(a or "", b or "")) for i, j, a, b in zip(frame["old_id"], frame["new_id"], frame["old_text"], frame["new_text"])]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIFF_SCHEMA.split(", ")])


def consecutive(documents: DataFrame) -> DataFrame:
    """(old_id, new_id, old_text, new_text): each page's versions in order of scraping.

    Only ids and hashes of the texts are ordered; texts are joined where they differ,
    and of equal ones just one is, so what didn't change isn't moved twice.
    """
    page_of = F.regexp_replace(F.lower("url"), r"/v?\d+(\.\d+)*(?=/|$)|/(stable|latest)(?=/|$)", "")
    since = F.coalesce(F.unix_micros("scraped_at"), F.lit(-(1 << 63)))
    pages = documents.where(F.col("url").isNotNull()).select("doc_id", since.alias("since"), page_of.alias("page"), F.xxhash64("text").alias("hash"))
    near = adjacent.neighbours(pages, F.col("page"), [F.col("since"), F.col("doc_id")], F.struct("doc_id", "hash")).where(F.col("prev").isNotNull())
    pairs = near.select(F.col("prev.doc_id").alias("old_id"), F.col("value.doc_id").alias("new_id"), F.col("prev.hash").alias("old_hash"), F.col("value.hash").alias("new_hash"))
    same = pairs.where(F.col("old_hash") == F.col("new_hash")).select("old_id", "new_id", F.lit("").alias("old_text"), F.lit("").alias("new_text"))
    changed = pairs.where(F.col("old_hash") != F.col("new_hash"))
    texts = documents.select("doc_id", "text")
    both = changed.join(texts.select(F.col("doc_id").alias("old_id"), F.col("text").alias("old_text")), "old_id").join(texts.select(F.col("doc_id").alias("new_id"), F.col("text").alias("new_text")), "new_id")
    return both.select("old_id", "new_id", "old_text", "new_text").unionByName(same)


def differences(pairs: DataFrame) -> DataFrame:
    return pairs.mapInPandas(_diff_batches, DIFF_SCHEMA)


def next_versions(documents: DataFrame) -> DataFrame:
    """(doc_id, candidate): versions that may follow the one in a row (patch, minor, major)."""
    v = F.col("version")
    number = [F.regexp_extract(v, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?$", k).try_cast("int") for k in (1, 2, 3)]
    major, minor, patch = number[0], F.coalesce(number[1], F.lit(0)), F.coalesce(number[2], F.lit(0))
    join = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    options = F.array(join(major, minor, patch + 1), join(major, minor + 1, F.lit(0)), join(major + 1, F.lit(0), F.lit(0)))
    return documents.where(major.isNotNull()).select("doc_id", F.explode(options).alias("candidate"))
