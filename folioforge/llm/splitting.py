"""Splitting oversized texts at natural boundaries (problem 5).

A text longer than its profile's ``chunk_size`` is split by a recursive
hierarchy of separators: section (a heading line starts one), paragraph (blank
line), line and sentence, word, and at last character.  Only what is still too
long goes down to the next level.  The parts are packed greedily: a piece takes
parts while it stays within ``chunk_size``, and each piece after the first
starts with the last ``overlap`` characters of the one before.

Defined results: positions are code points, ``end`` exclusive; pieces cover the
text and consecutive ones share exactly ``overlap`` characters; a text within
its limit, an empty or null one gives no rows; a null or unlisted type takes the
``*`` profile; an overlap of ``chunk_size`` or more counts as ``chunk_size - 1``;
copies of a row count once.  ``forced`` is 1 for all pieces of a text with a run
of characters without white space longer than ``chunk_size``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the problem: space, tab, CR, LF.
BLANKS = " \t\r\n"
LEVELS = ("section", "paragraph", "sentence", "word", "character")

#: Each pattern ends where the next part begins; the levels follow LEVELS.
_SEPARATORS = (
    re.compile(r"\n(?=#{1,6}[ \t])"),
    re.compile(r"\n[ \t\r]*\n[ \t\r\n]*"),
    re.compile(r"\n|[.!?…]+[\"')\]”’»]*[ \t\r\n]+|[。！？]+[」』）]*"),
    re.compile(r"[ \t\r\n]+"),
)
_RUN = re.compile(rf"[^{BLANKS}]+")


def parts(text: str, limit: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, level of the boundary at the end) of consecutive parts of at most ``limit`` characters.

    The level is the coarsest one at which the part was separated from the next.
    """
    stack = [(0, len(text), 0, 0)]
    while stack:
        start, end, level, after = stack.pop()
        if end - start <= limit:
            yield start, end, after
        elif level == len(_SEPARATORS):
            for at in range(start, end, limit):
                yield at, min(at + limit, end), level if at + limit < end else after
        else:
            ends = [m.end() for m in _SEPARATORS[level].finditer(text, start, end)]
            ends = [start, *(e for e in ends if start < e < end), end]
            stack.extend((a, b, level + 1, level if b < end else after) for a, b in zip(ends[-2::-1], ends[:0:-1]))


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut at the end) of the pieces of ``text``."""
    overlap = max(0, min(overlap, size - 1))
    out: list[tuple[int, int, str]] = []
    start = end = cut = 0
    for _, stop, level in parts(text, size - overlap):
        if stop - start > size:
            out.append((start, end, LEVELS[cut]))
            start = end - overlap
        end, cut = stop, level
    if end > start:
        out.append((start, end, "end"))
    return out


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["segment_id", "chunk_number", "total_chunks", "start_position", "end_position", "cut_level", "forced", "content"]
    for frame in frames:
        rows = []
        for sid, text, size, overlap in zip(frame["segment_id"], frame["content"], frame["chunk_size"], frame["overlap"]):
            forced = int(any(m.end() - m.start() > size for m in _RUN.finditer(text)))
            found = pieces(text, int(size), int(overlap))
            rows += [(sid, n, len(found), a, b, level, forced, text[a:b]) for n, (a, b, level) in enumerate(found, 1)]
        yield pd.DataFrame(rows, columns=columns)


def split_oversized(segments: DataFrame, profiles: DataFrame, id_col: str = "id", content_col: str = "content", type_col: str = "segment_type", max_profiles: int = 10_000) -> DataFrame:
    """Pieces of the contents beyond the ``chunk_size`` of their profile.

    Columns: segment_id, chunk_number (from 1), total_chunks, start_position,
    end_position, cut_level, forced, content.  The profile table is read to the
    driver, behind a check of its size; beyond ``max_profiles`` it is joined.
    """
    base = segments.select(
        F.col(id_col).cast("long").alias("segment_id"), F.col(content_col).alias("content"), F.lower(F.trim(F.regexp_replace(F.col(type_col), r"^\s+|\s+$", ""))).alias("kind")
    ).where(F.length("content") > 0)
    rules = profiles.where(F.col("segment_type").isNotNull() & (F.col("chunk_size") > 0)).groupBy(F.col("segment_type").alias("kind")).agg(F.min("chunk_size").alias("chunk_size"), F.min(F.coalesce("overlap", F.lit(0))).alias("overlap"))
    if len(rows := rules.limit(max_profiles + 1).collect()) <= max_profiles:
        table = {r["kind"]: (r["chunk_size"], r["overlap"]) for r in rows}
        star = table.pop("*", (None, None))

        def pick(k: int):
            value = F.lit(star[k]).cast("int")
            for kind, found in table.items():
                value = F.when(F.col("kind") == kind, F.lit(found[k])).otherwise(value)
            return value

        sized = base.select("segment_id", "content", pick(0).alias("chunk_size"), pick(1).alias("overlap"))
    else:
        known = base.join(rules, "kind", "left")
        star = rules.where(F.col("kind") == "*").agg(F.max("chunk_size").alias("size_any"), F.max("overlap").alias("overlap_any"))
        sized = known.join(F.broadcast(star)).select("segment_id", "content", F.coalesce("chunk_size", "size_any").alias("chunk_size"), F.coalesce("overlap", "overlap_any").alias("overlap"))
    over = sized.where(F.length("content") > F.col("chunk_size")).dropDuplicates(["segment_id", "content"])
    return over.mapInPandas(_split, "segment_id long, chunk_number int, total_chunks int, start_position long, end_position long, cut_level string, forced int, content string")


def oversized_segments(segments: DataFrame, profiles: DataFrame, **columns: str) -> DataFrame:
    """(segment_id, forced) of each split segment, from its pieces."""
    split = split_oversized(segments, profiles, **columns)
    return split.where(F.col("chunk_number") == 1).groupBy("segment_id").agg(F.max("forced").alias("forced"))
