"""Cutting documents into chunks and Markdown into segments.

Character chunks are pure expressions.  The greedy strategies carry state from
part to part, which no window function does; each document is one row of an
Arrow batch there, so nothing is shuffled but the sections that form a document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import adjacent

CHUNK_SCHEMA = "document_id long, chunk_number int, total_chunks int, start_position long, end_position long, strategy string, content string"

# What opens a new unit of meaning at the start of a line.
_UNIT_START = re.compile(r"^#{1,6}\s|^\n|^[*+-]\s|^\d+\.\s|^(?:---+|===+|\*\*\*+)$", re.MULTILINE)
_BLANK_LINE = re.compile(r"\n\n+")
_FENCED = re.compile(r"```.*?```", re.DOTALL)
_HEADER = re.compile(r"^(#{1,6})\s+(.+)$")


def character_chunks(documents: DataFrame, size: int) -> DataFrame:
    """(document_id, chunk_number, total_chunks, start_position, end_position, has_next, has_prev, content) of (document_id, text)."""
    full = documents.where(F.length("text") > 0).withColumn("n", F.length("text"))
    starts = full.select("document_id", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(size))).alias("start"))
    total = F.ceil(F.col("n") / size).cast("int")
    number = (F.col("start") / size).cast("int") + 1
    return starts.select(
        "document_id", number.alias("chunk_number"), total.alias("total_chunks"), F.col("start").cast("long").alias("start_position"), F.least(F.col("start") + size, F.col("n")).cast("long").alias("end_position"),
        (number < total).alias("has_next"), (number > 1).alias("has_prev"), F.expr(f"substring(text, start + 1, {size})").alias("content"),
    )


def paragraph_spans(text: str, size: int) -> list[tuple[int, int]]:
    """Paragraphs packed while they fit; a separator counts only when a paragraph is added to others."""
    spans: list[tuple[int, int]] = []
    begin, at, held = 0, 0, 0
    filled = False
    for part in text.split("\n\n"):
        if filled and held + len(part) > size:
            spans.append((begin, at - 2))
            begin, held = at, len(part)
        else:
            held += len(part) + 2
        filled = True
        at += len(part) + 2
    spans.append((begin, at - 2))
    return spans


def unit_starts(text: str) -> list[int]:
    """Sorted places where a unit may start, none of them inside a code fence."""
    fences = [m.span() for m in _FENCED.finditer(text)]
    found = {m.start() for p in (_UNIT_START, _BLANK_LINE) for m in p.finditer(text)}
    kept, k = [], 0
    for at in sorted(found):
        while k < len(fences) and fences[k][1] < at:
            k += 1
        if k == len(fences) or not fences[k][0] <= at <= fences[k][1]:
            kept.append(at)
    return sorted({0, *kept, len(text)})


def semantic_spans(text: str, size: int) -> list[tuple[int, int]]:
    """One cut for each unit start at or beyond the size: at the last one that fits, else at the size."""
    places = unit_starts(text)
    spans: list[tuple[int, int]] = []
    begin, last_fit = 0, 0
    for i, place in enumerate(places[1:], 1):
        if place - begin < size:
            continue
        while last_fit + 1 < i and places[last_fit + 1] - begin <= size:
            last_fit += 1
        cut = places[last_fit] if places[last_fit] > begin else begin + size
        spans.append((begin, cut))
        begin = cut
    if begin < len(text):
        spans.append((begin, len(text)))
    return spans


def break_point(buffer: str, size: int, natural: bool) -> int:
    """Where a buffer is cut: after a paragraph, sentence or line in its last third, else at the size; -1 if it's short."""
    if len(buffer) < size:
        return -1
    if natural:
        least = size * 0.7
        if (at := buffer.rfind("\n\n", 0, size)) > least:
            return at + 2
        for at in range(size - 1, int(least), -1):
            if buffer[at] in ".!?" and buffer[at + 1 : at + 2] in (" ", "\n"):
                return at + 1
        if (at := buffer.rfind("\n", 0, size)) > least:
            return at + 1
    return size


def stream_spans(text: str, size: int, overlap: int, natural: bool = True) -> list[tuple[int, int]]:
    """Spans of a reader that takes ``size`` characters at a time and keeps ``overlap`` of what it gave out."""
    spans: list[tuple[int, int]] = []
    begin = read = 0
    while read < len(text):
        read = min(read + size, len(text))
        cut = break_point(text[begin:read], size, natural)
        if cut > 0:
            spans.append((begin, begin + cut))
            begin += cut - overlap if overlap > 0 and read - begin > cut else cut
    if begin < len(text):
        spans.append((begin, len(text)))
    return spans


def index_spans(text: str, chars: int = 500, words: int = 50) -> list[tuple[int, int]]:
    """Runs of whole lines of more than ``chars`` characters and ``words`` words; a blank rest is dropped."""
    spans: list[tuple[int, int]] = []
    begin = at = seen = 0
    for line in text.split("\n"):
        at += len(line) + 1
        seen += len(line.split())
        if at - begin > chars and seen > words:
            spans.append((begin, at))
            begin, seen = at, 0
    if text[begin:].strip():
        spans.append((begin, len(text)))
    return [(a, min(b, len(text))) for a, b in spans]


def sized_spans(text: str, size: int = 8_000) -> list[tuple[int, int]]:
    """Packed paragraphs; one that is still too long is packed from its sentences."""
    out: list[tuple[int, int]] = []
    for a, b in paragraph_spans(text, size) if len(text) > size else [(0, len(text))]:
        begin = at = a
        if b - a > size:
            for m in re.finditer(r"\. ", text[a:b]):
                if a + m.end() - begin > size and at > begin:
                    out.append((begin, at))
                    begin = at
                at = a + m.end()
            if b - begin > size and at > begin:
                out.append((begin, at))
                begin = at
        out.append((begin, b))
    return out


def _span_batches(strategy: str, spans: Callable[[str], list[tuple[int, int]]], strip: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for doc, text in zip(frame["document_id"], frame["text"]):
                found = spans(text)
                for n, (a, b) in enumerate(found, 1):
                    rows.append((doc, n, len(found), a, b, strategy, text[a:b].strip() if strip else text[a:b]))
            yield pd.DataFrame(rows, columns=columns)

    return run


def text_chunks(documents: DataFrame, strategy: str, size: int, overlap: int = 0) -> DataFrame:
    """Chunks of (document_id, text) by ``paragraph``, ``semantic``, ``stream``, ``index`` or ``sized``; empty and null texts give none."""
    spans = {"index": lambda t: index_spans(t, size), "sized": lambda t: sized_spans(t, size), "paragraph": lambda t: paragraph_spans(t, size), "semantic": lambda t: semantic_spans(t, size), "stream": lambda t: stream_spans(t, size, overlap)}[strategy]
    full = documents.where(F.length("text") > 0).select("document_id", "text")
    return full.mapInPandas(_span_batches(strategy, spans, strategy == "semantic"), CHUNK_SCHEMA)


def section_packs(segments: DataFrame, size: int) -> DataFrame:
    """(document_id, id, section_path, chunk_number, start, end): sections packed greedily in lexical path order.

    The running sum that starts anew is a fold over the document's sorted
    section lengths; contents don't take part in the shuffle.
    """
    lengths = segments.select("document_id", "id", "section_path", F.length("content").alias("n")).distinct()
    per_doc = lengths.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("section_path", F.lit("")).alias("p"), "id", "n"))).alias("s"))
    # the fold carries what a chunk holds and where chunks start; sections aren't copied at each step
    zero = F.struct(F.lit(0).alias("held"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))

    def step(acc, x):
        fresh = (acc["held"] + x["n"] > size) & (acc["at"] > 0)
        return F.struct(
            F.when(fresh, x["n"]).otherwise(acc["held"] + x["n"]).alias("held"), (acc["at"] + 1).alias("at"), F.when(fresh, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts")
        )

    starts = per_doc.select("document_id", "s", F.aggregate("s", zero, step, lambda a: a["starts"]).alias("starts"))
    ranges = starts.select("document_id", "s", F.posexplode("starts").alias("k", "start"), F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("s"))).alias("ends"))
    packed = ranges.select("document_id", (F.col("k") + 1).alias("chunk_number"), F.explode(F.slice("s", F.col("start") + 1, F.element_at("ends", F.col("k") + 1) - F.col("start"))).alias("o"))
    packed = packed.select("document_id", F.col("o.id").alias("id"), "chunk_number")
    order = Window.partitionBy("document_id", "chunk_number").orderBy(F.coalesce("section_path", F.lit("")), "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    return packed.join(lengths, ["document_id", "id"]).select(
        "document_id", "id", "section_path", "chunk_number", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"), (F.coalesce(F.sum("n").over(order), F.lit(0)) + F.col("n")).alias("end")
    )


def section_spans(segments: DataFrame, size: int) -> DataFrame:
    """(document_id, id, section_path, start, end, chunk_numbers, primary_chunk): which chunks of a fixed size each section lies in, in lexical path order.

    An empty section lies in no chunk; its primary chunk is 1.
    """
    lengths = segments.select("document_id", "id", F.coalesce("section_path", F.lit("")).alias("section_path"), F.length("content").cast("long").alias("n")).distinct()
    order = Window.partitionBy("document_id").orderBy("section_path", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = lengths.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0)))
    first, last = F.expr(f"start div {size} + 1"), F.expr(f"(start + n - 1) div {size} + 1")
    chunks = F.when(F.col("n") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return placed.select("document_id", "id", "section_path", "start", (F.col("start") + F.col("n")).alias("end"), chunks.alias("chunk_numbers"), F.when(F.col("n") > 0, first).otherwise(F.lit(1)).cast("long").alias("primary_chunk"))


def sections_in_chunk(index: DataFrame, chunk_number: int) -> DataFrame:
    """(document_id, id, section_path) of the sections of an index (``section_packs`` or ``section_spans``) that lie in a chunk."""
    inside = F.array_contains("chunk_numbers", F.lit(chunk_number).cast("long")) if "chunk_numbers" in index.columns else F.col("chunk_number") == chunk_number
    return index.where(inside).select("document_id", "id", "section_path")


def section_chunk(index: DataFrame, document_id: int, path: str) -> DataFrame:
    """(id, primary_chunk) of a section of an index."""
    primary = F.col("primary_chunk") if "primary_chunk" in index.columns else F.col("chunk_number")
    return index.where((F.col("document_id") == document_id) & (F.col("section_path") == path)).select("id", primary.alias("primary_chunk"))


def chunk_navigation(packs: DataFrame) -> DataFrame:
    """(document_id, id, section_path, chunk, prev_path, prev_chunk, next_path, next_chunk) in lexical path order, of ``section_packs``."""
    value = F.struct("id", "section_path", "chunk_number")
    near = adjacent.neighbours(packs, F.col("document_id"), [F.coalesce("section_path", F.lit("")), F.col("id"), F.col("start")], value)
    return near.select(
        F.col("group").alias("document_id"), "value.id", "value.section_path", F.col("value.chunk_number").alias("chunk"), F.col("prev.section_path").alias("prev_path"), F.col("prev.chunk_number").alias("prev_chunk"),
        F.col("next.section_path").alias("next_path"), F.col("next.chunk_number").alias("next_chunk"),
    )


def section_chunks(segments: DataFrame, size: int) -> DataFrame:
    """One row per packed chunk: path range, neighbours, content with headings; ``hybrid`` where it is far beyond the size."""
    packs = section_packs(segments, size)
    rows = packs.join(segments.select("id", "section_title", "content").distinct(), "id")
    heading = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.repeat(F.lit("#"), F.size(F.split(F.coalesce("section_path", F.lit("")), r"\."))), F.lit(" "), "section_title", F.lit("\n\n"))).otherwise("")
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("section_path", F.lit("")).alias("p"), F.col("id").alias("i"), F.concat(heading, "content", F.lit("\n\n")).alias("t"))))
    chunks = rows.groupBy("document_id", "chunk_number").agg(ordered.alias("s"))
    body = F.regexp_replace(F.array_join(F.transform("s", lambda x: x["t"]), ""), r"^\s+|\s+$", "")
    first, last = F.element_at("s", 1)["p"], F.element_at("s", -1)["p"]
    by_doc = Window.partitionBy("document_id").orderBy("chunk_number")
    return chunks.select(
        "document_id", "chunk_number", F.count(F.lit(1)).over(Window.partitionBy("document_id")).cast("int").alias("total_chunks"), F.concat(first, F.lit("-"), last).alias("section_path"),
        F.lag(last).over(by_doc).alias("prev_section"), F.lead(first).over(by_doc).alias("next_section"), F.length(body).alias("end_position"),
        F.when(F.length(body) > 1.5 * size, "hybrid").otherwise("section").alias("strategy"), body.alias("content"),
    )


def markdown_segments(text: str) -> list[tuple[str, str, str, int, str]]:
    """(type, content, section_title, section_level, section_path): one segment per heading, its fenced code split out.

    A path has the number of each open heading among its parent's children of the
    same level.  A heading at the top always has number 1.
    """
    out: list[tuple[str, str, str, int, str]] = []
    open_: list[tuple[int, str, int]] = []  # level, title, number
    born: list[dict[int, int]] = [{}]  # children by level, of the root and of each open heading
    lines: list[str] = []

    def close() -> None:
        if not lines:
            return
        level, title = (open_[-1][0], open_[-1][1]) if open_ else (0, "Introduction")
        path = ".".join(str(n) for _, _, n in open_)
        kind = f"h{level}" if open_ else "text"
        body = "\n".join(lines)
        at = 0
        fences = list(re.finditer(r"```.*?\n(.*?)```", body, re.DOTALL))
        if not fences:
            out.append((kind, body, title, level, path))
            return
        for m in fences:
            for piece, sort in ((body[at : m.start()].strip(), kind), (m.group(1).strip(), "code")):
                if piece:
                    out.append((sort, piece, title, level, path))
            at = m.end()
        if rest := body[at:].strip():
            out.append((kind, rest, title, level, path))

    for line in text.split("\n"):
        if head := _HEADER.match(line):
            close()
            level = len(head.group(1))
            while open_ and open_[-1][0] >= level:
                open_.pop()
                born.pop()
            number = 1
            if open_:
                born[-1][level] = number = born[-1].get(level, 0) + 1
            open_.append((level, head.group(2).strip(), number))
            born.append({})
            lines = [line]
        else:
            lines.append(line)
    close()
    return out or [("text", text, "Introduction", 0, "")]


def _segment_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(doc, n, *segment) for doc, text in zip(frame["document_id"], frame["text"]) for n, segment in enumerate(markdown_segments(text))]
        yield pd.DataFrame(rows, columns=["document_id", "position", "segment_type", "content", "section_title", "section_level", "section_path"])


def segment_markdown(documents: DataFrame) -> DataFrame:
    """Segments of (document_id, text); null texts give none."""
    full = documents.where(F.col("text").isNotNull()).select("document_id", "text")
    return full.mapInPandas(_segment_batches, "document_id long, position int, segment_type string, content string, section_title string, section_level int, section_path string")


def split_sections(text: str, least: int = 100, most: int = 8_000) -> list[tuple[str, int, str, str]]:
    """(title, level, path, content) by counters of six levels; short sections drop out, long ones become parts."""
    counts = [0] * 6
    found: list[tuple[str, int, str, list[str]]] = []
    for line in text.split("\n"):
        if head := _HEADER.match(line):
            level = len(head.group(1))
            counts[level - 1] += 1
            counts[level:] = [0] * (6 - level)
            found.append((head.group(2).strip(), level, ".".join(str(c) for c in counts[:level] if c), []))
        elif found:
            found[-1][3].append(line)
        elif line.strip():
            counts[0] = 1
            found.append(("Introduction", 1, "1", [line]))
    out: list[tuple[str, int, str, str]] = []
    for title, level, path, lines in found:
        body = "\n".join(lines).strip()
        if body and len(body) < least:
            continue
        groups: list[list[str]] = [[]]
        held = 0
        for part in body.split("\n\n") if len(body) > most else [body]:
            if groups[-1] and held + len(part) > most:
                groups.append([])
                held = 0
            groups[-1].append(part)
            held += len(part)
        if len(groups) == 1:
            out.append((title, level, path, body))
        else:
            out += [(f"{title} (Part {k})", level, f"{path}.{k}", "\n\n".join(g)) for k, g in enumerate(groups, 1)]
    return out


def _section_batches(least: int, most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc, n, *section) for doc, text in zip(frame["document_id"], frame["text"]) for n, section in enumerate(split_sections(text, least, most))]
            yield pd.DataFrame(rows, columns=["document_id", "position", "section_title", "section_level", "section_path", "content"])

    return run


def sections_of(documents: DataFrame, least: int = 100, most: int = 8_000) -> DataFrame:
    full = documents.where(F.col("text").isNotNull()).select("document_id", "text")
    return full.mapInPandas(_section_batches(least, most), "document_id long, position int, section_title string, section_level int, section_path string, content string")
