"""Main body of pages by equivalence-class template deduction (problem 2).

Pages of one host come from templates.  A token's role is its place in a line among
the lines of its host that open (or close, or open and close) with the same tokens,
by their first sentence or, if they have several, by the line's end.
All tokens of a line have a role, however long it is: how many of the same token stand
before it in the line, which a slot of any length leaves as it is.  Those near the
line's ends have their places counted from the start and from the end as roles, too.
A role that occurs as often as such a group has lines occurs in exactly those lines: it shares the group's occurrence vector
over the pages.  The roles of one vector form an equivalence class; nested by their
place they give a template, fixed tokens with slots between them.  The same classes
are deduced over all hosts together, for hosts that show a template too seldom.

A class is valid, and its template page furniture, by structure alone; there is no
list of words:

* it stands on at least ``MIN_PAGES`` pages beside as many different texts (their
  longest lines count), so it doesn't depend on what the page is about;
* its opening isn't that of sentences inside of running text or of list items
  (templates of prose are);
* it has two fixed tokens or is fixed all through, with a word among them; in a line
  of several sentences half of the tokens are fixed.

What the templates don't cover, the slots that remain, is the main body.  A block of
lines without a blank line between is one unit: the entries of a menu are slots of
its template and go with it, but running text doesn't go with another line.  Code,
tables and headings are never candidates, list items only if they are a link as a
whole, and a line that ends with a colon before code, a table or a list isn't either.

Work is three scans of the texts: counts of groups, roles of the groups that may be
valid, and the lines of valid classes.  Between the scans only ids of groups
travel, as Bloom filters of a fixed size; what they let through by chance is
removed by the joins that follow.

Defined results: only documents with an ``html_path`` count; lines count from 0 at
LF; blank lines are never listed; copies of a row count once; null contents and
documents without a host (they form one group) are handled like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import linekernel as lk
from folioforge.llm import textkernel as tk
from folioforge.llm.copies import once
from folioforge.llm.sitelines import host
from folioforge.plans.session import cut

#: Different pages of a template, and different texts beside it.
MIN_PAGES = 10
#: Most sentences inside of running text that open or close alike, for each line of a group.
PROSE_SHARE = 0.1
#: Share of a group's lines in which a role must occur, and of the roles that a line must have (a few lines are damaged).
SAME_VECTOR = 0.9
#: Share of fixed tokens in lines of several sentences, and of the whole line's roles that a line must have if its ends fit.
FIXED_SHARE = 0.5
#: Places counted from a line's start and from its end, beside the roles of all tokens.
PREFIX, SUFFIX = 12, 6
#: Roles of all tokens have this and the number of the same before them as their place.
WHOLE = PREFIX + SUFFIX
#: log2 of the bits of a filter of group ids (16 MB).
FILTER_BITS = 27
#: Rows that a worker gathers before it combines them.
FLUSH = 1_000_000
BROADCAST_DOCUMENTS, BROADCAST_TEMPLATES = 1_000_000, 50_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SITE = np.uint64(0xD1B54A32D192ED03)
#: One probe of the filter for each.
_SALTS = np.arange(1, 5, dtype=np.uint64) * _GOLD
_LINES, _PAGE, _NEIGHBOUR, _TOKENS, _SEVERAL = -1, -2, -3, -4, -5


@lru_cache(maxsize=65_536)
def _site(site: str) -> tuple[int, int]:
    """(hash of a host, token hash of what it calls itself: its longest label but the last)."""
    brand = max((site or "").split(".")[:-1], key=len, default="")
    return lk.name_hash("\x01" + (site or "")), lk.name_hash(brand) if brand else 0


def _combine(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        out = tk.mix(out * _GOLD + column.astype(np.uint64) + _SITE)
    return out


def _keys(page: lk.Lines, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, key): all tokens of short ones; else the first two, first and third, first and last, and the last two tokens; of a line of several sentences its last two, too."""
    first, last = page.s_first[sentences], page.s_last[sentences]
    n = last - first + 1
    h = page.hash
    short = n < 4
    at = np.flatnonzero(short)
    a, size = first[at], n[at]
    whole = _combine(size, h[a], np.where(size > 1, h[np.minimum(a + 1, len(h) - 1)], np.uint64(0)), np.where(size > 2, h[np.minimum(a + 2, len(h) - 1)], np.uint64(0)))
    rest = np.flatnonzero(~short)
    a, z = first[rest], last[rest]
    kinds = [_combine(np.full(len(a), 4 + k), h[b], h[c]) for k, (b, c) in enumerate(((a, a + 1), (a, a + 2), (a, z), (z - 1, z)))]
    # how a line closes, against how sentences before the last do
    closing = np.flatnonzero(np.where(page.s_able[sentences], page.s_more[sentences], page.s_more[sentences] | (page.kind[page.s_line[sentences]] == lk.LIST)) & ~short)
    z = np.where(page.s_able[sentences], page.first[page.s_line[sentences] + 1] - 1, page.s_last[sentences])[closing]
    kinds.append(_combine(np.full(len(z), 4 + len(kinds)), h[z - 1], h[z]))
    return np.concatenate([at, rest, rest, rest, rest, closing]), np.concatenate([whole, *kinds])


class Page(lk.Lines):
    """The lines of some texts that may belong to a template, and the sentences that speak against one."""

    def __init__(self, texts: list[str], brands: np.ndarray):
        super().__init__(texts, brands)
        lines = len(self.kind)
        final = np.maximum(self.first[1:] - 1, 0)
        link = np.zeros(lines, dtype=bool)
        colon = np.zeros(lines, dtype=bool)
        if len(self.hash):
            begin = np.minimum(self.first[:-1] + self.mark, len(self.hash) - 1)
            link = (self.kind == lk.LIST) & (self.hash[begin] == _SIGNS["["]) & (self.hash[final] == _SIGNS[")"])
            colon = (self.kind == lk.TEXT) & ((self.hash[final] == _SIGNS[":"]) | (self.hash[final] == _SIGNS["："]))
        # the next line that isn't blank
        full = np.flatnonzero(self.kind != lk.BLANK)
        place = np.searchsorted(full, np.arange(lines), "right")
        after = full[np.minimum(place, len(full) - 1)] if len(full) else np.zeros(lines, np.int64)
        has_after = (place < len(full)) & (self.text[after] == self.text)
        leads = colon & has_after & np.isin(self.kind[after], (lk.CODE, lk.TABLE, lk.LIST)) & (self.block[after] != self.block)
        able = ((self.kind == lk.TEXT) & ~leads) | link
        self.s_able = able[self.s_line] & (self.s_place == 0)
        self.s_inside = ~self.s_able & ((self.s_place > 0) | (self.kind[self.s_line] == lk.LIST)) & ~leads[self.s_line]
        # another sentence of the line follows
        self.s_more = np.append(self.s_line[1:] == self.s_line[:-1], False) if len(self.s_line) else np.zeros(0, dtype=bool)
        # what stands beside a block: the longest line of the text outside of it
        of = self.block >= 0
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * _GOLD ^ (self.hash >> np.uint64(29)), dtype=np.uint64)))
        content = total[self.first[1:]] - total[self.first[:-1]]
        longest = self._longest(np.ones(lines, dtype=bool), len(texts))
        top = self.block[longest[self.text]]
        second = self._longest((self.block < 0) | (self.block != top), len(texts))
        beside = np.where(of & (self.block == top), second[self.text], longest[self.text])
        self.neighbour, self.has_neighbour = content[beside], beside >= 0
        self.block_runs = np.zeros(int(self.block.max(initial=-1)) + 1, dtype=bool)
        self.block_runs[self.block[self.running & of]] = True

    def _longest(self, among: np.ndarray, texts: int) -> np.ndarray:
        """The line with most tokens of each text among some lines (-1: none)."""
        at = np.flatnonzero(among & (self.kind != lk.BLANK))
        at = at[np.lexsort((at, self.first[at + 1] - self.first[at], self.text[at]))]
        out = np.full(texts, -1, dtype=np.int64)
        out[self.text[at]] = at
        return out

    def body(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first token, end) of lines without their list marks."""
        return self.first[lines] + np.where(self.kind[lines] == lk.LIST, self.mark[lines], 0), self.first[lines + 1]

    def before(self, lines: np.ndarray) -> np.ndarray:
        """For each token of the texts, if its line is among ``lines``: how many of the same stand before it in the line's body."""
        among = np.zeros(len(self.kind), dtype=bool)
        among[lines] = True
        at = np.flatnonzero(among[self.line])
        at = at[at >= self.body(self.line[at])[0]]
        # equal tokens of a line side by side, in their order
        at = at[np.lexsort((self.hash[at], self.line[at]))]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (self.hash[at[1:]] != self.hash[at[:-1]]) | (self.line[at[1:]] != self.line[at[:-1]])
        out = np.zeros(len(self.hash), dtype=np.int64)
        out[at] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return out

    def roles(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``lines``, place, token index) of the roles of whole lines."""
        begin, end = self.body(lines)
        which, place, token = [], [], []
        for k in range(PREFIX):
            ok = np.flatnonzero(begin + k < end)
            which.append(ok), place.append(np.full(len(ok), k)), token.append(begin[ok] + k)
        for k in range(SUFFIX):
            ok = np.flatnonzero(end - 1 - k >= begin)
            which.append(ok), place.append(np.full(len(ok), PREFIX + k)), token.append(end[ok] - 1 - k)
        size = end - begin
        every = np.repeat(np.arange(len(lines)), size)
        token.append(np.arange(len(every)) + np.repeat(begin - np.cumsum(size) + size, size))
        which.append(every), place.append(WHOLE + self.before(lines)[token[-1]])
        return np.concatenate(which), np.concatenate(place), np.concatenate(token)


_SIGNS = {sign: np.uint64(lk.name_hash(sign)) for sign in "[):："}


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Page]]:
    """(segment ids, host hashes, documents, page) of each slice of the batches: segment_id, host, content, document_id."""
    for batch in batches:
        ids, documents = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
        texts = batch.column(2).to_pylist()
        names = np.array([_site(s) for s in batch.column(1).to_pylist()], dtype=np.uint64).reshape(-1, 2)
        for a, b in tk.slices(texts):
            yield ids[a:b], names[a:b, 0], documents[a:b], Page(texts[a:b], names[a:b, 1])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, lines, inside): how many lines and sentences inside of running text a group of a host has here."""
    held: list[tuple[np.ndarray, ...]] = []

    def combine() -> None:
        ids, keys, lines, inside = (np.concatenate(c) for c in zip(*held))
        unique, at, back = np.unique(ids, return_index=True, return_inverse=True)
        held[:] = [(unique, keys[at], np.bincount(back, weights=lines, minlength=len(unique)).astype(np.int64), np.bincount(back, weights=inside, minlength=len(unique)).astype(np.int64))]

    def flush() -> pa.RecordBatch:
        ids, keys, lines, inside = held.pop()
        return pa.RecordBatch.from_arrays([_signed(ids), _signed(keys), pa.array(lines), pa.array(inside)], names=["id", "key", "lines", "inside"])

    for _, sites, _, page in _pages(batches):
        use = np.flatnonzero(page.s_able | page.s_inside)
        if not len(use):
            continue
        which, key = _keys(page, use)
        sentence = use[which]
        able = page.s_able[sentence]
        ids = _combine(key, sites[page.text[page.s_line[sentence]]])
        held.append((ids, key, able.astype(np.int64), (~able).astype(np.int64)))
        if sum(len(h[0]) for h in held) > FLUSH:
            combine()
            if len(held[0][0]) > FLUSH // 2:
                yield flush()
    if held:
        combine()
        yield flush()


def _filter_bits(ids: np.ndarray) -> Iterator[np.ndarray]:
    for salt in _SALTS:
        yield (tk.mix(ids.astype(np.uint64) + salt) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(np.concatenate([b for b in _filter_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))]))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])


def id_filter(ids: DataFrame):
    """A Bloom filter of the ids, shared with the workers: its size doesn't depend on their number."""
    table = ids.select("id").mapInArrow(_bit_batches, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(out)


def _passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), dtype=bool)
    for at in _filter_bits(ids):
        ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return ok


def _candidates(page: Page, sites: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, group id) of the lines in groups that the filter lets through, for their host and for all hosts."""
    use = np.flatnonzero(page.s_able)
    if not len(use):
        return use, np.empty(0, np.uint64)
    which, key = _keys(page, use)
    line = page.s_line[use[which]]
    ids = np.concatenate([_combine(key, sites[page.text[line]]), key])
    line = np.concatenate([line, line])
    ok = _passes(words, ids)
    return line[ok], ids[ok]


def _role_batches(shared):
    """(id, place, token, word, n) of the roles of the groups; places below 0 are lines, pages, neighbours and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def combine() -> None:
            ids, place, token, word, n = (np.concatenate(c) for c in zip(*held))
            _, at, back = np.unique(_combine(ids, place.astype(np.int64), token), return_index=True, return_inverse=True)
            held[:] = [(ids[at], place[at], token[at], word[at], np.bincount(back, weights=n, minlength=len(at)).astype(np.int64))]

        def flush() -> pa.RecordBatch:
            ids, place, token, word, n = held.pop()
            return pa.RecordBatch.from_arrays([_signed(ids), pa.array(place.astype(np.int32)), _signed(token), pa.array(word), pa.array(n)], names=["id", "place", "token", "word", "n"])

        for _, sites, documents, page in _pages(batches):
            line, ids = _candidates(page, sites, words)
            if not len(line):
                continue
            which, place, token = page.roles(line)
            held.append((ids[which], place, page.hash[token], page.word[token], np.ones(len(which), np.int64)))
            begin, end = page.body(line)
            alone = page.has_neighbour[line]
            for mark, value, n in (
                (_LINES, np.zeros(len(line), np.uint64), np.ones(len(line), np.int64)),
                (_PAGE, documents[page.text[line]].astype(np.int64).view(np.uint64), np.ones(len(line), np.int64)),
                (_NEIGHBOUR, page.neighbour[line], alone.astype(np.int64)),
                (_TOKENS, np.zeros(len(line), np.uint64), end - begin),
                (_SEVERAL, np.zeros(len(line), np.uint64), page.several[line].astype(np.int64)),
            ):
                some = n > 0
                held.append((ids[some], np.full(int(some.sum()), mark), value[some], np.zeros(int(some.sum()), bool), n[some]))
            if sum(len(h[0]) for h in held) > FLUSH:
                combine()
                if len(held[0][0]) > FLUSH // 2:
                    yield flush()
        if held:
            combine()
            yield flush()

    return run


def _line_batches(shared):
    """(segment_id, first, last, id, has) of the lines in groups that the filter lets through: the lines that go with it, and its roles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for segments, sites, _, page in _pages(batches):
            line, ids = _candidates(page, sites, words)
            if not len(line):
                continue
            which, place, token = page.roles(line)
            order = np.argsort(which, kind="stable")
            role = _combine(place.astype(np.int64), page.hash[token])[order]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(line))))).astype(np.int32)
            block = page.block[line]
            alone = page.block_runs[block]
            first = np.where(alone, page.number[line], page.number[page.block_first[block]])
            last = np.where(alone, page.number[line], page.number[page.block_last[block]])
            has = pa.ListArray.from_arrays(pa.array(offsets), _signed(role))
            yield pa.RecordBatch.from_arrays([pa.array(segments[page.text[line]].astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), _signed(ids), has], names=["segment_id", "first", "last", "id", "has"])

    return run


def _role_hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        role = _combine(batch.column("place").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("token").to_numpy(zero_copy_only=False).view(np.uint64))
        yield batch.append_column("role", _signed(role))


def _page_segments(segments: DataFrame, documents: DataFrame, id_col: str, document_col: str, content_col: str) -> DataFrame:
    """(segment_id, host, content, document_id) of the segments of fetched pages."""
    pages = documents.where(F.col("html_path").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("document_id")).agg(F.min(F.coalesce(host(F.col("url")), F.lit(""))).alias("host"))
    if pages.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS:
        pages = F.broadcast(pages)
    base = segments.select(F.col(id_col).cast("long").alias("segment_id"), F.col(document_col).cast("long").alias("document_id"), F.col(content_col).alias("content"))
    return base.where(F.col("segment_id").isNotNull() & (F.length("content") > 0)).join(pages, "document_id").select("segment_id", "host", "content", "document_id")


def able_groups(base: DataFrame) -> DataFrame:
    """(id) of the groups with enough lines that don't open sentences of running text, of each host and of all hosts."""
    counted = cut(
        base.mapInArrow(_count_batches, "id long, key long, lines long, inside long").groupBy("id").agg(F.first("key").alias("key"), F.sum("lines").alias("lines"), F.sum("inside").alias("inside")), "groups"
    )
    able = (F.col("lines") >= MIN_PAGES) & (F.col("inside") <= PROSE_SHARE * F.col("lines"))
    everywhere = counted.groupBy(F.col("key").alias("id")).agg(F.sum("lines").alias("lines"), F.sum("inside").alias("inside")).where(able).select("id")
    return cut(counted.where(able).select("id").unionByName(everywhere).distinct(), "able")


def templates(base: DataFrame, able: DataFrame) -> DataFrame:
    """(id, ends, whole): the valid equivalence classes; the roles that share the group's vector, of places from the ends and of the whole line."""
    schema = "id long, place int, token long, word boolean, n long"
    counted = base.mapInArrow(_role_batches(id_filter(able)), schema).groupBy("id", "place", "token").agg(F.max("word").alias("word"), F.sum("n").alias("n"))
    counted = cut(counted.join(able, "id", "left_semi"), "roles")
    n = lambda mark: F.sum(F.when(F.col("place") == mark, F.col("n")))
    sizes = counted.where(F.col("place") < 0).groupBy("id").agg(
        n(_LINES).alias("lines"), n(_TOKENS).alias("tokens"), F.coalesce(n(_SEVERAL), F.lit(0)).alias("several"), F.count_if(F.col("place") == _PAGE).alias("pages"), F.count_if(F.col("place") == _NEIGHBOUR).alias("beside")
    )
    sizes = sizes.where((F.col("pages") >= MIN_PAGES) & (F.col("beside") >= MIN_PAGES)).select("id", "lines", (F.col("tokens") / F.col("lines")).alias("tokens"), (F.col("several") >= 0.5 * F.col("lines")).alias("several"))
    roles = counted.where(F.col("place") >= 0).join(sizes, "id").where(F.col("n") >= SAME_VECTOR * F.col("lines"))
    roles = roles.mapInArrow(_role_hash_batches, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in roles.schema) + ", role long")
    # a token of the whole line is counted once, whatever its places from the ends
    grouped = roles.groupBy("id", "tokens", "several").agg(*[F.collect_list(F.when(where, F.col("role"))).alias(c) for c, where in (("ends", F.col("place") < WHOLE), ("whole", F.col("place") >= WHOLE))], F.max("word").alias("word"), F.count_if(F.col("place") >= WHOLE).alias("places"))
    enough = (F.col("places") >= F.least(F.lit(2.0), F.col("tokens"))) & F.col("word")
    return grouped.where(enough & (~F.col("several") | (F.col("places") >= FIXED_SHARE * F.col("tokens")))).select("id", "ends", "whole")


def furniture_lines(segments: DataFrame, documents: DataFrame, id_col: str = "id", document_col: str = "document_id", content_col: str = "content") -> DataFrame:
    """(segment_id, line_no) of the non-blank lines that aren't main body."""
    base = _page_segments(segments, documents, id_col, document_col, content_col)
    found = cut(templates(base, able_groups(base)), "templates")
    shared = id_filter(found)
    if found.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        found = F.broadcast(found)
    lines = base.mapInArrow(_line_batches(shared), "segment_id long, first int, last int, id long, has array<bigint>")
    has = lambda fixed, share: F.size(F.array_except(fixed, "l.has")) <= (1 - share) * F.size(fixed)
    # a token more or less near an end moves the places there, but not the rest
    same = has("f.whole", SAME_VECTOR) | (has("f.ends", SAME_VECTOR) & has("f.whole", FIXED_SHARE))
    hit = lines.alias("l").join(found.alias("f"), (F.col("l.id") == F.col("f.id")) & same, "left_semi").select("segment_id", "first", "last").distinct()
    return hit.select("segment_id", F.explode(F.sequence("first", "last")).alias("line_no")).distinct()


def main_bodies(segments: DataFrame, documents: DataFrame, id_col: str = "id", document_col: str = "document_id", content_col: str = "content") -> DataFrame:
    """(segment_id, body, removed): the content of each segment of a fetched page without furniture."""
    base = once(_page_segments(segments, documents, id_col, document_col, content_col).select("segment_id", "content"), "segment_id", "content")
    gone = cut(furniture_lines(segments, documents, id_col, document_col, content_col).groupBy("segment_id").agg(F.collect_set("line_no").alias("gone")), "gone")
    if gone.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS:
        gone = F.broadcast(gone)
    kept = F.filter(F.split("content", "\n", -1), lambda line, i: ~F.array_contains("gone", i))
    return base.join(gone, "segment_id", "left").select(
        "segment_id", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("body"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed")
    )
