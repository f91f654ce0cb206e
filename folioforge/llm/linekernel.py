"""Vectorised reading of texts as lines, blocks, sentences and tokens.

A slice of texts becomes one array of code points.  Everything after that is
array arithmetic: lines and their kinds (blank, code, table, heading, list item,
text), blocks of lines without a blank line between, tokens with a 64-bit hash,
and sentences as ranges of tokens.  No Python object is made per line or token.

A token is a run of letters and digits (joined by ``_ . - '`` inside), a code span
or one sign, in lower case.  Numbers have one hash, identifiers and code spans
another, and the name that a site calls itself a third.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from folioforge.llm import textkernel as tk

_ALNUM, _SPACE, _DIGIT, _UPPER, _LOWER = 1, 2, 4, 8, 16
NUMBER, IDENTIFIER, BRAND = (np.uint64(0xA0761D6478BD642F + k) for k in range(3))
#: A sentence shorter than this belongs to the next one.
SHORT_SENTENCE = 20
#: Several sentences in a line of at least this many characters are running text.
RUNNING_CHARS = 110
#: Cased letters end below this code point.
_CASED = 0x1F000

BLANK, CODE, TABLE, HEADING, LIST, TEXT = range(6)


#: Fields of a token's counts: digits, signs of an identifier (one hyphen is half a sign), dots.
_FIELD = 21
_HALF, _DOT = 1 << _FIELD, 1 << 2 * _FIELD


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(property bits, lower case, fields) of each code point."""
    flags = tk.word_table().astype(np.uint8)
    fields = np.zeros(0x110000, dtype=np.uint64)
    fields[ord("_")], fields[ord("-")], fields[ord(".")] = 2 * _HALF, _HALF, _DOT
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(_CASED):
        ch = chr(c)
        if ch.isspace():
            flags[c] |= _SPACE
        if ch.isdigit():
            flags[c] |= _DIGIT
            fields[c] = 1
        if ch.isupper():
            flags[c] |= _UPPER
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
        elif ch.islower():
            flags[c] |= _LOWER
    return flags, low, fields


def name_hash(word: str) -> int:
    """The hash that ``word`` has as a token."""
    points = np.array([ord(c) for c in word.lower()] or [0], dtype=np.uint64)
    power, _ = tk._powers(len(points) + 1)
    total = ((points + np.uint64(1)) * power[: len(points)]).sum(dtype=np.uint64)
    return int(tk.mix(np.array([total + np.uint64(len(points))], dtype=np.uint64))[0])


def _any(points: np.ndarray, signs: str) -> np.ndarray:
    out = points == ord(signs[0])
    for sign in signs[1:]:
        out |= points == ord(sign)
    return out


class Lines:
    """Lines, blocks, sentences and tokens of some texts; ``brands`` has the token hash of each text's site name."""

    def __init__(self, texts: list[str], brands: np.ndarray):
        joined = "\x00".join(t.replace("\x00", " ") if "\x00" in t else t for t in texts) + "\x00"
        p = np.frombuffer((joined + " " * 8).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(p) - 8
        flags_of, low, fields = _tables()
        flags = flags_of[p]
        edges = np.flatnonzero((p[:n] == 10) | (p[:n] == 0))
        self.begin = np.concatenate(([0], edges[:-1] + 1))
        self.text = np.cumsum(p[edges] == 0) - (p[edges] == 0)
        first_line = np.searchsorted(self.text, np.arange(len(texts)))
        self.number = np.arange(len(edges)) - first_line[self.text]
        self._split(p, flags, low[p], fields[p], edges, n, brands)
        self._kinds(p, flags, edges)
        self._sentences(p)

    def _split(self, p, flags, low, fields, edges, n, brands) -> None:
        """Tokens: start, end, hash, whether a word, line."""
        core = (flags & _ALNUM > 0) | (p == ord("_"))
        inner = _any(p, ".-'’")
        inner[1:-1] &= core[:-2] & core[2:]
        inner[0] = inner[-1] = False
        kind = np.where(core | inner, 1, np.where(flags & _SPACE > 0, 0, 3)).astype(np.int8)
        tick = p == ord("`")
        if tick.any():
            seen = np.cumsum(tick)
            base = np.concatenate(([0], seen[edges[:-1]]))
            odd = np.zeros(len(p), dtype=bool)
            odd[:n] = (seen[:n] - np.repeat(base, np.diff(np.concatenate(([0], edges + 1))))) & 1 > 0
            kind[tick | odd] = 2
        kind[edges] = 0
        kind[n:] = 0
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 3)) + 1
        start = np.concatenate(([0], change))
        end = np.concatenate((change, [len(kind)]))
        keep = kind[start] > 0
        start, end = start[keep], end[keep]
        power, inverse = tk._powers(len(p) + 1)
        total = np.zeros(len(p) + 1, dtype=np.uint64)
        low = low.astype(np.uint64)
        low += np.uint64(1)
        low *= power[: len(p)]
        np.cumsum(low, out=total[1:])
        size = end - start
        self.hash = tk.mix((total[end] - total[start]) * inverse[start] + size.astype(np.uint64))
        # a capital after a small letter
        fields[1:] += (((flags[1:] & _UPPER) > 0) & ((flags[:-1] & _LOWER) > 0)) * np.uint64(2 * _HALF)
        np.cumsum(fields, out=total[1:])
        counts = total[end] - total[start]
        digits, signs, dots = counts & np.uint64(_HALF - 1), (counts >> np.uint64(_FIELD)) & np.uint64(_HALF - 1), counts >> np.uint64(2 * _FIELD)
        plain = kind[start] == 1
        number = plain & (digits > 0) & (signs < 2)
        name = (kind[start] == 2) | (plain & ~number & (size > 1) & ((signs > 1) | (dots > 0)))
        self.hash[number] = NUMBER
        self.hash[name] = IDENTIFIER
        self.line = np.searchsorted(edges, start)
        own = self.hash == brands[self.text[self.line]]
        self.hash[own] = BRAND
        self.word = (plain & ~number & ~name) | own
        self.start, self.end = start, end
        self.first = np.searchsorted(self.line, np.arange(len(edges) + 1))

    def _kinds(self, p, flags, edges) -> None:
        """Kind of each line, tokens of its mark, and blocks."""
        lines = len(edges)
        full = self.first[1:] > self.first[:-1]
        at = np.where(full, self.start[np.minimum(self.first[:-1], len(self.start) - 1)] if len(self.start) else 0, 0)
        c = [p[at + k] for k in range(3)]
        fence = full & ((c[0] == 96) | (c[0] == 126)) & (c[1] == c[0]) & (c[2] == c[0])
        before = np.cumsum(fence) - fence
        first_line = np.searchsorted(self.text, self.text)
        fenced = (before - before[first_line]) & 1 > 0
        after = at + 1
        for _ in range(5):
            after = after + (p[after] == ord("#"))
        heading = full & (c[0] == ord("#")) & (flags[after] & _SPACE > 0)
        bullet = full & _any(c[0], "-*+•") & (flags[at + 1] & _SPACE > 0)
        quote = full & (c[0] == ord(">"))
        last = np.minimum(self.first[:-1], max(len(self.end) - 1, 0))
        stop = self.end[last] if len(self.end) else at
        digits = np.concatenate(([0], np.cumsum(flags & _DIGIT > 0)))
        numbered = full & (digits[stop] - digits[at] == stop - at) & _any(p[np.minimum(stop, len(p) - 1)], ".)、")
        self.kind = np.full(lines, TEXT, dtype=np.int8)
        self.kind[bullet | quote | numbered] = LIST
        self.kind[heading] = HEADING
        self.kind[full & (c[0] == ord("|"))] = TABLE
        self.kind[fence | fenced] = CODE
        self.kind[~full] = BLANK
        self.mark = np.where(numbered, 2, (bullet | quote).astype(np.int64))
        flow = self.kind >= HEADING
        opens = flow.copy()
        opens[1:] &= ~(flow[:-1] & (self.text[1:] == self.text[:-1]))
        self.block = np.where(flow, np.cumsum(opens) - 1, -1)
        self.block_first = np.flatnonzero(opens)
        ends = flow.copy()
        ends[:-1] &= ~(flow[1:] & (self.text[1:] == self.text[:-1]))
        self.block_last = np.flatnonzero(ends)

    def _sentences(self, p) -> None:
        """Sentences of lines of text and list items: first and last token, line, place in the line."""
        flow = (self.kind == LIST) | (self.kind == TEXT)
        begin = self.first[:-1] + np.where(self.kind == LIST, self.mark, 0)
        body = flow & (begin < self.first[1:])
        if not body.any():
            self.s_first = self.s_last = self.s_line = np.empty(0, np.int64)
            self.s_place = np.empty(0, np.int64)
            self.running = np.zeros(len(self.kind), dtype=bool)
            return
        starts = np.zeros(len(self.start), dtype=bool)
        ends_with = p[self.end - 1]
        wide = _any(ends_with, "。！？")
        stop = _any(ends_with, ".!?") & (self.end - self.start == 1)
        starts[1:] = wide[:-1] | (stop[:-1] & (self.start[1:] > self.end[:-1]))
        inside = np.arange(len(self.start)) > begin[self.line]
        starts &= inside & body[self.line]
        starts[begin[body]] = True
        for again in (True, False):
            first = np.flatnonzero(starts)
            line = self.line[first]
            last = np.minimum(np.append(first[1:], len(self.start)), self.first[line + 1]) - 1
            if again:
                short = (self.end[last] - self.start[first] < SHORT_SENTENCE) & stop[last]
                drop = np.flatnonzero(short[:-1] & (line[1:] == line[:-1])) + 1
                starts[first[drop]] = False
        self.s_first, self.s_last, self.s_line = first, last, line
        self.s_place = np.arange(len(first)) - np.searchsorted(line, line)
        count = np.bincount(line, minlength=len(self.kind))
        final = np.maximum(self.first[1:] - 1, 0)
        closed = (wide | stop)[final] if len(self.start) else np.zeros(len(self.kind), dtype=bool)
        chars = self.end[final] - self.start[np.minimum(self.first[:-1], len(self.start) - 1)]
        self.several = body & (count > 1) & closed
        self.running = self.several & (chars > RUNNING_CHARS)
