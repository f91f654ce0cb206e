"""Text decoded with a wrong character encoding: finding and restoring it (problem 10).

A hidden Markov model labels the characters of a text.  One state is clean text;
each encoding pair (true, wrong) has a state whose characters are what the wrong
codec makes of the true codec's bytes.  A clean character has its log frequency
over the corpus; in the state of a pair, the characters of one encoded original
have together the log frequency of that original.  Frequencies are counted over
all documents, without characters that form a valid sequence of some pair, so a
garbled share of the corpus doesn't pass for clean text.  Entering a state costs
``COST``; ASCII inside a span costs a little, a character that the pair can't
produce costs much.

Paths that leave the clean state only once are scored for whole batches with
prefix sums.  Clean is the best path exactly if no such span scores above zero,
so only texts with one go through Viterbi.  Each labelled span then gets its
state's inverse transform; this repeats until nothing is garbled or a round changes
nothing, so text that was garbled several times comes back as a whole.

U+FFFD, and what it becomes as UTF-8 read as GBK, is damage without an inverse.

Defined results: null and empty texts are clean; repeated rows count once; a span
that can't be decoded keeps its characters; ``restored`` is true only if no garbled
span and no damage without an inverse is left in the text that comes out; ``lost``
counts such damage there, ``spans`` the garbled spans of the text as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import textkernel as tk

#: Costs of entering a state: one garbled character of UTF-8 is two or three
#: characters and may stand alone, other garbled text comes as whole words.
ENTER, ENTER_WORDS = 6.0, 14.0
ASCII_LETTER, ASCII_OTHER, FOREIGN = 0.6, 0.1, 14.0
#: In states of single-byte or double-byte originals a word has no ASCII letters.
ASCII_LETTER_WORDS = 4.0
UNLIKELY = 8.0
#: Keeps a path from entering or leaving a state inside one sequence.
WHOLE = 1000.0

#: (true encoding, wrong encoding) of the states.
PAIRS = (
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp850"),
    ("utf-8", "cp437"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp1251"),
    ("cp1251", "cp1252"),
    ("shift_jis", "cp1252"),
)

#: Blocks that originals of garbled text come from (first, last), besides emoji.
LIKELY = ((0xA0, 0x17F), (0x384, 0x3CE), (0x400, 0x45F), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x2500, 0x25FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF))
COST = np.array([ENTER if true == "utf-8" else ENTER_WORDS for true, _ in PAIRS])

#: Originals that don't stand alone among letters: signs of East Asian scripts (first, last).
NEVER_ALONE = ((0x3000, 0x9FFF), (0xFF00, 0xFFEF))

LOST = "�"
#: U+FFFD twice in UTF-8, read as GBK.
LOST_GBK = "锟斤拷"
_NONE = 0xFFFF


@lru_cache(maxsize=32)
def byte_of(codec: str) -> np.ndarray:
    """Byte that the codec decodes to each code point below 0x10000; holes of the codec map to C1 controls."""
    table = np.full(0x10000, _NONE, dtype=np.uint16)
    for b in range(256):
        try:
            c = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            c = b
        table[c] = b
    return table


@lru_cache(maxsize=4)
def char_of(codec: str) -> np.ndarray:
    """Code point of each byte (single-byte codec) or byte pair (double-byte), 0 if there is none."""
    out = np.zeros(0x10000 if codec == "shift_jis" else 256, dtype=np.uint32)
    for b in range(len(out)):
        raw = bytes([b]) if b < 256 else bytes([b >> 8, b & 255])
        try:
            text = raw.decode(codec)
        except UnicodeDecodeError:
            continue
        if len(text) == 1:
            out[b] = ord(text)
    return out


def _likely() -> np.ndarray:
    ok = np.zeros(0x110000, dtype=bool)
    for a, b in LIKELY:
        ok[a : b + 1] = True
    return ok


class Batch:
    """The non-ASCII characters of some texts, with what lies between them."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer(("\x00".join(t.replace("\x00", " ") if "\x00" in t else t for t in texts) + "\x00" * 5).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.points = points
        self.at = np.flatnonzero(points >= 0x80)
        self.text = np.searchsorted(np.flatnonzero(points == 0), self.at)
        lower = points | 0x20
        self.letters = np.concatenate(([0], np.cumsum((lower >= 97) & (lower <= 122))))
        self.chars = points[self.at]

    def sequences(self, pair: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per non-ASCII character: the original of the sequence that starts here (0: none), its length, and whether it is inside one."""
        true, wrong = pair
        p, at = self.points, self.at
        table = byte_of(wrong)

        def byte(k: int) -> np.ndarray:
            c = p[at + k]
            return np.where(c < 0x10000, table[np.minimum(c, 0xFFFF)], _NONE).astype(np.int64)

        b0 = byte(0)
        original = np.zeros(len(at), dtype=np.int64)
        length = np.ones(len(at), dtype=np.int64)
        if true == "utf-8":
            b1, b2, b3 = byte(1), byte(2), byte(3)
            c1, c2, c3 = ((b & 0xC0) == 0x80 for b in (b1, b2, b3))
            c1, c2, c3 = c1 & (b1 < 256), c2 & (b2 < 256), c3 & (b3 < 256)
            two = (b0 >= 0xC2) & (b0 <= 0xDF) & c1
            three = (b0 >= 0xE0) & (b0 <= 0xEF) & c1 & c2
            four = (b0 >= 0xF0) & (b0 <= 0xF4) & c1 & c2 & c3
            original[two] = (((b0 & 31) << 6) | (b1 & 63))[two]
            wide = ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)
            three &= (wide >= 0x800) & ((wide < 0xD800) | (wide > 0xDFFF))
            original[three] = wide[three]
            far = ((b0 & 7) << 18) | ((b1 & 63) << 12) | ((b2 & 63) << 6) | (b3 & 63)
            four &= (far >= 0x10000) & (far <= 0x10FFFF)
            original[four] = far[four]
            length[two], length[three], length[four] = 2, 3, 4
        elif true == "shift_jis":
            b1 = byte(1)
            pairs = char_of(true)
            lead = (b0 < 256) & (((b0 >= 0x81) & (b0 <= 0x9F)) | ((b0 >= 0xE0) & (b0 <= 0xFC))) & (b1 < 256)
            original[lead] = pairs[((b0 << 8) | b1)[lead]]
            length[original > 0] = 2
        else:
            single = (b0 >= 0x80) & (b0 < 256)
            original[single] = char_of(true)[b0[single]]
        return original, length, self._inside(original, length)

    def _inside(self, original: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Characters that belong to a sequence that starts before them; overlapping starts are dropped in ``original``."""
        starts = np.flatnonzero(original > 0)
        inside = np.zeros(len(self.at), dtype=bool)
        if len(starts) and length[starts].max() > 1:
            stop = self.at[starts] + length[starts]
            clash = np.flatnonzero(self.at[starts[1:]] < stop[:-1])
            # lead and continuation bytes differ in UTF-8, so clashes only arise for double bytes
            if len(clash):
                keep, end = [], -1
                for s, e in zip(starts, stop):
                    if self.at[s] >= end:
                        keep.append(s)
                        end = e
                drop = np.setdiff1d(starts, np.array(keep, dtype=np.int64))
                original[drop] = 0
                length[drop] = 1
                starts = np.array(keep, dtype=np.int64)
                stop = self.at[starts] + length[starts]
            last = np.zeros(len(self.at), dtype=np.int64)
            last[starts] = stop
            inside = (np.maximum.accumulate(last) > self.at) & (original == 0)
        return inside

    def scores(self, pair: tuple[str, str], logp: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per character: its score in the pair's state over the clean state, the cost of the gap before it,
        whether it continues a sequence, and where what it is part of ends."""
        original, length, inside = self.sequences(pair)
        score = np.full(len(self.at), -FOREIGN)
        start = original > 0
        clean = logp[self.chars].astype(np.float64)
        spent = clean.copy()
        for k in (1, 2, 3):
            longer = start & (length > k)
            spent[longer] += logp[self.points[self.at[longer] + k]]
        score[start] = logp[original[start]] - spent[start] - np.where(likely[original[start]], 0.0, UNLIKELY)
        score[start & self._alone(original, length)] -= UNLIKELY
        score[inside] = 0.0
        if pair[1] in ("cp850", "cp437"):
            score[start & self._drawn(start, inside, length)] = -FOREIGN
        gap = np.zeros(len(self.at))
        # an ASCII second byte belongs to its sequence, not to the gap
        end = np.where(start, self.at + length, self.at + 1)
        prev = np.maximum(end[:-1], self.at[:-1] + 1)
        prev = np.minimum(prev, self.at[1:])
        letters = self.letters[self.at[1:]] - self.letters[prev]
        others = self.at[1:] - prev - letters
        gap[1:] = letters * (ASCII_LETTER if pair[0] == "utf-8" else ASCII_LETTER_WORDS) + others * ASCII_OTHER
        gap[1:][self.text[1:] != self.text[:-1]] = 1e6
        several = np.flatnonzero(start & np.append(inside[1:], False))
        final = np.searchsorted(self.at, self.at[several] + length[several]) - 1
        score[several] -= WHOLE
        score[final] += WHOLE
        return score, gap, inside, end

    def _alone(self, original: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sequences of an East Asian sign with no other right before or after it."""
        kind = np.zeros(len(self.at), dtype=bool)
        for a, b in NEVER_ALONE:
            kind |= (original >= a) & (original <= b)
        starts = np.zeros(len(self.points) + 8, dtype=bool)
        ends = np.zeros(len(self.points) + 8, dtype=bool)
        starts[self.at[kind]] = True
        ends[(self.at + length)[kind]] = True
        return kind & ~starts[self.at + length] & ~ends[self.at]

    def _drawn(self, start: np.ndarray, inside: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Starts next to a box-drawing character outside of any sequence: a drawing, not text."""
        box = (self.points >= 0x2500) & (self.points <= 0x257F)
        free = np.zeros(len(self.points), dtype=bool)
        free[self.at[~start & ~inside]] = True
        free &= box
        return free[np.maximum(self.at - 1, 0)] | free[np.minimum(self.at + length, len(self.points) - 1)]

    def lost(self) -> np.ndarray:
        """Characters that are damage without an inverse."""
        c, p, at = self.chars, self.points, self.at
        a, b, d = (ord(x) for x in LOST_GBK)
        after, before = p[at + 1], p[np.maximum(at - 1, 0)]
        return (c == ord(LOST)) | ((c == a) & (after == b)) | ((c == b) & ((before == a) | (after == d))) | ((c == d) & (before == b))


def best_span(score: np.ndarray, gap: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Best score of a span that ends at each character."""
    before = np.cumsum(score) - score - np.cumsum(gap)
    return before + score - np.minimum.accumulate(np.where(inside, np.inf, before))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0x110000, dtype=np.int64)
    total = 0
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for a, b in tk.slices(texts):
            part = Batch(texts[a:b])
            total += len(part.points)
            free = ~part.lost()
            for pair in PAIRS:
                if pair[0] == "utf-8":
                    original, _, inside = part.sequences(pair)
                    free &= ~((original > 0) | inside)
            counts += np.bincount(part.chars[free], minlength=len(counts))
    counts[0] = total
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["point", "n"])


def character_statistics(texts: DataFrame) -> np.ndarray:
    """Log frequency of each code point over all texts (as many numbers as Unicode has code points)."""
    table = texts.mapInArrow(_count_batches, "point int, n long").groupBy("point").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(0x110000, dtype=np.float64)
    counts[table.column("point").to_numpy()] = table.column("n").to_numpy()
    total = max(counts[0], 1.0)
    counts[0] = 0
    out = np.log((counts + 0.3) / (total + 1.0))
    out[:0x80] = np.log(1 / 60)
    return out.astype(np.float32)


def viterbi(score: np.ndarray, gap: np.ndarray, inside_of: np.ndarray) -> np.ndarray:
    """Best state of each character of one text (-1: clean); the arrays have a row for each state."""
    states, n = score.shape
    back = np.zeros((n, states + 1), dtype=np.int8)
    clean = 0.0
    inside = np.full(states, -np.inf)
    for t in range(n):
        # on a tie the span goes on, so that it ends with its last sequence
        leave = int(np.argmax(inside))
        new_clean, from_clean = (clean, -1) if clean > inside[leave] else (inside[leave], leave)
        stay = inside - gap[:, t]
        enter = new_clean - COST - 2 * WHOLE * inside_of[:, t]
        keep = stay >= enter
        back[t, :states] = np.where(keep, 1, 0)
        back[t, states] = from_clean
        inside = np.where(keep, stay, enter) + score[:, t]
        clean = new_clean
    labels = np.full(n, -1, dtype=np.int8)
    best = int(np.argmax(inside))
    state = best if inside[best] > clean else -1
    for t in range(n - 1, -1, -1):
        labels[t] = state
        if state < 0 or not back[t, state]:
            state = int(back[t, states])
    return labels


def _invert(text: str, pair: tuple[str, str]) -> str:
    """The original of a span, or the span itself if it can't be decoded."""
    table = byte_of(pair[1])
    raw = bytearray()
    for ch in text:
        b = table[ord(ch)] if ord(ch) < 0x10000 else _NONE
        if b == _NONE:
            return text
        raw.append(int(b))
    try:
        return raw.decode(pair[0])
    except UnicodeDecodeError:
        return text


def label(texts: list[str], logp: np.ndarray, likely: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]], int]]:
    """(text, its spans as (start, end, state), lost characters) of the texts that aren't clean."""
    batch = Batch(texts)
    if not len(batch.at):
        return
    parts = [batch.scores(pair, logp, likely) for pair in PAIRS]
    hot = np.zeros(len(texts), dtype=bool)
    for (score, gap, inside, _), cost in zip(parts, COST):
        hot[batch.text[best_span(score, gap, inside) > cost]] = True
    lost = np.bincount(batch.text[batch.lost()], minlength=len(texts))
    begins = np.concatenate(([0], np.flatnonzero(batch.points == 0) + 1))
    edge = np.searchsorted(batch.text, np.arange(len(texts) + 1))
    for i in np.flatnonzero(hot | (lost > 0)):
        spans: list[tuple[int, int, int]] = []
        if hot[i]:
            a, z = edge[i], edge[i + 1]
            labels = viterbi(*(np.stack([part[k][a:z] for part in parts]) for k in range(3)))
            where = batch.at[a:z] - begins[i]
            for t in np.flatnonzero(labels >= 0):
                state = int(labels[t])
                stop = int(parts[state][3][a + t] - begins[i])
                if spans and spans[-1][2] == state and t > 0 and labels[t - 1] == state:
                    spans[-1] = (spans[-1][0], max(stop, spans[-1][1]), state)
                else:
                    spans.append((int(where[t]), stop, state))
        yield int(i), spans, int(lost[i])


def _pieces(text: str, span: tuple[int, int, int]) -> str:
    start, end, state = span
    part = text[start:end]
    whole = _invert(part, PAIRS[state])
    if whole != part:
        return whole
    # something in between stops the decoding: invert maximal runs without ASCII
    out, run = [], ""
    for ch in part + "\x00":
        if ord(ch) >= 0x80:
            run += ch
        else:
            out.append(_invert(run, PAIRS[state]) if run else "")
            out.append(ch)
            run = ""
    return "".join(out)[:-1]


def _label_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, likely = model.value, _likely()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for a, b in tk.slices(texts):
                found = {i: [s, n, texts[a + i]] for i, s, n in label(texts[a:b], logp, likely)}
                names = {i: sorted({"/".join(PAIRS[k]) for _, _, k in s}) for i, (s, _, _) in found.items()}
                spans = {i: len(s) for i, (s, _, _) in found.items()}
                todo = [i for i, (s, _, _) in found.items() if s]
                left: set[int] = set()
                before = {i: {texts[a + i]} for i in todo}
                while todo:
                    changed = []
                    for i in todo:
                        s, _, text = found[i]
                        for span in reversed(s):
                            text = text[: span[0]] + _pieces(text, span) + text[span[1] :]
                        # an inverse that brings back an earlier text would go on for ever
                        if text in before[i]:
                            left.add(i)
                        else:
                            before[i].add(text)
                            found[i][2] = text
                            changed.append(i)
                    again = {changed[k]: (s, n) for k, s, n in label([found[i][2] for i in changed], logp, likely)} if changed else {}
                    for i in changed:
                        found[i][:2] = again.get(i, ([], 0))
                    todo = [i for i in changed if found[i][0]]
                rows += [(ids[a + i], spans[i], n, names[i], text, n == 0 and i not in left and text != texts[a + i]) for i, (_, n, text) in found.items()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "spans", "lost", "encodings", "text", "restored"])

    return run


def garbled_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, lost, encodings, text, restored) of the documents that hold garbled text; ``text`` is the restored one."""
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    model = documents.sparkSession.sparkContext.broadcast(character_statistics(base.select("text")))
    # plain ASCII needs no model
    some = base.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return some.mapInArrow(_label_batches(model), "doc_id long, spans int, lost int, encodings array<string>, text string, restored boolean").dropDuplicates(["doc_id", "text"])
