"""Template residue, filler and error-page text in place of content (problem 3).

Character n-gram models of filler, error notices, script notices and unfilled
placeholders start from public examples (``residue_seeds``); the model of natural
prose starts from all texts.  Then the models are refitted on the texts themselves,
without labels (expectation and maximisation): what the models take for residue
leaves the prose model and, where it covers most of a text, joins its class.

Every position of a text has a log likelihood ratio of each residue model against
prose; where its mean over a window is above a threshold the text is residue.  A
text is excluded when residue covers enough of it; a text that explains
placeholders, errors or scripts covers little, since the explanation around is
prose.  Placeholders stand between words of any kind, so their model reads the shape
of a text (words by case, numbers, and all signs as they are) in a narrower window,
and a page with one of them left over is residue whatever else it holds.

Code spans in backticks aren't scored: what stands there is mentioned, not left
over.  Lines of navigation and titles (up to three words) count for a fifth in the
share of coverage, so a page's frame doesn't hide its missing content.

Texts are scored a slice at a time with prefix sums over arrays.

Defined results: null and blank texts and failed requests are no cases; copies of
a row count once; the smallest kind and the largest coverage are kept for rows of
one id with different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import textkernel as tk
from folioforge.llm.residue_seeds import seeds

GRAM = 5
TABLE_BITS = 18
#: Floor of a frequency: a gram that neither model knows says nothing.
FLOOR = 2e-6
CLIP = 4.0
HALF_WINDOW = 12
WINDOW_MEAN = 0.35
#: Share of a text that residue must cover; and so that the text joins its class.
COVERAGE, CERTAIN = 0.25, 0.5
#: Refits on the texts, and the weight of what they find against the examples.
REFITS, OWN_WEIGHT = 3, 0.5
#: The same for placeholders, by shape, and the characters one must cover.
SHAPE_HALF_WINDOW, SHAPE_MEAN, SHAPE_CHARS = 2, 1.2, 5
DELIMITERS = "{}[]<>%@_$"
#: The same for placeholders that are words.
NAMED_HALF_WINDOW, NAMED_CHARS = 4, 10
FRAME_WORDS, FRAME_WEIGHT = 3, 0.2
#: Grams of unseen prose that are taken to stand beside those of the table: a few texts say little.
UNSEEN = 20_000
CLASSES = ("error", "filler", "named", "script")
_NAMED = CLASSES.index("named")
#: A slice has at most so many characters.
SLICE_CHARS = 400_000


@lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(small letter with digits as 0, letter, capital, digit) of each code point."""
    low = np.arange(0x110000, dtype=np.uint32)
    digit = np.zeros(0x110000, dtype=bool)
    capital = np.zeros(0x110000, dtype=bool)
    for c in range(0x1F000):
        ch = chr(c)
        if ch.isdecimal():
            low[c], digit[c] = ord("0"), True
        elif ch.isupper():
            capital[c] = True
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
    return low, tk.word_table() & ~digit, capital, digit


#: Separators between two texts of a slice: more than half a window, so no window sees another text.
_PAD = HALF_WINDOW + 1


class Slice:
    """Some texts as code points, with code spans blanked: letters folded, and the shape of words."""

    def __init__(self, texts: list[str]):
        p = np.frombuffer(("\x00" * _PAD).join([*(t.replace("\x00", " ") if "\x00" in t else t for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        breaks = (p == 0) | (p == 10)
        tick = np.flatnonzero(p == ord("`"))
        if len(tick):
            line = np.searchsorted(np.flatnonzero(breaks), tick)
            place = np.arange(len(tick)) - np.searchsorted(line, line)
            opening = np.flatnonzero((place % 2 == 0) & np.append(line[1:] == line[:-1], False))
            step = np.zeros(len(p) + 1, dtype=np.int8)
            step[tick[opening]] += 1
            step[tick[opening + 1] + 1] -= 1
            p[np.cumsum(step[:-1]) > 0] = 32
        low, letter, capital, digit = _fold()
        self.count = len(texts)
        self.plain, self.text = self._pair(low[p])
        letters, digits = letter[p], digit[p]
        start = letters.copy()
        start[1:] &= ~letters[:-1]
        at = np.flatnonzero(start)
        end = np.flatnonzero(letters & ~np.append(letters[1:], False)) + 1
        capitals = np.concatenate(([0], np.cumsum(capital[p])))
        shout = (capitals[end] - capitals[at] == end - at) & (end - at > 1)
        form = p.copy()
        form[at] = np.where(shout, ord("A"), ord("a"))
        lead = digits.copy()
        lead[1:] &= ~digits[:-1]
        form[lead] = ord("0")
        self.shape, self.shape_text = self._pair(form[(~letters | start) & (~digits | lead)])

    def _pair(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = p == 0
        return p, (np.cumsum(ends) - ends) // _PAD

    @staticmethod
    def grams(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table index of the gram that starts at each place, whether it lies in one text)."""
        n = len(p)
        wide = np.concatenate((p, np.zeros(GRAM, np.uint32))).astype(np.uint64)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(GRAM):
            key *= np.uint64(0x100000001B3)
            key += wide[k : k + n]
        key *= np.uint64(0x9E3779B97F4A7C15)
        ends = np.concatenate(([0], np.cumsum(wide == 0)))
        return (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64), ends[GRAM : n + GRAM] == ends[:n]


def _window(x: np.ndarray, half: int, kind: type) -> np.ndarray:
    """Sum of ``x`` over the window of ``half`` places to either side."""
    n = len(x)
    total = np.zeros(n + 2 * half + 1, dtype=kind)
    np.cumsum(x, out=total[half + 1 : half + 1 + n], dtype=kind)
    total[half + 1 + n :] = total[half + n] if n else 0
    return total[2 * half + 1 :] - total[:n]


def covered(key: np.ndarray, inside: np.ndarray, table: np.ndarray, half: int, least: float, seen: np.ndarray | None = None) -> np.ndarray:
    """Whether each character lies in a gram whose window is likelier residue than prose; ``seen`` counts the grams of each window."""
    seen = _window(inside, half, np.int32) if seen is None else seen
    hot = (_window(table[key] * inside, half, np.float64) > least * seen) & inside
    out = hot.copy()
    for k in range(1, GRAM):
        out[k:] |= hot[:-k]
    return out


@lru_cache(maxsize=1)
def _delimiter() -> np.ndarray:
    out = np.zeros(128, dtype=bool)
    out[[ord(c) for c in DELIMITERS]] = True
    return out


def _longest(span: np.ndarray, text: np.ndarray, count: int, signs: np.ndarray | None) -> np.ndarray:
    """Longest run of ``span`` in each text; with ``signs``, among the runs that hold two of them."""
    edge = np.diff(np.concatenate(([0], span.view(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if signs is not None:
        total = np.concatenate(([0], np.cumsum(signs)))
        keep = total[b] - total[a] >= 2
        a, b = a[keep], b[keep]
    out = np.zeros(count, dtype=np.int64)
    np.maximum.at(out, text[a], b - a)
    return out


def judge(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Slice]:
    """Per text: (share of each class, share of all, characters of the longest placeholder); and the slice."""
    letters, shaped = model
    part = Slice(texts)
    p, text = part.plain, part.text
    key, inside = part.grams(p)
    seen = _window(inside, HALF_WINDOW, np.int32)
    hot = np.stack([covered(key, inside, table, HALF_WINDOW, WINDOW_MEAN, seen) for table in letters])
    some = hot.any(axis=0)
    breaks = (p == 0) | (p == 10)
    weight = ~(breaks | (p == 32) | (p == 9) | (p == 13)) * 1.0
    line = np.cumsum(breaks) - breaks
    solid = weight > 0
    word = solid.copy()
    word[1:] &= ~solid[:-1]
    lines = int(line[-1]) + 1
    frame = (np.bincount(line, weights=word, minlength=lines) <= FRAME_WORDS) & (np.bincount(line, weights=some & ~breaks, minlength=lines) == 0)
    weight[frame[line]] *= FRAME_WEIGHT
    size = np.maximum(np.bincount(text, weights=weight, minlength=part.count), 1.0)
    share = np.stack([np.bincount(text, weights=weight * h, minlength=part.count) / size for h in hot])
    whole = np.bincount(text, weights=weight * some, minlength=part.count) / size
    key2, inside2 = part.grams(part.shape)
    form = covered(key2, inside2, shaped, SHAPE_HALF_WINDOW, SHAPE_MEAN)
    by_shape = _longest(form, part.shape_text, part.count, _delimiter()[np.minimum(part.shape, 127)])
    named = _longest(covered(key, inside, letters[_NAMED], NAMED_HALF_WINDOW, SHAPE_MEAN), text, part.count, None)
    return share, whole, np.maximum(by_shape, np.where(named >= NAMED_CHARS, named, 0)), part


def _bins(p: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    key, inside = Slice.grams(p)
    return np.bincount(key[inside if keep is None else inside & keep], minlength=1 << TABLE_BITS)


@lru_cache(maxsize=1)
def _examples() -> tuple[np.ndarray, np.ndarray]:
    """Counts of the examples: by class over letters, and of placeholders over shapes."""
    found = seeds()
    return np.stack([_bins(Slice(found[k]).plain) for k in CLASSES]).astype(np.float64), _bins(Slice(found["placeholder"]).shape).astype(np.float64)


def models(counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios against prose, by letters for each class and by shape; ``counts`` has prose, its shapes, and the classes' own finds."""
    letters, shaped = _examples()

    def share(x: np.ndarray, unseen: int = 0) -> np.ndarray:
        return x / max(x.sum() + unseen, 1.0)

    own = counts[2:]
    mixed = []
    for k in range(len(CLASSES)):
        seed = share(letters[k])
        mixed.append((1 - OWN_WEIGHT) * seed + OWN_WEIGHT * share(own[k]) if own[k].sum() else seed)
    ratio = np.log((np.stack(mixed) + FLOOR) / (share(counts[0], UNSEEN) + FLOOR))
    shape_ratio = np.log((share(shaped) + FLOOR) / (share(counts[1], UNSEEN) + FLOOR))
    return np.clip(ratio, -CLIP, CLIP).astype(np.float32), np.clip(shape_ratio, -CLIP, CLIP).astype(np.float32)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    return tk.slices(texts, SLICE_CHARS)


def _count_batches(model):
    """(form, gram, n): prose, its shapes and the classes' own finds, as far as a model tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2 + len(CLASSES), 1 << TABLE_BITS), dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _slices(texts):
                if model is None:
                    part = Slice(texts[a:b])
                    prose = np.ones(part.count, dtype=bool)
                else:
                    share, whole, left, part = judge(texts[a:b], model.value)
                    prose = (whole < COVERAGE) & (left < SHAPE_CHARS)
                    best = np.where((whole >= CERTAIN) & (left < SHAPE_CHARS), np.argmax(share, axis=0), -1)
                    for k in range(len(CLASSES)):
                        if k != _NAMED and (best == k).any():
                            counts[2 + k] += _bins(part.plain, (best == k)[part.text])
                counts[0] += _bins(part.plain, prose[part.text])
                counts[1] += _bins(part.shape, prose[part.shape_text])
        form, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(form.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[form, at])], names=["form", "gram", "n"])

    return run


def fit(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The models, after ``REFITS`` refits on all ``texts``; what travels is six tables of 2^18 counts."""
    context = texts.sparkSession.sparkContext
    model = None
    for _ in range(1 + REFITS):
        table = texts.mapInArrow(_count_batches(context.broadcast(model) if model else None), "form int, gram int, n long").groupBy("form", "gram").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((2 + len(CLASSES), 1 << TABLE_BITS))
        counts[table.column("form").to_numpy(), table.column("gram").to_numpy()] = table.column("n").to_numpy()
        model = models(counts)
    return model


def _judge_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                share, whole, left, _ = judge(texts[a:b], model.value)
                hit = np.flatnonzero((whole >= COVERAGE) | (left >= SHAPE_CHARS))
                best = np.argmax(share[:, hit], axis=0)
                kind = np.where((left[hit] >= SHAPE_CHARS) | (best == _NAMED), "placeholder", np.array(CLASSES)[best])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][hit]), pa.array(kind.tolist(), pa.string()), pa.array(np.round(whole[hit], 4))], names=["analysis_id", "kind", "coverage"])

    return run


def residue(texts: DataFrame) -> DataFrame:
    """(analysis_id, kind, coverage) of the texts that are residue; ``texts`` has (id, text)."""
    base = texts.select(F.col("id").cast("long").alias("id"), F.col("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"\S")).distinct()
    model = texts.sparkSession.sparkContext.broadcast(fit(base.select("text")))
    found = base.mapInArrow(_judge_batches(model), "analysis_id long, kind string, coverage double")
    return found.groupBy("analysis_id").agg(F.min("kind").alias("kind"), F.max("coverage").alias("coverage"))


def residue_previews(analyses: DataFrame) -> DataFrame:
    return residue(analyses.select(F.col("analysis_id").alias("id"), F.col("requests.content_preview").alias("text")))
