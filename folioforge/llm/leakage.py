"""Evaluation texts that leaked into a corpus (problem 9).

The test items are an inverted index: for each word its postings, items with BM25
weights, sorted into blocks of items, and the largest weight in each block.  Every
passage of the corpus is a query: each ``run`` consecutive words of a document that
all occur in the index.

Retrieval is block-max WAND.  A passage whose words can't reach the least threshold
with their largest weights is left at once.  Else it sums its words' block maxima (as
differences of prefix sums, so each word is read once for all passages that hold it),
and blocks below their threshold are skipped.  In a block that is left the words are
ordered by their maximum there; those up to the pivot can't reach the threshold
together, so only the postings of the words beyond it are walked, and the items met
are scored over all words.  The threshold of an item is the least score of any of
its runs of ``run`` words, so nothing that shares a run is lost.  What is kept is
verified on the exact runs.

It is evaluated for many passages at a time with arrays over the sparse postings; no
passage, document or item is skipped otherwise.

Defined results: null and empty texts and texts of fewer than ``run`` words leak
nothing; items of fewer words can't be found; repeated documents and items count
once.  The items are read to the driver in parts of bounded size; the corpus is
scanned once for each part, which is searched in indexes of a bounded number of
items, so that blocks stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import textkernel as tk

RUN_WORDS = 13
#: Items of a block, and of an index; the block maxima of an index are one row for each of its words.
BLOCK_ITEMS, SHARD_ITEMS = 4, 512
K1, B = 1.2, 0.75
#: Characters of item text that one scan of the corpus searches for, in as many indexes as that takes.
SCAN_CHARS = 4_000_000
#: Postings, or block maxima, that a worker reads at once.
POSTINGS = 2_000_000


class ItemIndex:
    """BM25 weights of the items, block maxima, thresholds and exact runs, as arrays."""

    def __init__(self, ids: np.ndarray, texts: list[str], run: int):
        hashes, owner = tk.words(texts)
        self.run = run
        self.ids = ids
        n = len(texts)
        lengths = np.bincount(owner, minlength=n).astype(np.float64)
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        pair, tf = np.unique(word.astype(np.int64) * n + owner, return_counts=True)
        df = np.bincount(pair // n, minlength=len(self.vocabulary))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1.0))
        weight = idf[pair // n] * tf * (K1 + 1) / (tf + norm[pair % n])
        # items that share rare words get neighbouring places, so that blocks stay selective
        rarest = np.zeros(n)
        np.maximum.at(rarest, pair % n, idf[pair // n] * (1 + (pair // n) / (len(self.vocabulary) + 1.0)))
        self.place = np.argsort(np.argsort(rarest, kind="stable"), kind="stable")
        self.width = n
        # postings by word and place, and their block maxima
        self.width = n
        key = pair // n * n + self.place[pair % n]
        order = np.argsort(key)
        self.keys, self.weights = key[order], weight[order]
        self.size = BLOCK_ITEMS
        self.blocks = -(-n // self.size)
        self.block_max = np.zeros((len(self.vocabulary), self.blocks), dtype=np.float32)
        np.maximum.at(self.block_max, (self.keys // n, self.keys % n // self.size), np.nextafter(self.weights.astype(np.float32), np.float32(np.inf)))
        self.top = self.block_max.max(axis=1, initial=0)
        self.threshold = np.full(self.blocks * self.size, np.inf)
        self.item_at = np.full(self.blocks * self.size, -1, dtype=np.int64)
        self.item_at[self.place] = np.arange(n)
        keys, at = tk.runs(hashes, owner, run)
        for i in at:
            j = owner[i]
            distinct = np.unique(word[i : i + run])
            least = self.weights[np.searchsorted(self.keys, distinct * n + self.place[j])].sum() * (1 - 1e-5)
            self.threshold[self.place[j]] = min(self.threshold[self.place[j]], least)
        self.block_threshold = self.threshold.reshape(self.blocks, self.size).min(axis=1)
        self.least = float(self.threshold.min(initial=np.inf))
        order = np.lexsort((owner[at], keys))
        self.run_keys, self.run_items = keys[order], owner[at][order]

    def passages(self, word: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words of all stretches of at least ``run`` indexed words of one text, stretch of each)."""
        inside = word >= 0
        new = np.ones(len(word), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(word)))
        keep = inside[start] & (size >= self.run)
        start, size = start[keep], size[keep]
        return self._ranges(start, size), np.repeat(np.arange(len(start)), size)

    def search(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of every text that shares a run with an item."""
        none = np.empty(0, np.int64)
        if not len(self.vocabulary) or not len(hashes):
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[at] == hashes, at, -1)
        spot, stretch = self.passages(word, owner)
        found = []
        step = max(self.run, POSTINGS // self.blocks)
        for a in range(0, len(spot) - self.run + 1, step):
            z = min(a + step + self.run - 1, len(spot))
            found.append(self._retrieve(word[spot[a:z]], stretch[a:z], hashes[spot[a:z]], owner[spot[a:z]]))
        if not found:
            return none, none
        return np.concatenate([t for t, _ in found]), np.concatenate([i for _, i in found])

    @staticmethod
    def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The places of consecutive ranges, one after the other."""
        return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Values of the wanted keys in a sparse table, 0 where there are none."""
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def _items(self, words: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the items of a block that reach their threshold for a passage; a row of ``words`` is a passage."""
        words = np.sort(words, axis=1)
        again = np.zeros(words.shape, dtype=bool)
        again[:, 1:] = words[:, 1:] == words[:, :-1]
        best = np.where(again, 0, self.block_max[words, block[:, None]]).astype(np.float64)
        order = np.argsort(best, axis=1)
        upto = np.cumsum(np.take_along_axis(best, order, axis=1), axis=1)
        beyond = np.zeros(words.shape, dtype=bool)
        np.put_along_axis(beyond, order, upto >= self.block_threshold[block][:, None] * (1 - 1e-6), axis=1)
        row, column = np.nonzero(beyond & (best > 0))
        base = words[row, column] * self.width + block[row] * self.size
        lo, hi = np.searchsorted(self.keys, base), np.searchsorted(self.keys, np.minimum(base + self.size, (words[row, column] + 1) * self.width))
        met = np.unique(np.repeat(row, hi - lo) * np.int64(self.blocks * self.size) + self.keys[self._ranges(lo, hi - lo)] % self.width)
        of, place = met // (self.blocks * self.size), met % (self.blocks * self.size)
        # the scores of the items met, over all words of their passage
        score = np.where(again[of], 0, self._at(self.keys, self.weights, words[of] * self.width + place[:, None])).sum(axis=1)
        keep = np.flatnonzero(score >= self.threshold[place])
        return of[keep], place[keep]

    def _retrieve(self, word: np.ndarray, stretch: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of the passages that start at the words of some stretches."""
        run = self.run
        none = np.empty(0, np.int64)

        def sums(x: np.ndarray) -> np.ndarray:
            total = np.zeros((len(x) + 1, *x.shape[1:]))
            np.cumsum(x, axis=0, out=total[1:], dtype=np.float64)
            return total[run:] - total[:-run]

        whole = (stretch[run - 1 :] == stretch[: len(stretch) - run + 1]) & (sums(self.top[word]) >= self.least * (1 - 1e-6))
        if not whole.any():
            return none, none
        start, block = np.nonzero((sums(self.block_max[word]) >= self.block_threshold * (1 - 1e-6)) & whole[:, None])
        texts, items = [], []
        step = POSTINGS // (8 * run)
        for a in range(0, len(start), step):
            first = start[a : a + step]
            row, place = self._items(word[first[:, None] + np.arange(run)], block[a : a + step])
            if not len(row):
                continue
            # verify on the exact runs
            at = first[row]
            item = self.item_at[place]
            key = np.zeros(len(at), dtype=np.uint64)
            for k in range(run):
                key = key * tk._ROLL + hashes[at + k]
            key = tk.mix(key)
            left, right = np.searchsorted(self.run_keys, key, "left"), np.searchsorted(self.run_keys, key, "right")
            which = np.repeat(np.arange(len(at)), right - left)
            real = self.run_items[self._ranges(left, right - left)] == item[which]
            texts.append(owner[at[which[real]]])
            items.append(item[which[real]])
        if not texts:
            return none, none
        out = np.unique(np.concatenate(texts) * np.int64(len(self.ids)) + np.concatenate(items))
        return out // len(self.ids), out % len(self.ids)


def _search_batches(indexes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(zero_copy_only=False), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in tk.slices(texts):
                hashes, owner = tk.words(texts[a:b])
                for ix in indexes.value:
                    text, item = ix.search(hashes, owner)
                    pairs = np.unique(text * np.int64(len(ix.ids)) + item)
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(docs[a:b][pairs // len(ix.ids)]), pa.array(ix.ids[pairs % len(ix.ids)])], names=["doc_id", "item_id"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", run: int = RUN_WORDS) -> DataFrame:
    """(doc_id, item_id) of every document that shares ``run`` consecutive words with an item."""
    spark = documents.sparkSession
    known = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & (F.length("text") > 0)).distinct()
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    scans = max(1, -(-size["chars"] // SCAN_CHARS))
    corpus = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    out = spark.createDataFrame([], "doc_id long, item_id long")
    for k in range(scans):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == k).orderBy("item_id", "text").collect()
        if part:
            indexes = [ItemIndex(np.array([r["item_id"] for r in rows], dtype=np.int64), [r["text"] for r in rows], run) for rows in (part[a : a + SHARD_ITEMS] for a in range(0, len(part), SHARD_ITEMS))]
            out = out.unionByName(corpus.mapInArrow(_search_batches(spark.sparkContext.broadcast(indexes)), "doc_id long, item_id long"))
    return out.distinct()
