"""Near-duplicate texts by adaptive multi-match prefixes (problem 1).

Texts become sets of distinct word shingles.  All sets share one total order of
shingles, the rarest first; how often a shingle occurs comes from a count sketch
over the whole corpus (a fixed number of counters, each an upper bound).  For a
Jaccard threshold t a set of n shingles needs ``a = ceil(t * n)`` common ones, so
two similar sets share at least l shingles within their first ``n - a + l``, for
every l.  The shorter of the two needs ``ceil(2t / (1 + t) * n)`` common ones, so
for its role a prefix of that bound is enough.  Each text chooses its l by the estimated cost of its candidates: a
longer prefix brings more postings but asks for more matches before anything is
verified.  A pair is a candidate if it shares ``min(l_a, l_b)`` shingles of the
prefixes of that level.  Candidates are verified on their whole shingle sets, so
the result is exact whatever the sketch says.

A shingle that very many texts share is a hot key: by its counter it is split over
blocks of its postings (``BLOCK_POSTINGS``), and the postings of the shorter role
are repeated for every block, so no task holds more than a block of one side.

Texts that are equal form one class and go through the join once.  The complete form
for classes of any size is ``near_duplicate_links`` (pairs of different texts, by the
smallest id of each) with ``near_duplicate_members`` (the class of every id).
``near_duplicate_pairs`` expands it to pairs of ids; of a class of more than
``EXPAND_CLASS`` copies each copy is paired with the class's smallest id, which then
carries the class's links (no link between different texts is lost, and
``near_duplicate_members`` has the copies of such classes).

Classes are named by a 64-bit hash of their text.  A second hash tells texts apart
that share the first; such texts get new names.

Defined results: null, empty and short texts (fewer than ``min_words`` words)
have no pairs; ids that repeat with the same text count once; null ids are left
out; a pair appears once, smaller id first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import textkernel as tk
from folioforge.operators.components import connected_components
from folioforge.plans.session import cut

MAX_LEVEL = 3
#: What verifying one candidate costs, in visits of a posting.
VERIFY_COST = 20.0
#: What one more prefix shingle costs, in visits of a posting.
EMIT_COST = 2.0
#: log2 of the number of counters of the shingle sketch: least, most, and of a block of them; the texts that the least is for.
SKETCH_BITS, MAX_SKETCH_BITS, BLOCK_BITS, SKETCH_TEXTS = 24, 27, 12, 2_000_000
#: Postings of one shingle that are joined in one piece.
BLOCK_POSTINGS = 4_096
#: Sketch counts are kept as eighths of their logarithm to base 2.
LOG_STEP = 8.0
#: Ids up to this number (8 bytes each) are broadcast to filter a scan.
BROADCAST_IDS = 500_000
EXPAND_CLASS = 64
#: Hashes of texts that stand for several texts, at most.
MAX_CLASHES = 10_000


def _shingles(texts: list[str], size: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of the texts that are long enough, sorted."""
    hashes, owner = tk.words(texts)
    enough = np.bincount(owner, minlength=len(texts)) >= min_words
    keys, at = tk.runs(hashes, owner, size)
    keep = enough[owner[at]]
    keys, own = tk.distinct_per_text(keys[keep], owner[at][keep])
    return own, keys


def _counter(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _sketch_batches(size: int, min_words: int, bits: int):
    """The partition's counters, in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts = np.zeros(1 << bits, dtype=np.uint16)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in tk.slices(texts):
                at, more = np.unique(_counter(_shingles(texts[a:b], size, min_words)[1], bits), return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + more, 0xFFFF)
        pack = zstandard.ZstdCompressor(level=1)
        blocks = counts.reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([pack.compress(blocks[k].tobytes()) for k in used], pa.binary())], names=["block", "counts"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(unpack.decompress(raw), dtype=np.uint16).astype(np.float64)
            total[k] = total[k] + counts if k in total else counts
    logs = [np.minimum(np.round(LOG_STEP * np.log2(1 + c)), 255).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary())], names=["block", "logs"])


def shingle_sketch(texts: DataFrame, size: int, min_words: int) -> np.ndarray:
    """``LOG_STEP * log2(1 + count)`` of each counter over all texts: 16 to 128 MB, growing with the corpus up to that."""
    bits = min(MAX_SKETCH_BITS, SKETCH_BITS + max(0, (texts.count() // SKETCH_TEXTS).bit_length()))
    parts = texts.mapInArrow(_sketch_batches(size, min_words, bits), "block int, counts binary").repartition("block")
    table = parts.mapInArrow(_sum_blocks, "block int, logs binary").toArrow()
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << BLOCK_BITS), dtype=np.uint8)
    for k, raw in zip(table.column("block").to_pylist(), table.column("logs").to_pylist()):
        out[k] = np.frombuffer(raw, dtype=np.uint8)
    return out.ravel()


def _prefixes(own: np.ndarray, keys: np.ndarray, texts: int, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, place, depth of its text, size of its text, log count) of the prefix shingles."""
    log = sketch[_counter(keys, len(sketch).bit_length() - 1)]
    order = np.lexsort((keys, log, own))
    own, keys, log = own[order], keys[order], log[order]
    n = np.bincount(own, minlength=texts)
    start = np.cumsum(n) - n
    need = np.ceil(threshold * n - 1e-9).astype(np.int64)
    place = np.arange(len(own)) - start[own]
    level = np.maximum(1, place + 1 - (n - need)[own])
    postings = np.exp2(log / LOG_STEP)
    traffic = np.bincount(own, weights=np.where(level == 1, postings, 0), minlength=texts)
    depth, least = np.ones(texts, dtype=np.int64), traffic * (1 + VERIFY_COST)
    for k in range(2, MAX_LEVEL + 1):
        traffic = traffic + np.bincount(own, weights=np.where(level == k, postings, 0), minlength=texts)
        cost = traffic * (1 + VERIFY_COST / k) + EMIT_COST * (k - 1)
        better = (cost < least) & (need >= k)
        depth[better], least[better] = k, cost[better]
    keep = level <= depth[own]
    own = own[keep]
    return own, keys[keep], place[keep], depth[own], n[own], log[keep]


def _blocked(token: np.ndarray, doc: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posting, key, role) of what is joined: role 1 is the shorter text's, 2 the longer's, 3 both.

    A token whose counter allows for more than a block of postings has a key for each
    block: a posting is in one of them as the longer text's, and in all as the shorter's.
    """
    blocks = np.maximum(1, np.ceil((np.exp2(log / LOG_STEP) - 1) / BLOCK_POSTINGS)).astype(np.int64)
    hot = np.flatnonzero(blocks > 1)
    if not len(hot):
        return np.arange(len(token)), token, np.full(len(token), 3)
    key = token.copy()
    own = (tk.mix(doc[hot].view(np.uint64)) % blocks[hot].astype(np.uint64)).astype(np.int64)
    key[hot] = _block_key(token[hot], own)
    each = np.repeat(hot, blocks[hot])
    nth = np.arange(len(each)) - np.repeat(np.cumsum(blocks[hot]) - blocks[hot], blocks[hot])
    role = np.full(len(token), 3)
    role[hot] = 2
    return np.concatenate((np.arange(len(token)), each)), np.concatenate((key, _block_key(token[each], nth))), np.concatenate((role, np.ones(len(each), np.int64)))


def _block_key(token: np.ndarray, block: np.ndarray) -> np.ndarray:
    return (tk.mix(token.astype(np.uint64) * tk._ROLL + block.astype(np.uint64)) >> np.uint64(16)).astype(np.int64)


def _postings(size: int, threshold: float, min_words: int, sketch):
    """Per distinct text of a partition: its prefix shingles with their places in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set[int] = set()
        for batch in batches:
            docs, texts = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    docs.append(d)
                    texts.append(t)
            ids = np.array(docs, dtype=np.int64)
            for a, b in tk.slices(texts):
                own, keys = _shingles(texts[a:b], size, min_words)
                own, keys, place, depth, n, log = _prefixes(own, keys, b - a, counts, threshold)
                # 48 bits are enough to find candidates, and less to shuffle
                at, token, role = _blocked((keys >> np.uint64(16)).astype(np.int64), ids[a:b][own], log)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(ids[a:b][own[at]]), pa.array((n[at] << 34) + (role << 32) + (place[at] << 3) + depth[at])], names=["token", "doc", "meta"])

    return run


def _sets(size: int, min_words: int):
    """(doc, shingles) of the texts that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in tk.slices(texts):
                own, keys = _shingles(texts[a:b], size, min_words)
                n = np.bincount(own, minlength=b - a)
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                keep = pa.array(n > 0)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]).filter(keep), sets.filter(keep)], names=["doc", "shingles"])

    return run


def _long_enough(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            enough = np.zeros(len(texts), dtype=bool)
            for a, b in tk.slices(texts):
                enough[a:b] = np.bincount(tk.words(texts[a:b])[1], minlength=b - a) >= min_words
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(enough))], names=["doc"])

    return run


def _only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids``: by broadcast within a bound, else by a shuffle."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def _candidates(texts: DataFrame, size: int, threshold: float, min_words: int) -> DataFrame:
    """(a, b) of text classes that share enough of their prefixes, the shorter one first."""
    sketch = texts.sparkSession.sparkContext.broadcast(shingle_sketch(texts.select("text"), size, min_words))
    raw = texts.select("doc", "text").mapInArrow(_postings(size, threshold, min_words, sketch), "token long, doc long, meta long")
    # both sides of the join read this one exchange, so no condition on one side alone may go below it
    rows = raw.repartition("token").select(
        "token", "doc", F.shiftright("meta", 34).alias("n"), F.shiftright("meta", 32).bitwiseAND(3).alias("role"), F.shiftright("meta", 3).bitwiseAND((1 << 29) - 1).alias("place"), F.col("meta").bitwiseAND(7).alias("depth")
    )

    def level(share: float):
        return F.greatest(F.lit(1), F.col("place") + 1 - F.col("n") + F.ceil(share * F.col("n") - 1e-9))

    both = 2 * threshold / (1 + threshold)
    short = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in ("doc", "n", "role", "place", "depth")], level(both).alias("level_a"))
    long = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "role", "place", "depth")], level(threshold).alias("level_b"))
    # what can still be common, given where the shared shingle stands in both orders
    reach = F.least("place_a", "place_b") + 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) - 1
    met = short.join(long, "token").where(
        (F.col("role_a").bitwiseAND(1) + F.col("role_b").bitwiseAND(2) == 3)
        & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_a") < F.col("doc_b"))))
        & (F.col("n_a") >= threshold * F.col("n_b") - 1e-9)
        & (F.greatest("level_a", "level_b") <= F.least("depth_a", "depth_b"))
        & (reach >= both / 2 * (F.col("n_a") + F.col("n_b")) - 1e-9)
    )
    return (
        met.groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("hits"), F.min(F.least("depth_a", "depth_b")).alias("depth"))
        .where(F.col("hits") >= F.col("depth"))
        .select("a", "b")
    )


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, text) of the rows with a text; doc names the class of equal texts."""
    named = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("doc"), F.xxhash64(F.lit(7), text_col).alias("check"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    clash = named.groupBy("doc").agg(F.min("check").alias("low"), F.max("check").alias("high")).where(F.col("low") != F.col("high")).select("doc")
    # about n * n / 2^65 of them: none below 10^9 texts
    clashing = [r["doc"] for r in clash.limit(MAX_CLASHES + 1).collect()]
    if len(clashing) > MAX_CLASHES:
        raise ValueError("too many texts share their hash")
    doc = F.when(F.col("doc").isin(clashing), F.xxhash64("doc", "check")).otherwise(F.col("doc")) if clashing else F.col("doc")
    return named.select("id", doc.alias("doc"), "text")


def similar_texts(texts: DataFrame, size: int, threshold: float, min_words: int) -> DataFrame:
    """(a, b, similarity) of different texts, by class key, each pair once.  ``texts`` has (doc, text)."""
    pairs = cut(_candidates(texts, size, threshold, min_words), "pairs")
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    wanted = _only(texts.select("doc", "text"), ends, "doc").mapInArrow(_sets(size, min_words), "doc long, shingles array<bigint>").dropDuplicates(["doc"])
    both = pairs.join(wanted.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(wanted.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either"))
    return scored.where(F.col("common") >= threshold * F.col("either") - 1e-9).select("a", "b", (F.col("common") / F.col("either")).alias("similarity"))


def _long_classes(texts: DataFrame, classes: DataFrame, min_words: int) -> DataFrame:
    """The classes of ``classes`` whose text has at least ``min_words`` words."""
    return classes.join(_only(texts.select("doc", "text"), cut(classes.select("doc"), "copied"), "doc").mapInArrow(_long_enough(min_words), "doc long").distinct(), "doc")


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content", size: int = 3, threshold: float = 0.6, min_words: int = 40) -> DataFrame:
    """(segment_a, segment_b) of all ids whose texts are similar, smaller id first."""
    texts = _classes(df, id_col, text_col)
    links = similar_texts(texts, size, threshold, min_words).select("a", "b")
    members = cut(texts.select("doc", "id").distinct(), "members")
    classes = members.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    # of a large class only the first copy stands for it towards others
    stands = members.join(classes, "doc").where((F.col("copies") <= EXPAND_CLASS) | (F.col("id") == F.col("first")))
    across = links.join(stands.select(F.col("doc").alias("a"), F.col("id").alias("x")), "a").join(stands.select(F.col("doc").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    copied = members.join(_long_classes(texts, classes.where(F.col("copies") > 1), min_words), "doc")
    small = copied.where(F.col("copies") <= EXPAND_CLASS)
    within = small.select("doc", F.col("id").alias("x")).join(small.select("doc", F.col("id").alias("y")), "doc").where(F.col("x") < F.col("y")).select("x", "y")
    star = copied.where((F.col("copies") > EXPAND_CLASS) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    pairs = across.unionByName(within).unionByName(star)
    return pairs.select(F.least("x", "y").alias("segment_a"), F.greatest("x", "y").alias("segment_b")).where(F.col("segment_a") != F.col("segment_b")).distinct()


def near_duplicate_links(df: DataFrame, id_col: str = "id", text_col: str = "content", size: int = 3, threshold: float = 0.6, min_words: int = 40) -> DataFrame:
    """(class_a, class_b, similarity) of similar different texts, each named by its smallest id, smaller first."""
    texts = _classes(df, id_col, text_col)
    first = cut(texts.groupBy("doc").agg(F.min("id").alias("first")), "first")
    links = similar_texts(texts, size, threshold, min_words)
    named = links.join(first.select(F.col("doc").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("doc").alias("b"), F.col("first").alias("y")), "b")
    return named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def near_duplicate_members(df: DataFrame, id_col: str = "id", text_col: str = "content", min_words: int = 40) -> DataFrame:
    """(segment_id, class_id, copies, expanded): the class of equal texts of each id with enough words.

    ``class_id`` is the smallest id of the class; ``expanded`` is false for the classes
    whose copies ``near_duplicate_pairs`` gives as a star around that id.
    """
    texts = _classes(df, id_col, text_col)
    members = cut(texts.select("doc", "id").distinct(), "members")
    classes = members.groupBy("doc").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("class_id"))
    enough = texts.select("doc", "text").mapInArrow(_long_enough(min_words), "doc long").distinct()
    return members.join(classes.join(enough, "doc"), "doc").select(F.col("id").alias("segment_id"), "class_id", "copies", (F.col("copies") <= EXPAND_CLASS).alias("expanded"))


def near_duplicate_classes(df: DataFrame, id_col: str = "id", text_col: str = "content", size: int = 5, threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """(segment_id, class_id, links): one row per id with a text; links counts the similar other texts.

    Classes are connected components over similar texts, named by their smallest id.
    """
    texts = _classes(df, id_col, text_col)
    links = cut(similar_texts(texts, size, threshold, min_words).select("a", "b"), "links")
    members = cut(texts.select("doc", "id").distinct(), "members")
    first = members.groupBy("doc").agg(F.min("id").alias("first"))
    edges = links.join(first.select(F.col("doc").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("doc").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    named = connected_components(edges, "x", "y").select(F.col("node").alias("first"), "component")
    degree = links.select(F.col("a").alias("doc")).unionByName(links.select(F.col("b").alias("doc"))).groupBy("doc").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(first, "doc")
        .join(named, "first", "left")
        .join(degree, "doc", "left")
        .select(F.col("id").alias("segment_id"), F.coalesce("component", "first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
        .groupBy("segment_id")
        .agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    )
