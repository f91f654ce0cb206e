"""Exact vector search: cosine and Euclidean distance, top-k, filtered and batched.

Scores are matrix products over Arrow batches; of each partition only the k best rows
go on, so neither vectors nor scores are shuffled, and nothing but the query vectors
is ever broadcast.  ``cosine`` and ``euclid`` are the same measures as expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Scores are rounded to so many digits, so that copies of a vector have equal ones.
DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for null, zero or differently wide vectors."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale)


def euclid(a: Column, b: Column) -> Column:
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)))


def vectors_of(segments: DataFrame, width: int = 64) -> DataFrame:
    """(id, document_id, embedding) of the segments with a vector of this width; copies of a row stay."""
    return segments.where(F.size("embedding") == width).select("id", "document_id", "embedding")


def _best_batches(query: list[float], k: int, measure: str, least: float | None):
    """The k best distinct (id, score) of this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.array(query, dtype=np.float64)
        length = np.linalg.norm(asked)
        ids, scores = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            rows = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), len(asked)))
            if not rows.num_rows:
                continue
            base = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(asked))
            with np.errstate(invalid="ignore", divide="ignore"):
                score = base @ asked / (np.linalg.norm(base, axis=1) * length) if measure == "cosine" else 1 / (1 + np.linalg.norm(base - asked, axis=1))
            # copies of a row get the same score, whatever batch they stand in
            score = np.round(score, DIGITS)
            fine = np.isfinite(score) if least is None else score >= least
            ids = np.concatenate((ids, rows.column(0).to_numpy(zero_copy_only=False)[fine]))
            scores = np.concatenate((scores, score[fine]))
            # ties go to the smaller id
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
            ids, scores = ids[new][:k], scores[new][:k]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], names=["id", "score"])

    return run


def knn(vectors: DataFrame, query: list[float], k: int, measure: str = "cosine", min_score: float | None = None) -> DataFrame:
    """(id, score) of the k nearest rows to one vector: cosine, or 1 / (1 + distance) for ``l2``.

    Rows of another width, null and zero vectors (for the cosine) have no score;
    copies of a row count once; a query of zeros finds nothing by the cosine.
    """
    near = vectors.where(F.col("embedding").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long"), "embedding").mapInArrow(_best_batches([float(x) for x in query], k, measure, min_score), "id long, score double")
    return near.distinct().orderBy(F.desc("score"), "id").limit(k)


def beside(near: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """Hits (id, score), as few as were asked for, with other columns of their segments."""
    return segments.select("id", *columns).join(F.broadcast(near), "id").distinct()


def _block_batches(block, k: int):
    """The k best rows of this partition for every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = block.value
        width = queries.shape[1]
        top = np.full((len(ids), k), -np.inf)
        who = np.zeros((len(ids), k), dtype=np.int64)
        for batch in batches:
            rows = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), width))
            if not rows.num_rows:
                continue
            base = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norm = np.linalg.norm(base, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = queries @ base.T / norm
            score = np.concatenate((top, np.where(np.isfinite(score), np.round(score, DIGITS), -np.inf)), axis=1)
            names = np.concatenate((who, np.broadcast_to(rows.column("id").to_numpy(), (len(ids), len(base)))), axis=1)
            # ties go to the smaller id; copies of a row stand side by side, and only the first stays
            best = np.lexsort((names, -score), axis=1)
            score, names = np.take_along_axis(score, best, 1), np.take_along_axis(names, best, 1)
            again = np.zeros(score.shape, dtype=bool)
            again[:, 1:] = (score[:, 1:] == score[:, :-1]) & (names[:, 1:] == names[:, :-1])
            kept = np.argsort(again, axis=1, kind="stable")[:, :k]
            top = np.where(np.take_along_axis(again, kept, 1), -np.inf, np.take_along_axis(score, kept, 1))
            who = np.take_along_axis(names, kept, 1)
        keep = np.isfinite(top).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[keep]), pa.array(who.ravel()[keep]), pa.array(top.ravel()[keep])], names=["query_id", "id", "score"])

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = 2_000) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest rows to each query by cosine; queries are (query_id, query).

    A block of at most about ``max_queries`` queries is one matrix product per
    Arrow batch; a partition sends k rows per query to the shuffle, whatever its
    size.  Null and zero vectors and other widths than a query's are left out.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // max_queries))
    out = spark.createDataFrame([], "query_id long, id long, score double")
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select(F.col("query_id").cast("long"), "query").collect()
        for width in sorted({len(r["query"]) for r in rows if r["query"]}):
            part = [r for r in rows if r["query"] and len(r["query"]) == width and any(r["query"])]
            if part:
                matrix = np.array([r["query"] for r in part], dtype=np.float64)
                matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
                block = spark.sparkContext.broadcast((np.array([r["query_id"] for r in part], dtype=np.int64), matrix))
                out = out.unionByName(vectors.select("id", "embedding").where(F.col("embedding").isNotNull()).mapInArrow(_block_batches(block, k), "query_id long, id long, score double"))
    out = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
