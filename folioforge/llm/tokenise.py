"""Encoding a corpus with a public byte-level BPE (problem 8).

Texts up to ``chunk_chars`` are encoded as they are.  A longer text is cut into
chunks that overlap; the chunks are pre-tokenised independently, in parallel,
and stitched where the pre-token boundaries of two neighbours resynchronise: a
boundary that both list inside their overlap.  From there on both see the same
text from the same state, so by induction it is a boundary of the whole text.
The pieces between such boundaries are encoded independently and concatenated.
A text in which two neighbours share no boundary (a run without one that is
longer than the overlap) is encoded in one piece.

Defined results: null and empty texts give the empty list; every row of the
input gives one row, repeated rows too; special-token strings are plain text.
``decode_ids`` concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts longer than a chunk are cut; the chunks overlap by so many characters.
CHUNK_CHARS, OVERLAP_CHARS = 4_096, 512
#: A boundary this close to a chunk's end may depend on the text beyond it.
END_GUARD = 8

#: The published pre-token pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def default_vocabulary() -> str:
    """The vocabulary's file in the package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    import tiktoken

    return tiktoken.Encoding("folioforge", pat_str=PATTERN, mergeable_ranks=_ranks(path or default_vocabulary()), special_tokens={})


def decode_ids(ids: list[int], path: str | None = None) -> bytes:
    by_rank = encoding(path)
    return b"".join(by_rank.decode_single_token_bytes(i) for i in ids)


def _encode_batches(column: str, name: str):
    """``name`` is the file that Spark brought to the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(SparkFiles.get(name))
        for batch in batches:
            at = batch.schema.get_field_index(column)
            ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(at).to_pylist()]
            arrays = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    return run


def _boundary_batches(chunk_chars: int, overlap: int):
    """Per chunk: the boundaries in its head and in its tail overlap, as offsets of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(PATTERN)
        for batch in batches:
            rows = batch.to_pydict()
            heads, tails = [], []
            for start, text in zip(rows["start"], rows["part"]):
                # white space before a cut would be grouped otherwise, as its pattern looks ahead
                ends = [m.end() for m in pattern.finditer(text) if not m.group()[-1].isspace()]
                heads.append([start + e for e in ends if e <= overlap])
                tails.append([start + e for e in ends if chunk_chars < e <= len(text) - END_GUARD])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("start"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["row", "start", "head", "tail"]
            )

    return run


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """(``id_col``, ids): the token ids of each text, without special tokens.

    ``vocabulary`` is a file that the driver can read; Spark brings it to the workers.
    """
    vocabulary = vocabulary or default_vocabulary()
    df.sparkSession.sparkContext.addFile(vocabulary)
    vocabulary = Path(vocabulary).name
    id_type = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = base.where(F.length("text") <= chunk_chars).mapInArrow(_encode_batches("text", vocabulary), f"row {id_type}, ids array<int>")
    long = base.where(F.length("text") > chunk_chars)
    # repeated rows of one id are encoded once and counted
    long = long.groupBy("row", "text").agg(F.count(F.lit(1)).alias("times"), F.xxhash64(F.first("text")).alias("key"))
    long = long.select(F.struct("row", "key").alias("row"), "text", "times")
    row_type = f"struct<row:{id_type},key:bigint>"
    starts = long.select("row", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk_chars))).alias("start"))
    chunks = starts.select("row", F.col("start").cast("long").alias("start"), F.expr(f"substring(text, start + 1, {chunk_chars + overlap})").alias("part")).repartition("row", "start")
    marks = chunks.mapInArrow(_boundary_batches(chunk_chars, overlap), f"row {row_type}, start long, head array<bigint>, tail array<bigint>")
    by_row = Window.partitionBy("row").orderBy("start")
    cuts = marks.select("row", "start", F.array_min(F.array_intersect("tail", F.lead("head").over(by_row))).alias("cut"), F.lead("start").over(by_row).isNotNull().alias("inner"))
    stitched = cuts.groupBy("row").agg(
        F.when(F.bool_or(F.col("inner") & F.col("cut").isNull()), F.array().cast("array<bigint>")).otherwise(F.sort_array(F.collect_list("cut"))).alias("cuts")
    )
    pieces = (
        long.join(stitched, "row")
        .select("row", "times", "text", F.concat(F.array(F.lit(0).cast("long")), "cuts").alias("from"), F.concat("cuts", F.array(F.length("text").cast("long"))).alias("to"))
        .select("row", "times", "text", F.explode(F.arrays_zip("from", "to")).alias("p"))
        .select("row", "times", F.col("p.from").alias("start"), F.expr("substring(text, cast(p.from as int) + 1, cast(p.to - p.from as int))").alias("part"))
        .repartition("row", "start")
        .mapInArrow(_encode_batches("part", vocabulary), f"row {row_type}, times long, start long, ids array<int>")
    )
    joined = pieces.groupBy("row", "times").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "ids"))), lambda p: p["ids"])).alias("ids"))
    joined = joined.select(F.col("row.row").alias("row"), "ids", F.explode(F.expr("array_repeat(1, cast(times as int))"))).select("row", "ids")
    return short.unionByName(joined).select(F.col("row").alias(id_col), "ids")
