"""Stored files and exports: reading bodies, backups, export formats."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, content) of the text files under a path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_file"), F.col("value").alias("content"))


def export_rows(documents: DataFrame, form: str) -> DataFrame:
    """(doc_id, body) of each document as ``markdown``, ``html``, ``json``, ``xml`` or ``llms``."""
    title, text, url = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))

    def escaped(c: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(name))
        return c

    bodies = {
        "markdown": F.concat(F.lit("# "), title, F.lit("\n\n"), text),
        "html": F.concat(F.lit("<html><head><title>"), escaped(title), F.lit("</title></head><body><pre>"), escaped(text), F.lit("</pre></body></html>")),
        "json": F.to_json(F.struct("doc_id", title.alias("title"), url.alias("url"), F.col("version"), text.alias("content"))),
        "xml": F.concat(F.lit('<document id="'), F.col("doc_id").cast("string"), F.lit('"><title>'), escaped(title), F.lit("</title><url>"), escaped(url), F.lit("</url><content>"), escaped(text), F.lit("</content></document>")),
        "llms": F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")")),
    }
    return documents.select("doc_id", bodies[form].alias("body"))


def export(documents: DataFrame, form: str, path: str, single: bool = False) -> None:
    """Write an export: one row per line for ``single``, else a folder per document."""
    rows = export_rows(documents, form)
    if single:
        rows.orderBy("doc_id").select("body").write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").partitionBy("doc_id").text(path)


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{safe_member(name)}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{safe_member(name)}") for name in names}


def safe_member(name: str) -> str:
    """The name of a file inside a folder; anything that could lead out of it raises."""
    if not name or name.startswith(("/", "\\", "~")) or "\x00" in name or os.path.normpath(name) != name or ".." in re.split(r"[/\\]", name):
        raise ValueError(f"unsafe name {name!r}")
    return name


def id_ranges(text: str, strict: bool = True) -> list[int]:
    """``1-3,7`` as 1, 2, 3, 7; a backward range raises, or is swapped when not strict."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, dash, last = part.partition("-")
        a, b = int(first), int(last if dash else first)
        if a > b:
            if strict:
                raise ValueError(f"backward range {part!r}")
            a, b = b, a
        out.extend(range(a, b + 1))
    return list(dict.fromkeys(out))
