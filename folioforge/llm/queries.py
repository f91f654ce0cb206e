"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import boilerplate, hashknn, leakage, mojibake, neardup, residue, sitelines, splitting, tokenise
from folioforge.plans.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "document_segments"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similar pairs of p1_found between classes of equal texts; with p1_members its complete form for classes of any size."""
    return neardup.near_duplicate_links(table(spark, sf_dir, "document_segments"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_members(table(spark, sf_dir, "document_segments"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment: its class among texts that share 0.8 of their five-word shingles."""
    return neardup.near_duplicate_classes(table(spark, sf_dir, "document_segments"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_previews(table(spark, sf_dir, "scraping_analysis_results")).select("analysis_id")


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_previews(table(spark, sf_dir, "scraping_analysis_results"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyses whose preview is no residue."""
    analyses = table(spark, sf_dir, "scraping_analysis_results")
    kept = analyses.join(residue.residue_previews(analyses), "analysis_id", "left_anti")
    return kept.select("analysis_id", "base_url", "document_id", "requests.content_preview").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashknn.similar_pairs(table(spark, sf_dir, "document_segments"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of every segment whose id is divisible by 50, against all."""
    segments = table(spark, sf_dir, "document_segments")
    return hashknn.nearest(segments, segments.where(F.col("id") % 50 == 0))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_segments(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "chunk_profiles"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "chunk_profiles"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.without_repeated_lines(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_corpus(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_links": p1_links, "p1_members": p1_members, "p1_classes": p1_classes, "p2_found": p2_found, "p2_bodies": p2_bodies, "p3_found": p3_found, "p3_kinds": p3_kinds, "p3_clean": p3_clean, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_pieces": p5_pieces, "p7_found": p7_found, "p7_clean": p7_clean, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_restored": p10_restored}


_P1 = """
WITH s AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM document_segments),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM s WHERE len(w) >= 40),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a AS segment_a, b AS segment_b FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c)
"""

_P1_LINKS = """
WITH s AS (SELECT min(id) AS id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT id, content FROM document_segments) GROUP BY content),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM s WHERE len(w) >= 40),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a AS class_a, b AS class_b, round(c / (x.n + y.n - c), 6) AS similarity FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c)
"""

_P1_MEMBERS = """
WITH s AS (SELECT DISTINCT id, content FROM document_segments WHERE len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) >= 40),
c AS (SELECT content, min(id) AS class_id, count(*) AS copies FROM s GROUP BY content)
SELECT id AS segment_id, class_id, copies, copies <= 64 AS expanded FROM s JOIN c USING (content)
"""

#: Classes of the five-word, 0.8 rule: the least id reachable over the links, by rounds of the minimum.
_P1_CLASSES = """
WITH RECURSIVE s AS (SELECT DISTINCT id, content, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM document_segments WHERE length(content) > 0),
f AS (SELECT content, min(id) AS first, any_value(w) AS w FROM s GROUP BY content),
g AS (SELECT DISTINCT first, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM f WHERE len(w) >= 5),
n AS (SELECT first, count(*) AS n FROM g GROUP BY first),
common AS (SELECT a.first AS a, b.first AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.first <> b.first GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.first = a JOIN n y ON y.first = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT first, first FROM f UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
named AS (SELECT a AS first, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS first, count(*) AS links FROM links GROUP BY a)
SELECT s.id AS segment_id, min(class_id) AS class_id, max(coalesce(links, 0)) AS links
FROM s JOIN f USING (content) JOIN named ON named.first = f.first LEFT JOIN degree ON degree.first = f.first GROUP BY s.id
"""

_P9 = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dr AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS r FROM d WHERE len(w) >= 13),
ir AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS r FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)
"""

_P5 = """
WITH sized AS (
  SELECT DISTINCT s.id, s.content, coalesce(p.chunk_size, star.chunk_size) AS size
  FROM document_segments s
  LEFT JOIN chunk_profiles p ON p.segment_type = lower(trim(s.segment_type)) AND p.segment_type <> '*'
  CROSS JOIN (SELECT chunk_size FROM chunk_profiles WHERE segment_type = '*') star
)
SELECT id AS segment_id, max(CASE WHEN list_max(list_transform(string_split_regex(content, '[ \\t\\r\\n]+'), lambda x: length(x))) > size THEN 1 ELSE 0 END)::INT AS forced
FROM sized WHERE length(content) > size GROUP BY id
"""

_P7_LINES = """
WITH site AS (
  SELECT doc_id, regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', '') AS host FROM documents
), raw AS (
  SELECT DISTINCT s.id, s.document_id, s.content, site.host FROM document_segments s JOIN site ON site.doc_id = s.document_id WHERE site.host <> ''
), lines AS (
  SELECT id, document_id, host, unnest(range(len(string_split(content, chr(10)))))::INT AS line_no, unnest(string_split(content, chr(10))) AS line FROM raw
), norm AS (
  SELECT id, document_id, host, line_no, trim(regexp_replace(lower(line), '[\\s\\v\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g')) AS line FROM lines
), freq AS (
  SELECT host, line FROM norm WHERE length(line) >= 15 GROUP BY ALL HAVING count(DISTINCT document_id) >= 5
), found AS (SELECT DISTINCT n.id, n.line_no FROM norm n JOIN freq f ON f.host = n.host AND f.line = n.line)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_links": _P1_LINKS,
        "p1_members": _P1_MEMBERS,
        "p1_classes": _P1_CLASSES,
        "p5_found": _P5,
        "p9_found": _P9,
        "p7_found": _P7_LINES + "SELECT id AS segment_id, line_no FROM found",
        "p7_clean": _P7_LINES
        + """
, gone AS (SELECT id, list(line_no) AS g FROM found GROUP BY id), base AS (SELECT DISTINCT id, content FROM document_segments)
SELECT b.id AS segment_id,
  CASE WHEN g IS NULL THEN b.content ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(string_split(b.content, chr(10)), range(len(string_split(b.content, chr(10))))), lambda x: NOT list_contains(g, x[2]::INT)), lambda x: x[1]), chr(10)), '') END AS content,
  coalesce(len(g), 0)::INT AS removed
FROM base b LEFT JOIN gone USING (id)
""",
    }
