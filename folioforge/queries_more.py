"""Further registered queries of the core and their SQL twins: compositions, statistics, labels and lookups.

The SQL spells its words and patterns out, so that an error in a table of the code
shows as a difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import extract, labels, text, urls
from folioforge.operators import catalog, chunking, compose, crossrefs, search, vector
from folioforge.plans.session import table
from folioforge.queries import AS_OF, as_of, register
from folioforge.streaming import rates

_SEGMENTS = "WITH s AS (SELECT DISTINCT id, document_id, content, section_title, section_path FROM document_segments)"
_LOW = "lower(concat_ws(chr(10), section_title, content[1:500]))"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, segment_id, section_title, content), each row once."""
    return table(spark, sf_dir, "document_segments").select("document_id", F.col("id").alias("segment_id"), "section_title", "content").distinct()


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the called names: a segment in whose title or first line a name is called defines it.

    The tables hold no definitions (``def``, ``class``), which ``extract.anchors``
    reads; so the first name called in each segment stands for one.
    """
    first = F.regexp_extract("content", r"\b([A-Za-z_]\w*)\(", 1)
    rows = _segments(spark, sf_dir).select("document_id", "segment_id", first.alias("anchor_name"))
    return rows.where(F.length("anchor_name") > 2).select("document_id", "segment_id", F.lit("function").alias("anchor_type"), "anchor_name", F.concat("anchor_name", F.lit("()")).alias("anchor_signature"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to the names that a segment calls."""
    called = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1))))
    return _segments(spark, sf_dir).select("document_id", "segment_id", called.alias("reference_text")).where(F.length("reference_text") > 2).withColumn("reference_type", F.lit("function"))


_ANCHORS = """s AS (SELECT DISTINCT id, document_id, content, section_title, section_path FROM document_segments),
a AS (SELECT document_id, id AS segment_id, regexp_extract(content, '\\b([A-Za-z_]\\w*)\\(', 1) AS name FROM s WHERE length(regexp_extract(content, '\\b([A-Za-z_]\\w*)\\(', 1)) > 2),
c AS (SELECT DISTINCT document_id, id AS segment_id, unnest(regexp_extract_all(content, '\\b([A-Za-z_]\\w*)\\(', 1)) AS name FROM s),
r AS (SELECT * FROM c WHERE length(name) > 2)"""

# ---- text


@register(
    """WITH s AS (SELECT DISTINCT id, content FROM document_segments),
n AS (SELECT id, unnest(list_concat(
  list_transform(list_filter(regexp_extract_all(content, '\\b(\\w+)\\s*\\(', 1), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[A-Z]')), lambda x: {'name': x, 'kind': 'function'}),
  list_transform(regexp_extract_all(content, '\\bclass\\s+(\\w+)', 1), lambda x: {'name': x, 'kind': 'class'}),
  list_transform(list_filter(regexp_extract_all(content, '\\.(\\w+)\\s*\\(', 1), lambda x: length(x) > 2), lambda x: {'name': x, 'kind': 'method'}),
  list_transform(regexp_extract_all(content, 'import\\s+(\\w+)', 1), lambda x: {'name': x, 'kind': 'module'}))) AS i FROM s)
SELECT id, i.name AS name, i.kind AS kind FROM n"""
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "document_segments").select("id", "content").distinct()
    return rows.select("id", F.explode(extract.identifiers(F.col("content"))).alias("i")).select("id", "i.name", "i.kind")


@register("SELECT DISTINCT id, CASE WHEN length(content) > 200 THEN content[1:200] || '...' ELSE content END AS preview FROM document_segments")
def result_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_segments").select("id", text.result_preview(F.col("content")).alias("preview")).distinct()


@register("SELECT DISTINCT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(section_title, '\\s+', ' ', 'g')), '\\s*,\\s*', ', ', 'g'), '¶\\s*$', '')) AS signature FROM document_segments WHERE section_title IS NOT NULL")
def clean_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "document_segments").where(F.col("section_title").isNotNull())
    return rows.select("id", extract.clean_signature(F.col("section_title")).alias("signature")).distinct()


@register(
    f"""SELECT DISTINCT id, CASE
WHEN regexp_matches({_LOW}, 'beginner|basic|intro|getting started|quickstart') OR regexp_matches({_LOW}, 'advanced|expert|complex|in-depth') OR regexp_matches({_LOW}, 'intermediate|moderate')
THEN concat_ws(', ', CASE WHEN regexp_matches({_LOW}, 'beginner|basic|intro|getting started|quickstart') THEN 'Beginner' END, CASE WHEN regexp_matches({_LOW}, 'advanced|expert|complex|in-depth') THEN 'Advanced' END, CASE WHEN regexp_matches({_LOW}, 'intermediate|moderate') THEN 'Intermediate' END)
WHEN regexp_matches(content[1:500], 'class |def |function|import|from') THEN 'Technical (contains code)' END AS complexity FROM document_segments"""
)
def complexity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_segments").select("id", labels.complexity(F.col("section_title"), F.col("content")).alias("complexity")).distinct()


@register(
    """WITH d AS (SELECT doc_id, lower(concat_ws(chr(10), title, text[1:1000])) AS low, lower(text[1:1000]) AS start FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(low, 'api|reference|method|function|class') THEN 'API Reference' END, CASE WHEN regexp_matches(low, 'tutorial|guide|getting started|quickstart|intro') THEN 'Tutorial/Guide' END,
CASE WHEN regexp_matches(low, 'example|sample|demo|usage') THEN 'Examples' END, CASE WHEN regexp_matches(low, 'install|setup|configuration|config') THEN 'Setup/Config' END) AS kinds,
CASE WHEN regexp_matches(low, 'beginner|basic|intro|getting started|quickstart') THEN 'Beginner' WHEN regexp_matches(low, 'advanced|expert|complex|in-depth') THEN 'Advanced'
WHEN regexp_matches(start, 'class |def |function|import|from') THEN 'Technical' ELSE 'Intermediate' END AS level FROM d"""
)
def reading_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and level of whole documents, as shown beside them when they are read."""
    title, content = F.col("title"), F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(labels.reading_kinds(title, content), ",").alias("kinds"), labels.reading_level(title, content).alias("level"))


@register(
    """SELECT doc_id, coalesce(nullif(regexp_extract(url || '/' || coalesce(version, ''), '(?i)/v?(\\d+\\.\\d+(?:\\.\\d+)?(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(url || '/' || coalesce(version, ''), '(?i)/(\\d+\\.\\d+(?:\\.\\d+)?(?:\\.\\d+)?)/', 1), ''),
nullif(regexp_extract(url || '/' || coalesce(version, ''), '(?i)version[=/](\\d+\\.\\d+(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(url || '/' || coalesce(version, ''), '(?i)tag[=/]v?(\\d+\\.\\d+(?:\\.\\d+)?)', 1), '')) AS number FROM documents"""
)
def versioned_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version in the address of each document of a version, which is its URL followed by the version."""
    return table(spark, sf_dir, "documents").select("doc_id", urls.url_version(F.concat("url", F.lit("/"), F.coalesce("version", F.lit("")))).alias("number"))


@register("SELECT doc_id, (starts_with(lower(markdown_path), 'docs/') OR regexp_matches(lower(markdown_path), '\\.(md|rst)$')) AND lower(markdown_path) <> 'readme.md' AS kept FROM documents")
def repository_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored files a repository's import would take."""
    return table(spark, sf_dir, "documents").select("doc_id", urls.repository_document(F.col("markdown_path")).alias("kept"))


# ---- search

_VIEW = """WITH v AS (SELECT DISTINCT s.id, s.document_id, s.content, s.section_title, s.section_path, d.title, d.version, d.library_id, d.is_library_doc, l.name AS library_name
FROM document_segments s JOIN documents d ON d.doc_id = s.document_id LEFT JOIN libraries l ON l.id = d.library_id)"""


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.segment_view(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "libraries"))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


_COS = """, q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
near AS (SELECT DISTINCT w.id, (1 + list_cosine_similarity(w.embedding::DOUBLE[], q.e)) / 2 AS score FROM document_segments w, q WHERE len(w.embedding) = 64 AND NOT isnan(list_cosine_similarity(w.embedding::DOUBLE[], q.e)) ORDER BY score DESC, id LIMIT 200),
hits AS (SELECT v.*, near.score FROM v JOIN near USING (id) WHERE section_path IS NOT NULL),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY section_path ORDER BY score DESC, document_id, id) = 1)"""


@register(_VIEW + _COS + "SELECT id, document_id, section_path, round(score, 6) AS score, 'vector' AS source FROM best WHERE score >= 0.5 ORDER BY score DESC, document_id, id LIMIT 20")
def search_vector_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: vector hits, one for each section path, where there are any."""
    found = compose.search_segments(_view(spark, sf_dir), "collector", search.SearchOptions(limit=20, min_score=0.5), vector.vectors_of(table(spark, sf_dir, "document_segments")), _query_vector(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@register(
    _VIEW
    + """, hits AS (SELECT *, (CASE WHEN contains(lower(content), 'collector') AND contains(lower(coalesce(section_title, '')), 'collector') THEN 10.0 WHEN contains(lower(content), 'collector') AND contains(lower(coalesce(title, '')), 'collector') THEN 8.0
WHEN contains(lower(content), 'collector') THEN 5.0 ELSE 0.5 END)::DOUBLE AS score FROM v WHERE library_name IS NOT NULL AND (contains(lower(content), 'collector') OR contains(lower(coalesce(title, '')), 'collector') OR contains(lower(coalesce(section_title, '')), 'collector'))),
one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY document_id, section_path ORDER BY id) = 1),
best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY section_path ORDER BY score DESC, document_id, id) = 1)
SELECT id, document_id, section_path, score, 'text' AS source FROM best ORDER BY score DESC, document_id, id LIMIT 30"""
)
def search_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search where no vector is near enough: text hits, among documents of a library."""
    options = search.SearchOptions(limit=30, filters=(F.col("library_name").isNotNull(),))
    nothing = vector.vectors_of(table(spark, sf_dir, "document_segments")).where("id < 0")
    return compose.search_segments(_view(spark, sf_dir), "collector", options, nothing, _query_vector(spark, sf_dir))


@register(_VIEW + ", one AS (SELECT * FROM v WHERE version = 'latest' QUALIFY row_number() OVER (PARTITION BY section_path ORDER BY id) = 1) SELECT id, document_id, section_path, 0.0::DOUBLE AS score, 'listing' AS source FROM one ORDER BY id LIMIT 40")
def search_listing_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search without a hit: what the filters alone leave."""
    return compose.search_segments(_view(spark, sf_dir), "nosuchwordanywhere", search.SearchOptions(limit=40, filters=(F.col("version") == "latest",)))


@register(
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT DISTINCT w.id, round(list_cosine_similarity(w.embedding::DOUBLE[], q.e), 6) AS score FROM document_segments w, q WHERE len(w.embedding) = 64 AND list_cosine_similarity(w.embedding::DOUBLE[], q.e) >= 0.25 AND NOT isnan(list_cosine_similarity(w.embedding::DOUBLE[], q.e))
ORDER BY score DESC, id LIMIT 1000"""
)
def vector_knn_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.knn(vector.vectors_of(table(spark, sf_dir, "document_segments")), _query_vector(spark, sf_dir), 1_000, min_score=0.25)
    return found.select("id", F.round("score", 6).alias("score"))


@register(
    _VIEW
    + """, hits AS (SELECT *, CASE WHEN contains(lower(content), 'scheduler') THEN 5.0 ELSE 0.5 END AS score FROM v WHERE contains(lower(content), 'scheduler')),
p AS (SELECT document_id, coalesce(section_path, '0') AS section_path, list_sort(list(id)) AS ids, max(score)::DOUBLE AS best, max(title) AS title FROM hits GROUP BY 1, 2)
SELECT document_id, coalesce(max(title), 'Untitled') AS title, count(*) AS sections, sum(len(ids))::BIGINT AS hits, max(best) AS score FROM p GROUP BY 1"""
)
def results_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a word grouped by document and section."""
    hits = _view(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("scheduler"))).select("id", "document_id", "title", "section_path", F.lit(5.0).alias("score")).distinct()
    return compose.by_document(hits).select("document_id", "title", F.size("sections").cast("long").alias("sections"), "hits", "score")


@register("SELECT doc_id AS document_id FROM documents WHERE version = 'latest' INTERSECT SELECT doc_id FROM documents d JOIN libraries l ON l.id = d.library_id WHERE l.name = (SELECT min(name) FROM libraries x JOIN documents y ON y.library_id = x.id)")
def in_document_and_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    members = catalog.collection_members(documents, table(spark, sf_dir, "libraries"))
    first = members.agg(F.min("collection").alias("collection"))
    return compose.in_both(documents.where(F.col("version") == "latest").select(F.col("doc_id").alias("document_id")), members.join(F.broadcast(first), "collection", "left_semi"))


# ---- references and suggestions


@register(
    "WITH " + _ANCHORS + """, best AS (SELECT name, max(segment_id) AS far_id, arg_max(document_id, segment_id) AS far_document FROM a GROUP BY 1), near AS (SELECT name, document_id, max(segment_id) AS local_id FROM a GROUP BY 1, 2)
SELECT r.document_id, r.segment_id, r.name AS reference_text, coalesce(local_id, far_id) AS target_segment_id, CASE WHEN local_id IS NOT NULL THEN r.document_id ELSE far_document END AS target_document_id
FROM r JOIN best USING (name) LEFT JOIN near ON near.name = r.name AND near.document_id = r.document_id"""
)
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called names resolved against the segments that introduce them, in the same document first."""
    return crossrefs.resolve(_calls(spark, sf_dir), _anchors(spark, sf_dir)).select("document_id", "segment_id", "reference_text", "target_segment_id", "target_document_id")


@register(
    "WITH " + _ANCHORS + """, best AS (SELECT name, max(segment_id) AS far_id FROM a GROUP BY 1), near AS (SELECT name, document_id, max(segment_id) AS local_id FROM a GROUP BY 1, 2),
t AS (SELECT r.segment_id AS x, coalesce(local_id, far_id) AS y FROM r JOIN best USING (name) LEFT JOIN near ON near.name = r.name AND near.document_id = r.document_id), e AS (SELECT DISTINCT x, y FROM t WHERE x <> y)
SELECT coalesce(o.k, i.k) AS segment_id, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM (SELECT x AS k, count(*) AS n FROM e GROUP BY 1) o FULL JOIN (SELECT y AS k, count(*) AS n FROM e GROUP BY 1) i ON o.k = i.k"""
)
def link_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrefs.degrees(crossrefs.graph(crossrefs.resolve(_calls(spark, sf_dir), _anchors(spark, sf_dir))))


@register(
    "WITH " + _ANCHORS + """, best AS (SELECT name, max(segment_id) AS far_id FROM a GROUP BY 1), near AS (SELECT name, document_id, max(segment_id) AS local_id FROM a GROUP BY 1, 2),
t AS (SELECT r.segment_id AS x, coalesce(local_id, far_id) AS y FROM r JOIN best USING (name) LEFT JOIN near ON near.name = r.name AND near.document_id = r.document_id)
SELECT x AS source_segment_id, y AS target_segment_id, count(*) AS "references" FROM t WHERE x <> y GROUP BY 1, 2"""
)
def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that call names which other segments introduce."""
    return crossrefs.graph(crossrefs.resolve(_calls(spark, sf_dir), _anchors(spark, sf_dir)))


_NAME = "(SELECT name FROM a GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


def _common_name(spark: SparkSession, sf_dir: str) -> str:
    found = _anchors(spark, sf_dir).groupBy("anchor_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "anchor_name").first()
    return found[0] if found else ""


@register(
    "WITH " + _ANCHORS + f""" SELECT 'definition' AS what, a.document_id, d.title, a.segment_id, s.section_title FROM a JOIN documents d ON d.doc_id = a.document_id JOIN s ON s.id = a.segment_id AND s.document_id = a.document_id WHERE a.name = {_NAME}
UNION ALL SELECT 'reference', r.document_id, d.title, r.segment_id, s.section_title FROM r JOIN documents d ON d.doc_id = r.document_id JOIN s ON s.id = r.segment_id AND s.document_id = r.document_id WHERE r.name = {_NAME}"""
)
def reference_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the commonest name is introduced and where it is called."""
    documents, segments, anchors = table(spark, sf_dir, "documents"), _segments(spark, sf_dir), _anchors(spark, sf_dir)
    name = _common_name(spark, sf_dir)
    columns = ("document_id", "title", "segment_id", "section_title")
    found = compose.find_definitions(anchors, documents, segments, name, "function").select(F.lit("definition").alias("what"), *columns)
    return found.unionByName(compose.find_references(_calls(spark, sf_dir), documents, segments, name, "function").select(F.lit("reference").alias("what"), *columns))


@register(
    """WITH s AS (SELECT DISTINCT id AS segment_id, document_id, content, section_title FROM document_segments),
m AS (SELECT s.*, d.title, """
    + " + ".join(f"CASE WHEN contains(lower(content), '{w}') OR contains(lower(coalesce(section_title, '')), '{w}') OR contains(lower(coalesce(d.title, '')), '{w}') THEN 1 ELSE 0 END" for w in ("read", "config", "file", "write"))
    + """ + CASE WHEN contains(lower(content), 'read') OR contains(lower(coalesce(section_title, '')), 'read') OR contains(lower(coalesce(d.title, '')), 'read') THEN 1 ELSE 0 END AS matches FROM s JOIN documents d ON d.doc_id = s.document_id),
b AS (SELECT * FROM m WHERE matches > 0 ORDER BY matches DESC, title NULLS FIRST, segment_id LIMIT 10),
n AS (SELECT document_id, segment_id, matches, unnest(list_slice(list_concat(
  list_transform(list_filter(regexp_extract_all(content, '\\b(\\w+)\\s*\\(', 1), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[A-Z]')), lambda x: {'name': x, 'kind': 'function'}),
  list_transform(regexp_extract_all(content, '\\bclass\\s+(\\w+)', 1), lambda x: {'name': x, 'kind': 'class'}),
  list_transform(list_filter(regexp_extract_all(content, '\\.(\\w+)\\s*\\(', 1), lambda x: length(x) > 2), lambda x: {'name': x, 'kind': 'method'}),
  list_transform(regexp_extract_all(content, 'import\\s+(\\w+)', 1), lambda x: {'name': x, 'kind': 'module'})), 1, 3)) AS i FROM b)
SELECT i.name AS identifier, i.kind AS kind, document_id, segment_id, round(CASE WHEN regexp_matches(lower(i.name), 'read|config|file') THEN least(1.0, least(0.9, 0.4 + matches * 0.15) + 0.2) ELSE least(0.9, 0.4 + matches * 0.15) END, 6)::DOUBLE AS score FROM n"""
)
def suggest_for_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers for a task of one category (``read config file`` among the file operations)."""
    found = compose.category_suggestions(_segments(spark, sf_dir), table(spark, sf_dir, "documents"), "file_operations", "read config file")
    return found.select("identifier", "kind", "document_id", "segment_id", F.round("score", 6).alias("score"))


@register()
def get_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for ``read config file`` from all sources; restated in Python in tests/test_compose.py."""
    segments, anchors = _segments(spark, sf_dir), _anchors(spark, sf_dir)
    resolved = crossrefs.resolve(_calls(spark, sf_dir), anchors)
    return compose.suggestions(segments, table(spark, sf_dir, "documents"), anchors, resolved, "read config file", 25).withColumn("score", F.round("score", 6))


# ---- chunk index

_LENGTHS = """WITH l AS (SELECT DISTINCT document_id, id, coalesce(section_path, '') AS section_path, length(content) AS n FROM document_segments),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY document_id ORDER BY section_path, id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)"""


@register(
    _LENGTHS
    + """SELECT document_id, id, section_path, start, start + n AS "end", CASE WHEN n > 0 THEN array_to_string(range(start // 5000 + 1, (start + n - 1) // 5000 + 2), ',') ELSE '' END AS chunk_numbers, CASE WHEN n > 0 THEN start // 5000 + 1 ELSE 1 END AS primary_chunk FROM p"""
)
def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of 5,000 characters that each section lies in."""
    spans = chunking.section_spans(table(spark, sf_dir, "document_segments"), 5_000)
    return spans.withColumn("chunk_numbers", F.array_join(F.col("chunk_numbers").cast("array<string>"), ","))


@register(_LENGTHS + "SELECT document_id, id, section_path FROM p WHERE n > 0 AND 2 BETWEEN start // 5000 + 1 AND (start + n - 1) // 5000 + 1")
def sections_of_second_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections_in_chunk(chunking.section_spans(table(spark, sf_dir, "document_segments"), 5_000), 2)


@register()
def chunk_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's chunk with its neighbours and theirs; restated in tests/test_compose.py."""
    return chunking.chunk_navigation(chunking.section_packs(table(spark, sf_dir, "document_segments"), 5_000))


# ---- store

_S = f"(floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(timezone('UTC', last_checked))))"


@register("SELECT l.id AS library_id, d.doc_id, l.version AS latest_available_version FROM documents d JOIN libraries l ON l.id = d.doc_id WHERE d.is_library_doc AND NOT coalesce(l.is_available, FALSE)")
def pending_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library documents with an update waiting; the checks are the libraries of the same number."""
    libraries = table(spark, sf_dir, "libraries")
    checks = libraries.select(F.col("id").alias("document_id"), (~F.coalesce("is_available", F.lit(False))).alias("needs_update"), F.col("version").alias("latest_available_version"), "last_checked")
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("is_library_doc").alias("check_for_updates"))
    return catalog.pending_updates(documents, checks).select(F.col("doc_id").alias("library_id"), "doc_id", "latest_available_version")


@register(f"SELECT id, coalesce({_S} >= 7 * 86400, TRUE) AS due FROM libraries")
def checks_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "libraries").select("id", catalog.check_due(F.col("last_checked"), as_of()).alias("due"))


@register("SELECT DISTINCT d.doc_id, d.title FROM documents d LEFT JOIN document_segments s ON s.document_id = d.doc_id WHERE s.section_title IS NULL")
def documents_without_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a segment without a title, or without segments; the title stands for the context."""
    return catalog.without_context(table(spark, sf_dir, "documents"), table(spark, sf_dir, "document_segments"), F.col("section_title"))


@register(
    """WITH h AS (SELECT DISTINCT id, document_id, segment_type AS model FROM document_segments WHERE section_title IS NOT NULL)
SELECT model, count(DISTINCT document_id) AS documents, count(DISTINCT id) AS segments, 1::BIGINT AS models FROM h WHERE model IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, count(DISTINCT document_id), count(DISTINCT id), count(DISTINCT model) FROM h"""
)
def context_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.context_models(table(spark, sf_dir, "document_segments"), F.col("section_title"), F.col("segment_type"))


@register(
    """SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS documents, count(*) AS segments, round(count(*) * 1.0 / (SELECT count(DISTINCT doc_id) FROM documents), 2) AS per_document, round(sum(has) * 100.0 / count(*), 2) AS coverage_percent
FROM (SELECT id, max(CASE WHEN len(embedding) > 0 THEN 1 ELSE 0 END) AS has FROM document_segments GROUP BY id)"""
)
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.store_summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "document_segments"))


@register("SELECT doc_id, title FROM documents ORDER BY scraped_at DESC NULLS LAST, doc_id LIMIT 5")
def recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.recent_documents(table(spark, sf_dir, "documents")).select("doc_id", "title")


@register(
    f"""WITH e AS (SELECT floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(timezone('UTC', created_at))) AS age, coalesce(len(embedding), 0) AS n FROM document_segments)
SELECT count(*) AS entries, count(*) FILTER (age < 30 * 86400) AS valid, count(*) FILTER (NOT coalesce(age < 30 * 86400, FALSE)) AS expired, sum(n * 4)::BIGINT AS bytes FROM e"""
)
def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "document_segments").select("created_at", F.col("embedding").alias("vector"))
    return catalog.vector_cache(entries, as_of(), 30 * 86_400)


@register(
    f"""SELECT id, CASE WHEN is_available THEN 'fresh' WHEN last_checked IS NULL THEN 'outdated' WHEN {_S} < 7 * 86400 THEN 'fresh' WHEN {_S} < 30 * 86400 THEN 'stale' ELSE 'outdated' END AS status FROM libraries"""
)
def staleness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each library by its last check; available ones stand for pinned ones."""
    rows = table(spark, sf_dir, "libraries").withColumn("is_pinned", F.col("is_available"))
    return catalog.update_staleness(rows, as_of()).select("id", F.col("staleness_status").alias("status"))


@register("SELECT d.doc_id AS document_id, d.title, d.url FROM documents d WHERE contains(lower(coalesce(title, '')), 'scheduler') OR contains(lower(coalesce(url, '')), 'scheduler') ORDER BY title, doc_id, url LIMIT 25")
def search_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources by title or description; each document is its own resource, described by its URL."""
    documents = table(spark, sf_dir, "documents")
    resources = documents.select(F.col("doc_id").alias("document_id"), "title", F.col("url").alias("description"), "url")
    return catalog.search_resources(resources, documents, "scheduler", 25).select("document_id", "title", "url")


@register("SELECT doc_id, l.name AS llms_title FROM documents d JOIN libraries l ON l.id = d.library_id ORDER BY scraped_at DESC NULLS LAST, doc_id LIMIT 20")
def documents_with_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    told = documents.join(table(spark, sf_dir, "libraries").select(F.col("id").alias("library_id"), "name"), "library_id").select(F.col("doc_id").alias("document_id"), F.col("name").alias("llms_title"), F.lit("").alias("llms_summary"))
    return catalog.documents_with_resources(documents, told).select("doc_id", "llms_title")


@register(
    """WITH t AS (SELECT DISTINCT doc_id, lower(trim(x)) AS tag FROM (SELECT doc_id, unnest([lang, source, CASE WHEN is_library_doc THEN 'library' END]) AS x FROM documents) WHERE x IS NOT NULL AND lower(trim(x)) <> '')
SELECT doc_id AS document_id, to_json(list_sort(list(tag)))::VARCHAR AS tags FROM t GROUP BY 1"""
)
def doc_tags_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each document as JSON text, read back from it once."""
    tags = catalog.document_tags(table(spark, sf_dir, "documents")).groupBy("document_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    return tags.select("document_id", catalog.tags_to_json(catalog.tags_from_json(catalog.tags_to_json(F.col("tags")))).alias("tags"))


@register(
    """SELECT doc_id, concat_ws(';', CASE WHEN title IS NOT NULL THEN 'title=' || title END, CASE WHEN n_chars IS NOT NULL THEN 'chars=' || n_chars::VARCHAR END, CASE WHEN is_library_doc IS NOT NULL THEN 'library=' || is_library_doc::VARCHAR END) AS metadata FROM documents"""
)
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = catalog.text_values({"title": F.col("title"), "chars": F.col("n_chars"), "library": F.col("is_library_doc")})
    shown = F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf_dir, "documents").select("doc_id", shown.alias("metadata"))


@register("SELECT version, count(*) AS documents, max(n_chars) AS longest FROM documents WHERE is_library_doc = TRUE AND lang IN ('en', 'de') GROUP BY 1 ORDER BY version DESC LIMIT 30")
def built_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query put together part by part."""
    built = catalog.Select(table(spark, sf_dir, "documents")).where("is_library_doc", "=", True).where_in("lang", ["en", "de"])
    return built.group_by("version", documents=F.count(F.lit(1)), longest=F.max("n_chars")).order_by("version", "desc").limit(30).build()


# ---- requests


@register(
    """WITH w AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS hour_count,
count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS all_minute FROM events)
SELECT event_id, hour_count >= 3 AS burst FROM w"""
)
def burst_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are at least the third of their user within an hour."""
    return rates.window_counts(table(spark, sf_dir, "events"), "user_id").select("event_id", (F.col("hour_count") >= 3).alias("burst"))
