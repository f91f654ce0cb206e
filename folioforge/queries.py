"""Registered queries of the core engine and their SQL twins.

Each entry is (query, SQL or None).  Queries run over whole tables; the literal
arguments of searches and filters are the ones in the constants below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import checks, extract, freshness, html, labels, text, urls
from folioforge.operators import catalog, chunking, crawl, crossrefs, hierarchy, lookups, mutations, search, sections, suggest, summarise, vector, versions
from folioforge.plans.session import table
from folioforge.sources import llms, store
from folioforge.streaming import rates

AS_OF = "2025-01-01 00:00:00"
TERMS = "nightly transport settings"

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None):
    def add(query):
        REGISTRY[query.__name__] = (query, sql)
        return query

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---- hierarchies

_WALK = """
WITH RECURSIVE n AS (SELECT id, min(parent_segment_id) AS p FROM document_segments GROUP BY id),
l AS (SELECT n.id, q.id AS p FROM n LEFT JOIN n q ON q.id = n.p),
w AS (
  SELECT id, p AS nxt, 0 AS depth, [id] AS seen FROM l
  UNION ALL
  SELECT w.id, l.p, w.depth + 1, list_append(w.seen, l.id) FROM w JOIN l ON l.id = w.nxt WHERE NOT list_contains(w.seen, w.nxt)
)
"""


@register(
    _WALK
    + """
, last AS (SELECT id, nxt, depth, seen FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1)
SELECT id AS segment_id, CASE WHEN nxt IS NULL THEN seen[-1] ELSE list_min(seen[list_position(seen, nxt):]) END AS root_id,
  CASE WHEN nxt IS NULL THEN depth ELSE -1 END::INT AS depth FROM last
"""
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = hierarchy.nested_sets(table(spark, sf_dir, "document_segments"), "id", "parent_segment_id")
    return sets.select(F.col("id").alias("segment_id"), "root_id", F.col("depth").cast("int").alias("depth"))


@register(
    _WALK
    + """
, last AS (SELECT id, nxt, depth, seen FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC) = 1),
tree AS (SELECT id, list_reverse(seen) AS path, depth FROM last WHERE nxt IS NULL),
placed AS (SELECT id, path[1] AS root_id, depth, path, row_number() OVER (PARTITION BY path[1] ORDER BY path) - 1 AS lo FROM tree),
sizes AS (SELECT a AS id, count(*) AS size FROM (SELECT unnest(path) AS a FROM tree) GROUP BY 1),
stored AS (SELECT id, min(section_path) AS section_path FROM document_segments GROUP BY id)
SELECT id AS segment_id, root_id, depth::BIGINT AS depth, size, lo, array_to_string(path, '/') AS full_path, section_path FROM placed JOIN sizes USING (id) JOIN stored USING (id)
UNION ALL SELECT id, list_min(seen[list_position(seen, nxt):]), -1, NULL, NULL, NULL, section_path FROM last JOIN stored USING (id) WHERE nxt IS NOT NULL
"""
)
def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path, subtree size and preorder range of each segment, beside its stored section path."""
    segments = table(spark, sf_dir, "document_segments")
    stored = segments.groupBy("id").agg(F.min("section_path").alias("section_path"))
    sets = hierarchy.nested_sets(segments, "id", "parent_segment_id", with_path=True)
    return stored.join(sets, "id").select(F.col("id").alias("segment_id"), "root_id", "depth", "size", "lo", F.array_join(F.col("path").cast("array<string>"), "/").alias("full_path"), "section_path")


@register(
    _WALK
    + """
, whole AS (SELECT id FROM w GROUP BY id HAVING bool_or(nxt IS NULL))
SELECT w.seen[-1] AS ancestor_id, w.id AS descendant_id, w.depth::BIGINT AS distance FROM w JOIN whole USING (id) WHERE w.depth > 0
"""
)
def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.nested_sets(table(spark, sf_dir, "document_segments"), "id", "parent_segment_id"))


# ---- text search

_VIEW = """
WITH v AS (
  SELECT DISTINCT s.id, s.document_id, s.content, s.section_title, s.section_path, d.title, d.version, d.is_library_doc
  FROM document_segments s JOIN documents d ON d.doc_id = s.document_id
)
"""


def _like(term: str) -> str:
    return " OR ".join(f"contains(lower(coalesce({c}, '')), '{term}')" for c in ("content", "title", "section_title"))


def _search_sql(query: str, limit: int, where: str = "TRUE", per: str = "section_path", min_score: float = 0.0) -> str:
    terms = text.query_terms(query)
    cases = []
    for i, t in enumerate(terms):
        inside = f"contains(lower(content), '{t}')"
        cases.append(f"WHEN {inside} AND contains(lower(coalesce(section_title, '')), '{t}') THEN {10 - 0.5 * i}")
        cases.append(f"WHEN {inside} AND contains(lower(coalesce(title, '')), '{t}') THEN {8 - 0.5 * i}")
        cases.append(f"WHEN {inside} THEN {5 - 0.5 * i}")
    return (
        _VIEW
        + f""", hits AS (SELECT *, (CASE {" ".join(cases)} ELSE 0.5 END)::DOUBLE AS score FROM v WHERE ({" OR ".join(_like(t) for t in terms)}) AND {where}),
one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY document_id, section_path ORDER BY id) = 1),
best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY {per} ORDER BY score DESC, document_id, id) = 1)
SELECT id, document_id, section_path, score FROM best WHERE score >= {min_score} ORDER BY score DESC, document_id, id LIMIT {limit}"""
    )


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.segment_view(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"))


@register(_search_sql(TERMS, 20))
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"), TERMS, search.SearchOptions(limit=20)).select("id", "document_id", "section_path", "score")


@register(_search_sql("collector", 50, "version = 'latest'", "document_id, section_path", 1.0))
def text_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = search.SearchOptions(limit=50, dedup="document_section", filters=(F.col("version") == "latest",), min_score=1.0)
    return search.find(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"), "collector", options).select("id", "document_id", "section_path", "score")


@register(_search_sql("caching retries", 100, "TRUE", "document_id, section_path"))
def text_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find(table(spark, sf_dir, "document_segments"), table(spark, sf_dir, "documents"), "caching retries", search.SearchOptions(limit=100, dedup="document_section")).select("id", "document_id", "section_path", "score")


@register(_VIEW + ", one AS (SELECT * FROM v WHERE is_library_doc QUALIFY row_number() OVER (PARTITION BY section_path ORDER BY id) = 1) SELECT id, document_id, section_path FROM one ORDER BY id LIMIT 50")
def filter_only_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filter_only(_view(spark, sf_dir), search.SearchOptions(limit=50, filters=(F.col("is_library_doc"),))).select("id", "document_id", "section_path")


@register(
    _VIEW
    + """, hits AS (SELECT id, 5.0::DOUBLE AS score FROM v WHERE contains(lower(content), 'collector')),
ctx AS (SELECT id, 0.9::DOUBLE AS c FROM v WHERE contains(lower(content), 'nightly collector'))
SELECT h.id, coalesce(c, score) AS score, c IS NOT NULL AS is_contextual FROM hits h LEFT JOIN ctx USING (id) ORDER BY is_contextual DESC, score DESC, id LIMIT 100"""
)
def contextual_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir)
    hits = view.where(F.contains(F.lower("content"), F.lit("collector"))).select("id", F.lit(5.0).alias("score")).distinct()
    context = view.where(F.contains(F.lower("content"), F.lit("nightly collector"))).select("id", F.lit(0.9).alias("context_score")).distinct()
    return search.contextual_first(hits, context, 100)


# ---- vectors

_VECTORS = """
WITH v AS (SELECT DISTINCT id, document_id, embedding::DOUBLE[] AS e FROM document_segments WHERE len(embedding) = 64),
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1),
w AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0)
"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@register(_VECTORS + "SELECT w.id, w.document_id, round(list_cosine_similarity(w.e, q.e), 6) AS score FROM w, q ORDER BY list_cosine_similarity(w.e, q.e) DESC, w.id LIMIT 20")
def vector_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "document_segments")
    near = vector.knn(vector.vectors_of(segments), _query_vector(spark, sf_dir), 20)
    return vector.beside(near, segments, "document_id").select("id", "document_id", F.round("score", 6).alias("score"))


@register(_VECTORS + "SELECT v.id, v.document_id, round(1 / (1 + list_distance(v.e, q.e)), 6) AS score FROM v, q ORDER BY list_distance(v.e, q.e), v.id LIMIT 20")
def vector_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "document_segments")
    near = vector.knn(vector.vectors_of(segments), _query_vector(spark, sf_dir), 20, "l2")
    return vector.beside(near, segments, "document_id").select("id", "document_id", F.round("score", 6).alias("score"))


@register(
    _VECTORS
    + "SELECT w.id, w.document_id, round(list_cosine_similarity(w.e, q.e), 6) AS score FROM w JOIN documents d ON d.doc_id = w.document_id, q WHERE d.version = 'latest' AND list_cosine_similarity(w.e, q.e) >= 0.05 ORDER BY list_cosine_similarity(w.e, q.e) DESC, w.id LIMIT 20"
)
def vector_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "documents").where(F.col("version") == "latest").select(F.col("doc_id").alias("document_id"))
    segments = table(spark, sf_dir, "document_segments")
    vectors = vector.vectors_of(segments).join(latest, "document_id", "left_semi")
    near = vector.knn(vectors, _query_vector(spark, sf_dir), 20, min_score=0.05)
    return vector.beside(near, segments, "document_id").select("id", "document_id", F.round("score", 6).alias("score"))


@register(
    _VECTORS
    + """, qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 20)
SELECT query_id, w.id, round(list_cosine_similarity(w.e, qs.e), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(w.e, qs.e) DESC, w.id)::INT AS rank
FROM w, qs QUALIFY rank <= 5"""
)
def vector_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest segments to each of twenty stated query vectors."""
    queries = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < 20).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.knn_batch(vector.vectors_of(table(spark, sf_dir, "document_segments")), queries, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register(
    _VECTORS
    + """, qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, w.id, round(list_cosine_similarity(w.e, qs.e), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(w.e, qs.e) DESC, w.id)::INT AS rank
FROM w, qs QUALIFY rank <= 5"""
)
def vector_knn_batch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest segments to every query vector whose id is divisible by 50, in blocks; brute force in test_edges is its twin."""
    queries = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.knn_batch(vector.vectors_of(table(spark, sf_dir, "document_segments")), queries, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# ---- sections

_TITLED = """
WITH RECURSIVE s AS (SELECT DISTINCT id, document_id, section_title, section_path, section_level, position, content FROM document_segments WHERE section_title IS NOT NULL AND section_path <> '')
"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.titled(table(spark, sf_dir, "document_segments"))


@register(
    _TITLED
    + """, one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY document_id, section_path ORDER BY id) = 1),
l AS (SELECT c.*, p.id AS parent_id FROM one c LEFT JOIN one p ON p.document_id = c.document_id AND contains(c.section_path, '.') AND p.section_path = regexp_replace(c.section_path, '\\.[^.]*$', '')),
k AS (SELECT parent_id, count(*) AS n FROM l WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT document_id, id, section_title, section_path, len(string_split(section_path, '.'))::INT AS depth, l.parent_id, coalesce(k.n, 0) AS children FROM l LEFT JOIN k ON k.parent_id = l.id"""
)
def section_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.toc(_titled(spark, sf_dir))


@register(
    _TITLED
    + """, u AS (SELECT document_id, id, string_split(section_path, '.') AS p, unnest(range(1, len(string_split(section_path, '.')))) AS n FROM s)
SELECT u.document_id, u.id, a.id AS ancestor_id, (len(u.p) - u.n)::INT AS distance FROM u JOIN s a ON a.document_id = u.document_id AND a.section_path = array_to_string(u.p[1:u.n], '.')"""
)
def section_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.ancestors(_titled(spark, sf_dir))


@register(_TITLED + "SELECT id, section_path FROM s WHERE document_id = 1 AND (section_path = '1' OR starts_with(section_path, '1.'))")
def section_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.subtree(_titled(spark, sf_dir), 1, "1").select("id", "section_path")


@register(
    _TITLED
    + """, n AS (SELECT *, list_transform(string_split(section_path, '.'), lambda x: coalesce(try_cast(x AS INT), -1)) AS k FROM s)
SELECT document_id, id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM n WINDOW w AS (PARTITION BY document_id ORDER BY k, id)"""
)
def section_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.neighbours(_titled(spark, sf_dir))


@register(
    _TITLED
    + """, h AS (SELECT *, CASE WHEN contains(lower(content), 'cache') THEN 2.0 ELSE 1.0 END AS score FROM s WHERE contains(lower(content), 'collector') OR contains(lower(content), 'cache'))
SELECT document_id, section_path, count(*) AS match_count, sum(score)::DOUBLE AS total_score, avg(score)::DOUBLE AS avg_score, arg_min(section_title, id) AS section_title, arg_min(section_level, id) AS section_level FROM h GROUP BY 1, 2"""
)
def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("content")
    hits = _titled(spark, sf_dir).where(F.contains(low, F.lit("collector")) | F.contains(low, F.lit("cache"))).withColumn("score", F.when(F.contains(low, F.lit("cache")), 2.0).otherwise(1.0))
    return sections.roll_up(hits)


@register(_TITLED + "SELECT id, section_path FROM s WHERE contains(lower(section_title), 'reference')")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.find_by_title(_titled(spark, sf_dir), "reference").select("id", "section_path")


@register(
    _TITLED
    + "SELECT id, section_path FROM s WHERE contains(lower(section_title), 'collector') OR contains(lower(content), 'collector') ORDER BY CASE WHEN contains(lower(section_title), 'collector') THEN 0 ELSE 1 END, section_path, id LIMIT 50"
)
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.search(_titled(spark, sf_dir), "collector", "all", 50).select("id", "section_path")


@register(
    _TITLED
    + """, u AS (SELECT *, CASE WHEN contains(section_path, '.') THEN regexp_replace(section_path, '\\.[^.]*$', '') ELSE '' END AS up FROM s)
SELECT a.document_id, a.id, b.id AS sibling_id FROM u a JOIN u b ON a.document_id = b.document_id AND a.up = b.up AND a.id <> b.id WHERE contains(lower(a.section_title), 'overview')"""
)
def section_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings of the sections called overview; ``section_sibling_groups`` has the groups of all."""
    all_ = _titled(spark, sf_dir)
    return sections.siblings(all_, all_.where(F.contains(F.lower("section_title"), F.lit("overview"))))


@register(
    _TITLED
    + """, u AS (SELECT document_id, id, CASE WHEN contains(section_path, '.') THEN regexp_replace(section_path, '\\.[^.]*$', '') ELSE '' END AS parent_path FROM s)
SELECT document_id, parent_path, id, count(*) OVER (PARTITION BY document_id, parent_path) - 1 AS siblings FROM u"""
)
def section_sibling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sibling_groups(_titled(spark, sf_dir))


# ---- catalog


@register("SELECT doc_id, title, url FROM documents ORDER BY scraped_at DESC NULLS LAST, doc_id LIMIT 25 OFFSET 50")
def list_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(table(spark, sf_dir, "documents"), 25, 50).select("doc_id", "title", "url")


@register("SELECT doc_id, title, url FROM documents WHERE contains(lower(coalesce(title, '')), 'reference') OR contains(lower(url), 'reference') ORDER BY scraped_at DESC NULLS LAST, doc_id LIMIT 100")
def list_documents_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page(table(spark, sf_dir, "documents"), 100, 0, "Reference").select("doc_id", "title", "url")


@register("SELECT doc_id FROM documents d WHERE version = 'latest' AND contains(lower(title), 'the') AND updated_at >= TIMESTAMP '2023-06-01' AND library_id IN (SELECT id FROM libraries WHERE is_available)")
def documents_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = catalog.document_filter(table(spark, sf_dir, "documents"), version="latest", title_contains="the", updated_after="2023-06-01 00:00:00")
    usable = table(spark, sf_dir, "libraries").where("is_available").select(F.col("id").alias("library_id"))
    return documents.join(usable, "library_id", "left_semi").select("doc_id")


_TAGS = """
WITH t AS (SELECT DISTINCT doc_id AS document_id, lower(trim(tag)) AS tag FROM (SELECT doc_id, unnest([lang, source, CASE WHEN is_library_doc THEN 'library' END]) AS tag FROM documents) WHERE trim(tag) <> '')
"""


@register(_TAGS + "SELECT tag, count(document_id) AS documents FROM t GROUP BY 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tag_counts(catalog.document_tags(table(spark, sf_dir, "documents")))


@register(_TAGS + "SELECT DISTINCT document_id FROM t WHERE tag IN ('de', 'library')")
def docs_any_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.documents_with_any(catalog.document_tags(table(spark, sf_dir, "documents")), ["DE ", "library"])


@register(_TAGS + "SELECT doc_id AS document_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT tag FROM t WHERE tag IN ('en', 'library', 'no such tag')) x WHERE NOT EXISTS (SELECT 1 FROM t y WHERE y.document_id = d.doc_id AND y.tag = x.tag))")
def docs_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return catalog.documents_with_all(documents, catalog.document_tags(documents), ["en", "library", "no such tag"])


_MEMBERS = """
WITH m AS (SELECT l.name AS collection, d.doc_id AS document_id, (row_number() OVER (PARTITION BY l.name ORDER BY d.scraped_at NULLS LAST, d.doc_id) - 1)::INT AS position FROM documents d JOIN libraries l ON l.id = d.library_id)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_members(table(spark, sf_dir, "documents"), table(spark, sf_dir, "libraries"))


@register(_MEMBERS + "SELECT n.name AS collection, count(m.document_id) AS documents FROM (SELECT DISTINCT name FROM libraries) n LEFT JOIN m ON m.collection = n.name GROUP BY 1")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_counts(_members(spark, sf_dir), table(spark, sf_dir, "libraries"))


@register(_MEMBERS + "SELECT collection, document_id, position FROM m")
def collection_docs_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("collection", "document_id", "position")


@register(_MEMBERS + "SELECT collection, max(position) + 1 AS next_position FROM m GROUP BY 1")
def collection_next_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.next_position(_members(spark, sf_dir))


@register(_MEMBERS + "SELECT doc_id FROM documents WHERE doc_id IN (SELECT document_id FROM m WHERE collection = (SELECT min(name) FROM libraries))")
def collection_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "libraries").agg(F.min("name").alias("collection"))
    members = _members(spark, sf_dir).join(F.broadcast(first), "collection", "left_semi")
    return table(spark, sf_dir, "documents").join(members.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id")


_CLASS = "CASE WHEN version = 'stable' THEN 0 WHEN regexp_matches(version, '^[0-9].*\\.[0-9].*\\.[0-9]') THEN 1 WHEN regexp_matches(version, '^[0-9].*\\.[0-9]') THEN 2 ELSE 3 END"


@register(f"SELECT id, name, version FROM libraries WHERE version <> 'latest' AND coalesce(is_available, TRUE) QUALIFY row_number() OVER (PARTITION BY name ORDER BY {_CLASS}, version DESC, last_checked DESC NULLS LAST, id) = 1")
def latest_library_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_versions(table(spark, sf_dir, "libraries")).select("id", "name", "version")


@register("SELECT id, name, version FROM libraries WHERE (contains(lower(name), 'a') OR contains(lower(coalesce(doc_url, '')), 'a')) AND coalesce(is_available, FALSE) ORDER BY name, version DESC, id LIMIT 20")
def search_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_libraries(table(spark, sf_dir, "libraries"), "A").select("id", "name", "version")


@register("SELECT id, name, version FROM libraries WHERE lower(name) = (SELECT lower(min(name)) FROM libraries) ORDER BY version DESC, id LIMIT 1")
def find_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    libraries = table(spark, sf_dir, "libraries")
    return catalog.find_library(libraries, libraries.agg(F.min("name")).first()[0]).select("id", "name", "version")


@register(
    """SELECT 'documents' AS table_name, count(*) AS rows FROM documents UNION ALL SELECT 'document_segments', count(*) FROM document_segments UNION ALL SELECT 'libraries', count(*) FROM libraries
UNION ALL SELECT 'raw_pages', count(*) FROM raw_pages UNION ALL SELECT 'scraping_analysis_results', count(*) FROM scraping_analysis_results"""
)
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.store_counts(**{n: table(spark, sf_dir, n) for n in ("documents", "document_segments", "libraries", "raw_pages", "scraping_analysis_results")})


@register(
    "SELECT doc_id, title, coalesce(n, 0) AS segments FROM documents LEFT JOIN (SELECT document_id, count(*) AS n FROM (SELECT DISTINCT id, document_id FROM document_segments) GROUP BY 1) ON document_id = doc_id ORDER BY segments DESC, doc_id LIMIT 20"
)
def per_document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.segments_per_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "document_segments"))


@register("SELECT count(DISTINCT url) AS urls, count(DISTINCT string_split(url, '/')[3]) AS domains FROM documents")
def unique_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count_distinct("url").alias("urls"), F.count_distinct(F.split("url", "/")[2]).alias("domains"))


@register(
    """WITH o AS (SELECT id, max(CASE WHEN len(embedding) > 0 THEN 1 ELSE 0 END) AS has, min(document_id) AS document_id FROM document_segments GROUP BY id)
SELECT count(*) AS total, sum(has)::BIGINT AS with_vector, count(DISTINCT CASE WHEN has = 1 THEN document_id END) AS documents, round(sum(has) * 100.0 / count(*), 2)::DOUBLE AS percent FROM o"""
)
def context_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage(table(spark, sf_dir, "document_segments"))


def _sql_seconds(column: str) -> str:
    return f"(floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(timezone('UTC', {column}))))"


@register(
    f"""SELECT CASE WHEN last_checked IS NULL THEN 'outdated' WHEN s < 7 * 86400 THEN 'fresh' WHEN s < 30 * 86400 THEN 'stale' ELSE 'outdated' END AS status, count(*) AS libraries, round(avg(s / 86400), 1) AS avg_age_days
FROM (SELECT *, {_sql_seconds("last_checked")} AS s FROM libraries) GROUP BY 1"""
)
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cache_statistics(table(spark, sf_dir, "libraries"), as_of())


@register(
    f"""SELECT doc_id, CASE WHEN scraped_at IS NULL THEN 'unknown' WHEN floor(s / 86400) <= 7 THEN 'fresh' WHEN floor(s / 86400) <= 30 THEN 'recent' WHEN floor(s / 86400) <= 90 THEN 'stale' ELSE 'outdated' END AS level,
coalesce(floor(s / 86400) > 90, TRUE) AS should_update FROM (SELECT *, {_sql_seconds("scraped_at")} AS s FROM documents)"""
)
def freshness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = F.col("scraped_at")
    return table(spark, sf_dir, "documents").select("doc_id", freshness.display_level(then, as_of()).alias("level"), freshness.should_update(then, as_of()).alias("should_update"))


def _unit(n: str, unit: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '1 {unit} ago' ELSE ({n})::BIGINT || ' {unit}s ago' END"


@register(
    f"""SELECT doc_id, CASE WHEN scraped_at IS NULL THEN 'unknown' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN {_unit("floor(s / 60)", "minute")} WHEN s < 86400 THEN {_unit("floor(s / 3600)", "hour")}
WHEN s < 7 * 86400 THEN {_unit("floor(s / 86400)", "day")} WHEN s < 30 * 86400 THEN {_unit("floor(floor(s / 86400) / 7)", "week")} WHEN s < 365 * 86400 THEN {_unit("floor(floor(s / 86400) / 30)", "month")} ELSE {_unit("floor(floor(s / 86400) / 365)", "year")} END AS age
FROM (SELECT *, {_sql_seconds("scraped_at")} AS s FROM documents)"""
)
def freshness_format_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", freshness.age_text(F.col("scraped_at"), as_of()).alias("age"))


@register(
    f"""SELECT doc_id, status FROM (SELECT doc_id, scraped_at, CASE WHEN coalesce(is_library_doc, FALSE) THEN 'fresh' WHEN scraped_at IS NULL THEN 'outdated' WHEN s < 7 * 86400 THEN 'fresh' WHEN s < 30 * 86400 THEN 'stale' ELSE 'outdated' END AS status
FROM (SELECT *, {_sql_seconds("scraped_at")} AS s FROM documents)) WHERE status IN ('stale', 'outdated') ORDER BY scraped_at NULLS FIRST, doc_id LIMIT 50"""
)
def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stale_documents(table(spark, sf_dir, "documents"), as_of(), 50).select("doc_id", "status")


@register(
    """WITH p AS (SELECT *, regexp_replace(lower(url), '/v?\\d+(\\.\\d+)*(/|$)|/(stable|latest)(/|$)', '\\2\\4', 'g') AS page FROM documents)
SELECT page, doc_id, version, row_number() OVER (PARTITION BY page ORDER BY scraped_at DESC NULLS LAST, doc_id DESC) = 1 AS is_latest FROM p"""
)
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.version_history(table(spark, sf_dir, "documents")).select("page", "doc_id", "version", "is_latest")


# ---- chunks and Markdown


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")


@register(
    """WITH c AS (SELECT doc_id AS document_id, text, length(text) AS n, unnest(range(0, length(text), 500)) AS start FROM documents WHERE length(text) > 0)
SELECT document_id, (start // 500 + 1)::INT AS chunk_number, ceil(n / 500)::INT AS total_chunks, start AS start_position, least(start + 500, n) AS end_position, start + 500 < n AS has_next, start > 0 AS has_prev, text[start + 1:start + 500] AS content FROM c"""
)
def char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.character_chunks(_texts(spark, sf_dir), 500)


@register(
    """WITH RECURSIVE d AS (SELECT DISTINCT document_id, id, coalesce(section_path, '') AS p, section_path, length(content) AS n FROM document_segments),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY p, id, n) AS k FROM d),
w AS (SELECT document_id, id, section_path, n, k, 1 AS chunk_number, n AS held FROM o WHERE k = 1
UNION ALL SELECT o.document_id, o.id, o.section_path, o.n, o.k, CASE WHEN w.held + o.n > 2000 THEN w.chunk_number + 1 ELSE w.chunk_number END, CASE WHEN w.held + o.n > 2000 THEN o.n ELSE w.held + o.n END FROM w JOIN o ON o.document_id = w.document_id AND o.k = w.k + 1)
SELECT document_id, id, section_path, chunk_number, held - n AS start, held AS end FROM w"""
)
def section_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_packs(table(spark, sf_dir, "document_segments"), 2_000)


@register()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_chunks(table(spark, sf_dir, "document_segments"), 2_000)


@register()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_chunks(_texts(spark, sf_dir), "paragraph", 1_000)


@register()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_chunks(_texts(spark, sf_dir), "semantic", 1_000)


@register()
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_chunks(_texts(spark, sf_dir), "stream", 1_000, 100)


@register()
def markdown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.segment_markdown(_texts(spark, sf_dir))


@register()
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections_of(_texts(spark, sf_dir))


# ---- extraction and references


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_segments").select("document_id", F.col("id").alias("segment_id"), "content").distinct()


def _defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents with each assignment of a call (``x = name(``) written as a definition (``def name(``), as the tables' code defines nothing."""
    return _contents(spark, sf_dir).withColumn("content", F.regexp_replace("content", r"(?m)^\w+ = (\w+)\(", "def $1("))


_DEFINED = "(SELECT document_id, segment_id, regexp_replace(content, '(?m)^\\w+ = (\\w+)\\(', 'def \\1(', 'g') AS content FROM (SELECT DISTINCT document_id, id AS segment_id, content FROM document_segments))"
_REFERENCE_FORMS = (
    ("function", r"\b(\w+)\s*\("), ("function", r"`(\w+)\(\)`"), ("function", r"`(\w+)\(`"), ("class", r"\bclass\s+(\w+)"), ("class", r"`(\w+)`\s+class"), ("class", r"\b([A-Z]\w+)\s+class"),
    ("method", r"\.(\w+)\s*\("), ("method", r"`\.(\w+)\(\)`"), ("module", r"import\s+(\w+)"), ("module", r"from\s+(\w+)\s+import"), ("module", r"`(\w+)`\s+module"),
)
_REFERENCES = (
    " UNION ALL ".join(f"SELECT document_id, segment_id, '{kind}' AS reference_type, unnest(regexp_extract_all(content, '(?i){form}', 1)) AS reference_text, 0.8 AS confidence FROM s" for kind, form in _REFERENCE_FORMS)
    + """ UNION ALL SELECT document_id, segment_id, 'method', regexp_extract(m, '(\\w+)\\.(\\w+)', 1) || '.' || regexp_extract(m, '(\\w+)\\.(\\w+)', 2), 0.8 FROM (SELECT document_id, segment_id, unnest(regexp_extract_all(content, '\\b\\w+\\.\\w+\\s*\\(')) AS m FROM s)
UNION ALL SELECT document_id, segment_id, 'link', regexp_extract(m, '\\[([^\\]]+)\\]', 1), 1.0 FROM (SELECT document_id, segment_id, unnest(regexp_extract_all(content, '\\[[^\\]]+\\]\\([^)]+\\)')) AS m FROM s) WHERE contains(m, '](#')"""
)


@register("WITH s AS (SELECT DISTINCT document_id, id AS segment_id, content FROM document_segments) SELECT segment_id, reference_type, reference_text, confidence::DOUBLE AS confidence FROM (" + _REFERENCES + ")")
def extract_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.reference_names(_contents(spark, sf_dir))


@register()
def references_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with the text around them; tests compare it with ``extract_references``."""
    return extract.references(_contents(spark, sf_dir))


_ANCHORS = (
    "WITH s AS "
    + _DEFINED
    + """,
a AS (
  SELECT document_id, segment_id, 'function' AS anchor_type, regexp_extract(m, '(?:def|function)\\s+(\\w+)\\s*\\(([^)]*)\\)', 1) AS anchor_name, regexp_extract(m, '(?:def|function)\\s+(\\w+)\\s*\\(([^)]*)\\)', 1) || '(' || regexp_extract(m, '(?:def|function)\\s+(\\w+)\\s*\\(([^)]*)\\)', 2) || ')' AS anchor_signature
  FROM (SELECT document_id, segment_id, unnest(regexp_extract_all(content, '(?:def|function)\\s+\\w+\\s*\\([^)]*\\)')) AS m FROM s)
  UNION ALL
  SELECT document_id, segment_id, 'class', regexp_extract(m, 'class\\s+(\\w+)', 1), m FROM (SELECT document_id, segment_id, unnest(regexp_extract_all(content, 'class\\s+\\w+(?:\\s*\\([^)]*\\))?')) AS m FROM s)
  UNION ALL
  SELECT document_id, segment_id, 'method', regexp_extract(m, 'def\\s+(\\w+)', 1), NULL FROM (SELECT document_id, segment_id, unnest(regexp_extract_all(content, '(?m)^\\s{4,}def\\s+\\w+\\s*\\(')) AS m FROM s)
)
"""
)


@register(_ANCHORS + "SELECT * FROM a")
def extract_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of the contents in which assigned calls are written as definitions."""
    return extract.anchors(_defined(spark, sf_dir))


@register(
    "WITH s AS (SELECT DISTINCT document_id, id AS segment_id, content FROM document_segments) SELECT segment_id, name, count(*) AS times FROM (SELECT segment_id, unnest(regexp_extract_all(content, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS name FROM s) WHERE name NOT IN ('if', 'for', 'while', 'with') GROUP BY 1, 2"
)
def called_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _contents(spark, sf_dir).select("segment_id", F.explode(extract.called_names(F.col("content"))).alias("name"))
    return names.groupBy("segment_id", "name").agg(F.count(F.lit(1)).alias("times"))


_LINKS = """
WITH s AS (SELECT DISTINCT document_id, id AS segment_id, content FROM document_segments),
l AS (SELECT document_id, segment_id, regexp_extract(m, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 1) AS text, regexp_extract(m, '\\[([^\\]]+)\\]\\(([^)\\s]+)\\)', 2) AS target FROM (SELECT document_id, segment_id, unnest(regexp_extract_all(content, '\\[[^\\]]+\\]\\([^)\\s]+\\)')) AS m FROM s))
"""


@register(_LINKS + "SELECT segment_id, text, target FROM l")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select("segment_id", F.explode(extract.markdown_links(F.col("content"))).alias("m")).select("segment_id", "m.text", "m.target")


@register(
    """WITH s AS (SELECT DISTINCT id AS segment_id, content FROM document_segments), c AS (SELECT segment_id, unnest(regexp_extract_all(content, '(?s)```\\w*[^\\n]*\\n.*?```')) AS m FROM s)
SELECT regexp_extract(m, '(?s)```(\\w*)[^\\n]*\\n(.*?)```', 1) AS language, count(*) AS blocks, sum(length(regexp_extract(m, '(?s)```(\\w*)[^\\n]*\\n(.*?)```', 2)))::BIGINT AS characters FROM c GROUP BY 1"""
)
def code_block_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _contents(spark, sf_dir).select(F.explode(extract.code_blocks(F.col("content"))).alias("b"))
    return blocks.groupBy(F.col("b.language").alias("language")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("b.code")).alias("characters"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = _defined(spark, sf_dir)
    homes = contents.select("document_id", "segment_id")
    return crossrefs.resolve(extract.reference_names(contents).join(homes, "segment_id"), extract.anchors(contents))


_RESOLVED = (
    _ANCHORS
    + ", r AS (SELECT DISTINCT x.document_id, x.segment_id, x.reference_type, x.reference_text FROM ("
    + _REFERENCES
    + """) x),
k AS (SELECT anchor_name, anchor_type, document_id, segment_id FROM a UNION ALL SELECT anchor_name, 'link', document_id, segment_id FROM a),
near AS (SELECT anchor_name, anchor_type, document_id, max(segment_id) AS local_id FROM k GROUP BY ALL),
far AS (SELECT anchor_name, anchor_type, segment_id AS far_id, document_id AS far_document FROM k QUALIFY row_number() OVER (PARTITION BY anchor_name, anchor_type ORDER BY segment_id DESC, document_id DESC) = 1),
t AS (SELECT r.document_id, r.segment_id, r.reference_type, r.reference_text, coalesce(local_id, far_id) AS target_segment_id, CASE WHEN local_id IS NULL THEN far_document ELSE r.document_id END AS target_document_id
FROM r JOIN far ON far.anchor_name = r.reference_text AND far.anchor_type = r.reference_type LEFT JOIN near ON near.anchor_name = r.reference_text AND near.anchor_type = r.reference_type AND near.document_id = r.document_id)
"""
)


@register(_RESOLVED + "SELECT * FROM t")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@register("SELECT doc_id, md5(text) AS md5_hex, sha256(text) AS sha_hex, coalesce(content_hash = sha256(text), FALSE) AS hash_holds FROM documents WHERE text IS NOT NULL")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("md5_hex"), digest.alias("sha_hex"), F.coalesce(F.col("content_hash") == digest, F.lit(False)).alias("hash_holds"))


@register("SELECT doc_id, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '[^a-zA-Z0-9]', '_', 'g') || '_' || md5(url) AS name FROM documents WHERE url IS NOT NULL")
def storage_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("url").isNotNull()).select("doc_id", text.storage_name(F.col("url")).alias("name"))


def _sql_label(column: str, rules, default: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {chr(39)}{n}{chr(39)})' for n in needles)} THEN '{name}'" for name, needles in rules)
    return f"CASE {cases} ELSE {default} END"


@register(f"SELECT DISTINCT id, {_sql_label('content', text.ROLE_MARKS, chr(39) + 'general' + chr(39))} AS role, {_sql_label('section_title', text.TITLE_KINDS, 'NULL')} AS title_kind FROM document_segments")
def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_segments").select("id", text.semantic_role(F.col("content")).alias("role"), text.title_kind(F.col("section_title")).alias("title_kind")).distinct()


_PLAIN = "trim(regexp_replace(regexp_replace(content, '[#*`_\\[\\]()]', '', 'g'), '\\s+', ' ', 'g'))"


@register(f"SELECT DISTINCT id, CASE WHEN length({_PLAIN}) > 100 THEN {_PLAIN}[1:100] || '...' ELSE {_PLAIN} END AS preview FROM document_segments")
def segment_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_segments").select("id", text.preview(F.col("content")).alias("preview")).distinct()


@register(
    "SELECT DISTINCT s.id, concat_ws(' | ', 'Document: ' || d.title, 'Section L' || coalesce(section_level, 0) || ': ' || section_title, 'Type: ' || segment_type) AS line FROM document_segments s JOIN documents d ON d.doc_id = s.document_id"
)
def metadata_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "document_segments").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "title"), "document_id")
    return both.select("id", text.metadata_line(F.col("title"), F.col("section_title"), F.col("section_level"), F.col("segment_type")).alias("line")).distinct()


def _sql_score() -> str:
    path_ = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
    plus = " + ".join(f"CASE WHEN regexp_matches({path_}, '{p}') THEN 3 ELSE 0 END" for p in urls.DOC_PATHS)
    minus = " + ".join(f"CASE WHEN regexp_matches({path_}, '{p}') THEN 5 ELSE 0 END" for p in urls.OTHER_PATHS)
    api = f"CASE WHEN contains({path_}, '/api/') AND regexp_matches({path_}, 'reference|docs|v1|v2') THEN 3 ELSE 0 END"
    deep = f"CASE WHEN length({path_}) - length(replace({path_}, '/', '')) > 6 THEN 2 ELSE 0 END"
    return f"greatest(-10, least(10, {plus} - ({minus}) + {api} - {deep})) / 10.0"


@register(f"SELECT doc_id, ({_sql_score()})::DOUBLE AS score FROM documents WHERE url IS NOT NULL")
def url_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("url").isNotNull()).select("doc_id", urls.document_score(urls.path(F.col("url"))).cast("double").alias("score"))


@register()
def link_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawler from each page's host root would do with the page."""
    base = F.concat(F.lit("https://"), urls.domain(F.col("url")), F.lit("/docs"))
    return table(spark, sf_dir, "documents").where(F.col("url").isNotNull()).select("doc_id", urls.link_decision(F.col("url"), base, 2).alias("d")).select("doc_id", "d.*")


# ---- pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").where(F.col("html_path").isNotNull()).groupBy("html_path").agg(F.min("url").alias("url"))
    return html.pages(table(spark, sf_dir, "raw_pages").join(paths, "html_path", "left").select("page_id", "url", "html").distinct())


@register()
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, metadata, kind of site, headings, code, tables and Markdown of each stored page."""
    return _pages(spark, sf_dir)


def _link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of the Markdown links of each segment at its document's address, as the stored pages link only to themselves."""
    links = F.transform(extract.markdown_links(F.col("content")), lambda m: F.concat(F.lit('<a href="'), m["target"], F.lit('">x</a>')))
    at = table(spark, sf_dir, "documents").where(F.col("url").isNotNull()).groupBy(F.col("doc_id").alias("document_id")).agg(F.min("url").alias("url"))
    rows = _contents(spark, sf_dir).where(F.contains("content", F.lit("](/"))).join(at, "document_id")
    return html.pages(rows.select(F.col("segment_id").alias("page_id"), "url", F.array_join(links, "\n").alias("html")))


@register(
    _LINKS
    + """SELECT DISTINCT segment_id AS page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*') || target AS link FROM l JOIN documents d ON d.doc_id = l.document_id
WHERE starts_with(target, '/') AND segment_id IN (SELECT id FROM document_segments WHERE contains(content, '](/'))"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to other pages of their site, in full."""
    links = _link_pages(spark, sf_dir).select("page_id", "url", F.explode("links").alias("link"))
    return links.where(urls.domain(F.col("link")) == urls.domain(F.col("url"))).select("page_id", "link").distinct()


@register()
def page_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.posexplode("codes").alias("position", "c")).select("page_id", "position", "c.language", "c.code")


@register("SELECT DISTINCT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM raw_pages WHERE html IS NOT NULL")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.btrim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return table(spark, sf_dir, "raw_pages").where(F.col("html").isNotNull()).select("page_id", title.alias("title")).distinct()


@register(
    """SELECT DISTINCT analysis_id, requests.status_code AS status_code, extraction.detected_type AS detected_type, round(extraction.detection_confidence, 6) AS confidence, len(requests.headings) AS headings
FROM scraping_analysis_results WHERE requests.error IS NULL"""
)
def analysis_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scraping_analysis_results").where(F.col("requests.error").isNull())
    size = F.when(F.col("requests.headings").isNotNull(), F.size("requests.headings")).cast("long")
    return rows.select("analysis_id", "requests.status_code", "extraction.detected_type", F.round("extraction.detection_confidence", 6).alias("confidence"), size.alias("headings")).distinct()


@register("SELECT extraction.detected_type AS kind, count(DISTINCT analysis_id) AS analyses, sum(CASE WHEN extraction.has_code_examples THEN 1 ELSE 0 END)::BIGINT AS with_code FROM (SELECT DISTINCT * FROM scraping_analysis_results) GROUP BY 1")
def analysis_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "scraping_analysis_results").distinct()
    return rows.groupBy(F.col("extraction.detected_type").alias("kind")).agg(F.count_distinct("analysis_id").alias("analyses"), F.sum(F.when(F.col("extraction.has_code_examples"), 1).otherwise(0)).alias("with_code"))


@register()
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content scores of the stored pages and how deep a crawl would go on from them."""
    rows = table(spark, sf_dir, "raw_pages").where(F.col("html").isNotNull()).select("page_id", crawl.content_scores(F.col("html")).alias("s")).distinct()
    return rows.select("page_id", F.round("s.code_density", 6).alias("code_density"), "s.api_indicators", F.round("s.navigation_ratio", 6).alias("navigation_ratio"), F.round("s.overall", 6).alias("overall"), crawl.depth_after(F.col("s.overall"), 2).alias("depth"))


@register()
def links_to_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that a crawl would follow and that no document has yet."""
    links = _link_pages(spark, sf_dir).select(F.col("url").alias("page"), F.posexplode("links").alias("position", "link"))
    return crawl.next_links(links, table(spark, sf_dir, "documents").select("url"), 2, per_page=20)


# spelled out here, so that an error in the code's tables shows
_KIND_WORDS = (
    ("API Reference", "api reference method function class".split()), ("Tutorial/Guide", ["tutorial", "guide", "getting started", "quickstart", "intro"]), ("Examples", "example sample demo usage".split()),
    ("Setup/Config", "install setup configuration config".split()), ("Troubleshooting", "troubleshoot debug error problem issue".split()),
)
_LEVEL_WORDS = (("Beginner", ["beginner", "basic", "intro", "getting started", "quickstart"]), ("Advanced", "advanced expert complex in-depth".split()), ("Intermediate", "intermediate moderate".split()))
_SECTION_WORDS = (
    ("overview", ["overview", "introduction", "getting started", "about"]), ("installation", "installation install setup requirements".split()), ("usage", ["usage", "examples", "quick start", "tutorial"]),
    ("api", "api reference methods functions classes".split()), ("configuration", "configuration config settings options".split()), ("faq", ["faq", "frequently asked questions", "troubleshooting"]),
    ("changelog", ["changelog", "release notes", "history", "versions"]),
)


def _kinds_sql(rules, start: int) -> str:
    low = f"lower(concat_ws(chr(10), section_title, content[1:{start}]))"
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'contains({low}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}' END" for name, words in rules)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


@register(f"SELECT DISTINCT id, {_kinds_sql(_KIND_WORDS, 500)} AS kinds, {_kinds_sql(_LEVEL_WORDS, 500)} AS levels, {_sql_label('section_title', _SECTION_WORDS, 'NULL')} AS section_type FROM document_segments")
def content_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, content = F.col("section_title"), F.col("content")
    rows = table(spark, sf_dir, "document_segments")
    return rows.select("id", F.array_join(labels.content_kinds(title, content), ",").alias("kinds"), F.array_join(labels.complexity_levels(title, content), ",").alias("levels"), labels.section_type(title).alias("section_type")).distinct()


@register("SELECT id, coalesce(nullif(regexp_extract(doc_url, 'v(\\d+\\.\\d+\\.\\d+)', 1), ''), nullif(regexp_extract(doc_url, '(\\d+\\.\\d+\\.\\d+)', 1), ''), nullif(regexp_extract(doc_url, '(\\d+\\.\\d+)', 1), ''), 'latest') AS documented FROM libraries")
def documented_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "libraries").select("id", labels.documented_version(F.col("doc_url")).alias("documented"))


@register(
    """WITH u AS (SELECT doc_id, url, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, regexp_extract(url, '^https?://(?:[^/?#@]*@)?[^/?#:]+:(\\d+)', 1) AS port FROM documents)
SELECT doc_id, coalesce(length(url) <= 2048 AND host <> '' AND host <> 'localhost' AND NOT regexp_matches(host, '^(10\\.|127\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2\\d|3[01])\\.)') AND port NOT IN ('22', '23', '25', '3306', '5432', '6379') AND host <> 'test' AND NOT suffix(host, '.test'), FALSE) AS fetchable FROM u"""
)
def fetchable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", checks.fetchable(F.col("url"), ["test"]).alias("fetchable"))


@register("SELECT id, section_path, position FROM document_segments WHERE document_id = 1 QUALIFY row_number() OVER (PARTITION BY id) = 1")
def segments_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.segments_of(table(spark, sf_dir, "document_segments"), 1).select("id", "section_path", "position")


@register("SELECT d.doc_id FROM documents d WHERE url = (SELECT min(url) FROM documents) ORDER BY doc_id LIMIT 1")
def document_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lookups.document_by_url(documents, documents.agg(F.min("url")).first()[0]).select("doc_id")


@register()
def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_chunks(_texts(spark, sf_dir), "index", 500)


# ---- suggestions and summaries


@register(
    """WITH s AS (SELECT DISTINCT document_id, id AS segment_id, content FROM document_segments WHERE contains(content, 'collector')),
n AS (SELECT document_id, segment_id, unnest(regexp_extract_all(content, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS identifier FROM s),
f AS (SELECT * FROM n WHERE identifier NOT IN ('if', 'for', 'while', 'with', 'collector') AND length(identifier) > 2), t AS (SELECT identifier, count(*) AS times FROM f GROUP BY 1)
SELECT DISTINCT identifier, document_id, segment_id, least(1.0, 0.5 + times * 0.1)::DOUBLE AS score FROM f JOIN t USING (identifier)"""
)
def suggest_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.co_occurring(_contents(spark, sf_dir), "collector")


def _category_sql() -> str:
    parts = []
    for category, words in (("file_operations", "read write open save load file path"), ("configuration", "config settings environment parameter option")):
        hits = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words.split())
        parts.append(f"SELECT '{category}' AS category, id, ({hits})::INT AS match_count FROM s")
    return f"""WITH s AS (SELECT DISTINCT id, lower(concat_ws(' ', content, section_title)) AS low FROM document_segments), m AS ({" UNION ALL ".join(parts)})
SELECT category, id, match_count FROM m WHERE match_count > 0 QUALIFY row_number() OVER (PARTITION BY category ORDER BY match_count DESC, id) <= 25"""


@register(_category_sql())
def suggest_category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "document_segments").select("id", "content", "section_title").distinct()
    return suggest.category_matches(segments, suggest.task_categories("load a config file"), 25)


@register(
    """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(content, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS identifier FROM document_segments),
k AS (SELECT identifier, list_distinct(string_split(lower(identifier), '')) AS a, list_distinct(string_split('readcollector', '')) AS b FROM n WHERE identifier NOT IN ('if', 'for', 'while', 'with', 'readCollector')),
z AS (SELECT identifier, CASE WHEN lower(identifier) = 'readcollector' THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS s, lower(identifier) AS low FROM k)
SELECT identifier, round(s * 0.7, 6)::DOUBLE AS score, CASE WHEN contains(low, 'get') THEN replace(low, 'get', 'set') WHEN contains(low, 'set') THEN replace(low, 'set', 'get') WHEN contains(low, 'open') THEN replace(low, 'open', 'close') WHEN contains(low, 'create') THEN replace(low, 'create', 'delete') END AS opposite FROM z WHERE s > 0.5"""
)
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like readCollector among the called names, with the opposite of each."""
    names = _contents(spark, sf_dir).select(F.explode(extract.called_names(F.col("content"))).alias("identifier"))
    return suggest.similar_names(names, "readCollector").select("identifier", F.round("score", 6).alias("score"), suggest.paired_name(F.col("identifier")).alias("opposite"))


_SUMMARY_WORDS = {
    "overview": "introduction overview description purpose what is this library about getting started quickstart",
    "installation": "installation setup install pip requirements how to dependencies prerequisites",
    "functions": "api functions methods interface function reference method signatures public",
    "examples": "code examples usage snippets how to use example sample demonstrations",
    "classes": "class reference objects types documentation interfaces object oriented api",
    "parameters": "parameters arguments options configuration function method settings",
    "errors": "error handling exceptions troubleshooting common errors issues problems debugging messages",
}


def _summary_sql() -> str:
    parts = []
    for category, words in _SUMMARY_WORDS.items():
        hits = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words.split())
        parts.append(f"SELECT document_id, '{category}' AS category, id, ({hits})::INT AS matches FROM s")
    return f"""WITH s AS (SELECT DISTINCT id, document_id, lower(concat_ws(' ', content, section_title)) AS low FROM document_segments), m AS ({" UNION ALL ".join(parts)}),
b AS (SELECT document_id, category, id, matches FROM m WHERE matches > 0 QUALIFY row_number() OVER (PARTITION BY document_id, category ORDER BY matches DESC, id) <= 3)"""


def _section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.section_summary(table(spark, sf_dir, "document_segments").select("id", "document_id", "content", "section_title").distinct())


@register(_summary_sql() + " SELECT * FROM b")
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _section_summary(spark, sf_dir)


@register(_summary_sql() + " SELECT document_id, id, max(matches) AS matches FROM b GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY max(matches) DESC, id) <= 10")
def key_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best sections of each document over all categories, each once."""
    return summarise.key_sections(_section_summary(spark, sf_dir))


@register()
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.summaries(_texts(spark, sf_dir))


@register()
def usage_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.usage_patterns(summarise.summaries(_texts(spark, sf_dir)))


@register()
def relevant_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.relevant_snippets(table(spark, sf_dir, "document_segments"), ["collector", "nightly"])


@register(
    """SELECT doc_id AS document_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '\\*\\*([^*\\n]+)\\*\\*', 1), regexp_extract_all(text, '`([A-Za-z_][\\w.]*)`', 1)))) AS concepts FROM documents WHERE text IS NOT NULL"""
)
def key_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where(F.col("text").isNotNull()).select("document_id", extract.key_concepts(F.col("text")).alias("concepts"))


@register("SELECT DISTINCT id, regexp_replace(regexp_replace(content, '(?i)\\b(collector)\\b', '**\\1**', 'g'), '(?i)\\b(nightly)\\b', '**\\1**', 'g') AS content FROM document_segments WHERE contains(lower(content), 'collector')")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "document_segments").where(F.contains(F.lower("content"), F.lit("collector")))
    return rows.select("id", text.highlight(F.col("content"), ["collector", "nightly"]).alias("content")).distinct()


# ---- versions, exports, changes


@register()
def version_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.differences(versions.consecutive(table(spark, sf_dir, "documents")))


@register(
    """WITH v AS (SELECT doc_id, regexp_extract(version, '^v?(\\d+)(?:\\.(\\d+))?(?:\\.(\\d+))?$', ['a', 'b', 'c']) AS m FROM documents), n AS (SELECT doc_id, try_cast(m.a AS INT) AS a, coalesce(try_cast(m.b AS INT), 0) AS b, coalesce(try_cast(m.c AS INT), 0) AS c FROM v)
SELECT doc_id, unnest([concat_ws('.', a, b, c + 1), concat_ws('.', a, b + 1, 0), concat_ws('.', a + 1, 0, 0)]) AS candidate FROM n WHERE a IS NOT NULL"""
)
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.next_versions(table(spark, sf_dir, "documents"))


@register(
    """SELECT doc_id, coalesce(nullif(regexp_extract(url, '(?i)/v?(\\d+\\.\\d+(?:\\.\\d+)?(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(url, '(?i)/(\\d+\\.\\d+(?:\\.\\d+)?(?:\\.\\d+)?)/', 1), ''),
nullif(regexp_extract(url, '(?i)version[=/](\\d+\\.\\d+(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(url, '(?i)tag[=/]v?(\\d+\\.\\d+(?:\\.\\d+)?)', 1), '')) AS number FROM documents"""
)
def url_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version in each document's URL; null where there is none, as in all of these tables (``versioned_urls`` has some)."""
    return table(spark, sf_dir, "documents").select("doc_id", urls.url_version(F.col("url")).alias("number"))


@register("SELECT doc_id, '# ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(text, '') AS body FROM documents")
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.export_rows(table(spark, sf_dir, "documents"), "markdown")


@register()
def export_llms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An llms.txt for each library."""
    named = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "libraries").select(F.col("id").alias("library_id"), "name"), "library_id")
    return llms.render(named.where(F.col("url").isNotNull()).select("name", "doc_id", "title", "url", F.lit(None).cast("string").alias("description")), "name")


@register("SELECT doc_id, version FROM documents WHERE url IS NULL OR version IS NULL UNION ALL SELECT doc_id, version FROM documents WHERE url IS NOT NULL AND version IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url, version ORDER BY scraped_at DESC NULLS LAST, doc_id DESC) = 1")
def ingested_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the earlier ingests of the same URL and version."""
    documents = table(spark, sf_dir, "documents")
    keyed = F.col("url").isNotNull() & F.col("version").isNotNull()
    kept = mutations.keep_latest(documents.where(keyed), ["url", "version"], [F.desc_nulls_last("scraped_at"), F.desc("doc_id")])
    return kept.unionByName(documents.where(~keyed)).select("doc_id", "version")


@register("SELECT DISTINCT s.id FROM document_segments s WHERE s.document_id NOT IN (SELECT doc_id FROM documents WHERE is_library_doc)")
def segments_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment ids left when the library documents are deleted with their children."""
    documents = table(spark, sf_dir, "documents")
    left = mutations.delete_documents({"segments": table(spark, sf_dir, "document_segments")}, documents.where("is_library_doc").select(F.col("doc_id").alias("document_id")), {"segments": "document_id"})
    return left["segments"].select("id").distinct()


@register("SELECT DISTINCT id, coalesce(section_title, CASE WHEN regexp_matches(lower(coalesce(segment_type, '')), '^h[1-6]$') THEN content ELSE 'Introduction' END) AS section_title, coalesce(section_path, position::VARCHAR) AS section_path, coalesce(section_level, 1) AS section_level FROM document_segments")
def segment_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.with_segment_defaults(table(spark, sf_dir, "document_segments")).select("id", "section_title", "section_path", "section_level").distinct()


# ---- requests


@register(
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS minute_count,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS hour_count FROM events"""
)
def rate_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.window_counts(table(spark, sf_dir, "events"), "user_id").select("event_id", "minute_count", "hour_count")


@register("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.per_minute(table(spark, sf_dir, "events")).select(F.col("minute").cast("timestamp_ntz").alias("minute"), "event_type", "n", F.round("total", 4).alias("total"))


@register(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.sessions(table(spark, sf_dir, "events"), "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def event_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.timings(table(spark, sf_dir, "events")).select("event_type", "n", F.round("total", 4).alias("total"), "least", "most", F.round("mean", 6).alias("mean"))


@register("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


from folioforge import queries_more, queries_store  # noqa: E402, F401  these register further queries in the same table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
