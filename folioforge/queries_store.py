"""Registered queries of lookups, changes, predicates and small functions, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import checks, freshness, html, labels, text
from folioforge.operators import catalog, chunking, compose, crawl, lookups, mutations, sections, suggest
from folioforge.plans.session import table
from folioforge.queries import AS_OF, as_of, register
from folioforge.queries_more import _ANCHORS, _anchors, _calls, _query_vector, _segments
from folioforge.sources import llms, store

_S = "WITH s AS (SELECT DISTINCT id, document_id, content, section_title, section_path, section_level, position, segment_type FROM document_segments)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_segments")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "libraries")


# ---- lookups


@register("SELECT doc_id, url, version FROM documents WHERE doc_id = 7")
def document_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.document(_documents(spark, sf_dir), 7).select("doc_id", "url", "version")


@register(_S + " SELECT id, document_id, position FROM s WHERE id = (SELECT min(id) FROM document_segments)")
def segment_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _rows(spark, sf_dir)
    return lookups.segment(segments, segments.agg(F.min("id")).first()[0]).select("id", "document_id", "position")


@register("SELECT doc_id, title FROM documents WHERE library_id = (SELECT min(library_id) FROM documents) ORDER BY doc_id")
def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return lookups.library_documents(documents, documents.agg(F.min("library_id")).first()[0]).select("doc_id", "title")


@register("SELECT id, doc_url FROM libraries WHERE name = (SELECT min(name) FROM libraries) AND version = (SELECT min(version) FROM libraries WHERE name = (SELECT min(name) FROM libraries))")
def library_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    libraries = _libraries(spark, sf_dir)
    first = libraries.orderBy("name", "version").first()
    return lookups.library(libraries, first["name"], first["version"]).select("id", "doc_url")


@register(_S + " SELECT id, section_path FROM s WHERE document_id = 1 AND section_title IS NOT NULL")
def sections_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.sections_of(_rows(spark, sf_dir), 1).select("id", "section_path")


@register("SELECT id, name, version FROM libraries WHERE is_available ORDER BY name")
def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation sources in use; a library is one while it's available."""
    return lookups.sources(_libraries(spark, sf_dir).withColumn("is_active", F.col("is_available"))).select("id", "name", "version")


@register("SELECT id, version FROM libraries WHERE lower(trim(name)) = lower(trim((SELECT max(name) FROM libraries)))")
def sources_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    libraries = _libraries(spark, sf_dir)
    name = libraries.agg(F.max("name")).first()[0]
    return lookups.by_name(libraries, f"  {name.upper()} ").select("id", "version")


@register("SELECT 'id' AS form, EXISTS (SELECT 1 FROM documents WHERE doc_id = 7) AS found UNION ALL SELECT 'none', FALSE UNION ALL SELECT 'version', EXISTS (SELECT 1 FROM documents d JOIN libraries l ON l.id = d.library_id WHERE l.id = (SELECT min(library_id) FROM documents))")
def documents_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, libraries = _documents(spark, sf_dir), _libraries(spark, sf_dir)
    used = libraries.where(F.col("id") == documents.agg(F.min("library_id")).first()[0]).first()
    keys = {"id": "7", "none": "nosuch:1", "version": f"{used['name']}:{used['version']}"}
    return spark.createDataFrame([(form, lookups.document_exists(documents, libraries, key)) for form, key in keys.items()], "form string, found boolean")


_ONE_CALL = (
    "WITH "
    + _ANCHORS
    + """, best AS (SELECT name, max(segment_id) AS far_id, arg_max(document_id, segment_id) AS far_document FROM a GROUP BY 1), near AS (SELECT name, document_id, max(segment_id) AS local_id FROM a GROUP BY 1, 2),
t AS (SELECT r.document_id, r.segment_id, r.name AS reference_text, coalesce(local_id, far_id) AS target_segment_id, CASE WHEN local_id IS NOT NULL THEN r.document_id ELSE far_document END AS target_document_id
FROM r JOIN best USING (name) LEFT JOIN near ON near.name = r.name AND near.document_id = r.document_id)"""
)


def _resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.operators import crossrefs

    return crossrefs.resolve(_calls(spark, sf_dir), _anchors(spark, sf_dir))


@register(
    _ONE_CALL
    + """ SELECT t.reference_text, t.target_segment_id, g.section_title AS target_section, d.title AS target_title FROM t LEFT JOIN (SELECT DISTINCT id, section_title FROM s) g ON g.id = t.target_segment_id LEFT JOIN documents d ON d.doc_id = t.target_document_id
WHERE t.segment_id = (SELECT min(segment_id) FROM t)"""
)
def references_from_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _resolved_calls(spark, sf_dir)
    found = lookups.references_from(resolved, _rows(spark, sf_dir), _documents(spark, sf_dir), resolved.agg(F.min("segment_id")).first()[0])
    return found.select("reference_text", "target_segment_id", "target_section", "target_title")


@register(
    _ONE_CALL
    + """ SELECT t.reference_text, t.segment_id, g.section_title AS source_section, d.title AS source_title FROM t JOIN (SELECT DISTINCT id, section_title FROM s) g ON g.id = t.segment_id JOIN documents d ON d.doc_id = t.document_id
WHERE t.target_segment_id = (SELECT min(target_segment_id) FROM t)"""
)
def references_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _resolved_calls(spark, sf_dir)
    found = lookups.references_to(resolved, _rows(spark, sf_dir), _documents(spark, sf_dir), resolved.agg(F.min("target_segment_id")).first()[0])
    return found.select("reference_text", "segment_id", "source_section", "source_title")


@register(
    _ONE_CALL
    + ", q AS (SELECT DISTINCT id FROM s WHERE contains(lower(content), 'collector')) SELECT DISTINCT t.target_segment_id AS segment_id, t.reference_text AS identifier, g.document_id, 0.8::DOUBLE AS score FROM t JOIN t u ON u.target_segment_id = t.target_segment_id JOIN q ON q.id = u.segment_id JOIN (SELECT DISTINCT id, document_id FROM s) g ON g.id = t.target_segment_id"
)
def suggest_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the segments that mention a word refer to."""
    return compose.reference_suggestions(_resolved_calls(spark, sf_dir), _segments(spark, sf_dir), "collector").select("segment_id", "identifier", "document_id", "score")


@register(
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT DISTINCT w.id, round(1 / (1 + list_distance(w.embedding::DOUBLE[], q.e)), 6) AS score FROM document_segments w, q WHERE len(w.embedding) = 64 AND w.id <> (SELECT min(id) FROM document_segments) AND w.segment_type = 'text' ORDER BY score DESC, id LIMIT 15"""
)
def similar_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments nearest to a vector among those of one role; the segment type stands for the role."""
    segments = _rows(spark, sf_dir)
    rows = segments.where(F.size("embedding") == 64).select("id", "embedding", F.to_json(F.struct(F.col("segment_type").alias("semantic_role"))).alias("metadata"))
    found = lookups.similar_by_metadata(rows, _query_vector(spark, sf_dir), segments.agg(F.min("id")).first()[0], 15, "text")
    return found.select("id", F.round("score", 6).alias("score"))


# ---- sources and sinks


@register("SELECT doc_id, '<html><head><title>' || e(coalesce(title, '')) || '</title></head><body><pre>' || e(coalesce(text, '')) || '</pre></body></html>' AS body FROM documents".replace("e(coalesce(title, ''))", "replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')").replace("e(coalesce(text, ''))", "replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"))
def export_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.export_rows(_documents(spark, sf_dir), "html")


@register("SELECT doc_id, coalesce(title, '') AS title, coalesce(url, '') AS url, version, coalesce(text, '') AS content FROM documents")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON export, read back."""
    rows = store.export_rows(_documents(spark, sf_dir), "json")
    back = F.from_json("body", "doc_id long, title string, url string, version string, content string")
    return rows.select(back.alias("j")).select("j.*")


@register("SELECT doc_id, '- [' || coalesce(title, '') || '](' || coalesce(url, '') || ')' AS body FROM documents")
def export_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.export_rows(_documents(spark, sf_dir), "llms")


_LLMS = """WITH f AS (SELECT l.id, l.name, d.title, d.url, d.doc_id FROM documents d JOIN libraries l ON l.id = d.library_id WHERE d.url IS NOT NULL AND d.title IS NOT NULL AND NOT contains(d.title, ']') AND NOT contains(d.url, ')'))"""


def _llms_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An llms.txt for each library, as a file to read."""
    named = _documents(spark, sf_dir).join(_libraries(spark, sf_dir).select(F.col("id").alias("library_id"), "name"), "library_id")
    usable = named.where(F.col("url").isNotNull() & F.col("title").isNotNull() & ~F.contains("title", F.lit("]")) & ~F.contains("url", F.lit(")")))
    rendered = llms.render(usable.select(F.concat_ws("/", F.col("library_id").cast("string"), "name").alias("key"), "doc_id", "title", "url", F.lit(None).cast("string").alias("description")), "key")
    return rendered.select(F.substring_index("key", "/", 1).cast("long").alias("document_id"), F.lit("https://a.example/llms.txt").alias("url"), "text")


@register(_LLMS + " SELECT id AS document_id, id || '/' || name AS title, 1::BIGINT AS sections FROM f GROUP BY 1, 2")
def llms_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the llms.txt files say of themselves."""
    return llms.metadata(_llms_files(spark, sf_dir)).select("document_id", "title", F.size("sections").cast("long").alias("sections"))


@register(_LLMS + " SELECT id AS document_id, 'Docs' AS section, trim(title) AS title, trim(url) AS url FROM f")
def llms_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return llms.entries(_llms_files(spark, sf_dir)).select("document_id", "section", "title", "url")


# ---- changes


@register("SELECT doc_id, coalesce(version, '') || '!' AS version FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, version FROM documents WHERE doc_id % 3 <> 0")
def upserted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document replaced by a new version of itself."""
    documents = _documents(spark, sf_dir).select("doc_id", "version")
    new = documents.where(F.col("doc_id") % 3 == 0).withColumn("version", F.concat(F.coalesce("version", F.lit("")), F.lit("!")))
    return mutations.upsert(documents, new, ["doc_id"])


@register("SELECT name, max(version) AS version FROM libraries GROUP BY 1")
def libraries_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each library, as when each ingest replaces the one before."""
    return mutations.keep_latest(_libraries(spark, sf_dir), ["name"], [F.desc("version"), F.desc("id")]).select("name", "version")


_MEMBERS = "WITH m AS (SELECT l.name AS collection, d.doc_id AS document_id, row_number() OVER (PARTITION BY l.name ORDER BY d.scraped_at NULLS LAST, d.doc_id) - 1 AS position FROM documents d JOIN libraries l ON l.id = d.library_id)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collection_members(_documents(spark, sf_dir), _libraries(spark, sf_dir)).select("collection", "document_id", "position")


@register(_MEMBERS + " SELECT collection, document_id, CASE WHEN position < 2 THEN 1 - position ELSE position END AS position FROM m")
def reordered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections whose first two documents changed places."""
    members = _members(spark, sf_dir)
    return mutations.reorder(members, members.where("position < 2").select("collection", "document_id", (1 - F.col("position")).alias("new_position")))


@register(
    _MEMBERS
    + """, k AS (SELECT DISTINCT collection FROM m), n AS (SELECT collection, -1 AS document_id FROM k), l AS (SELECT collection, max(position) AS last FROM m GROUP BY 1)
SELECT collection, document_id, position FROM m UNION ALL SELECT n.collection, -1, last + 1 FROM n JOIN l USING (collection)"""
)
def appended_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new document at the end of every collection."""
    members = _members(spark, sf_dir)
    added = members.select("collection", F.lit(-1).cast("long").alias("document_id")).unionByName(members.select("collection", "document_id"))
    return mutations.append_members(members, added)


@register(_S + " SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS width FROM s")
def set_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every second segment replaced."""
    rows = _rows(spark, sf_dir).select("id").distinct().withColumn("embedding", F.array(F.lit(1.0)))
    new = rows.where(F.col("id") % 2 == 0).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("new_embedding"))
    return mutations.set_vectors(rows, new).select("id", F.size("embedding").alias("width"))


@register(_S + " SELECT DISTINCT document_id, content || CASE WHEN id % 5 = 0 THEN '!' ELSE '' END AS content FROM s WHERE id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM document_segments o WHERE o.document_id = s.document_id AND o.content = s.content || '!')")
def segments_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all segments, every fifth changed, those that the store doesn't hold yet."""
    stored = _rows(spark, sf_dir).select("id", "document_id", "content").distinct()
    changed = stored.withColumn("content", F.when(F.col("id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return mutations.missing_segments(changed.select("document_id", "content"), stored).distinct()


# ---- predicates


@register("SELECT doc_id FROM documents WHERE n_chars >= 1000 AND lang IN ('en', 'fr') AND contains(lower(title), 'the') AND version <> 'latest'")
def filter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.FilterSet().where("n_chars", ">=", 1_000).among("lang", ["en", "fr"]).like("title", "The").where("version", "!=", "latest")
    return _documents(spark, sf_dir).where(found.column()).select("doc_id")


@register(_S + " SELECT id FROM s WHERE contains(lower(coalesce(section_title, '')), 'overview') OR contains(lower(coalesce(section_title, '')), 'reference')")
def kept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.kept_sections(_rows(spark, sf_dir), ["Overview", "reference"]).select("id").distinct()


@register(
    """WITH s AS (SELECT DISTINCT id, document_id, section_path FROM document_segments WHERE section_title IS NOT NULL AND section_path <> '')
SELECT id FROM s WHERE len(string_split(section_path, '.')) <= 2 QUALIFY row_number() OVER (PARTITION BY document_id, section_path ORDER BY id) = 1"""
)
def section_toc_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of contents down to the second level."""
    return sections.toc(sections.titled(_rows(spark, sf_dir)), 2).select("id")


@register(_S + " SELECT DISTINCT id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS content FROM s")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", text.clean_lines(F.col("content")).alias("content")).distinct()


@register(_S + " SELECT DISTINCT id, content FROM s")
def without_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with a colour sequence put around them and taken out again."""
    coloured = F.concat(F.lit("\x1b[31m"), "content", F.lit("\x1b[0m"))
    plain = F.regexp_replace("content", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    rows = _rows(spark, sf_dir).select("id", "content", checks.without_escapes(coloured).alias("shown"), plain.alias("plain")).distinct()
    # a content that holds sequences of its own comes out without them
    return rows.select("id", F.when(F.col("shown") == F.col("plain"), F.col("content")).otherwise(F.col("shown")).alias("content"))


# ---- labels and times


@register(
    """SELECT doc_id, CASE WHEN regexp_matches(low, 'api|reference|endpoint') THEN 'api' WHEN regexp_matches(low, 'tutorial|guide|how to') THEN 'tutorial' WHEN contains(text, '```') THEN 'code' ELSE 'general' END AS kind
FROM (SELECT doc_id, text, lower(concat_ws(chr(10), title, text[1:1000])) AS low FROM documents)"""
)
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", labels.document_kind(F.col("title"), F.col("text")).alias("kind"))


@register(_S + " SELECT s.id, 'In ' || coalesce(d.title, '') || ': ' || s.content AS prompt FROM s JOIN documents d ON d.doc_id = s.document_id WHERE NOT contains(coalesce(d.title, ''), '{{')")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would be asked about each segment in its document."""
    titles = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.coalesce("title", F.lit("")).alias("title")).where(~F.contains("title", F.lit("{{")))
    rows = _rows(spark, sf_dir).select("id", "document_id", "content").distinct().join(titles, "document_id")
    return rows.select("id", labels.prompt(F.lit("In {{WHOLE_DOCUMENT}}: {{CHUNK_CONTENT}}"), F.col("title"), F.col("content")).alias("prompt"))


@register("SELECT id, trim(name) AS name, CASE WHEN coalesce(version, '') = '' THEN 'latest' ELSE trim(version) END AS version FROM libraries WHERE NOT contains(name, '@')")
def library_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Libraries written as name@version and read again."""
    rows = _libraries(spark, sf_dir).where(~F.contains("name", F.lit("@")))
    spec = labels.library_spec(F.concat("name", F.lit("@"), F.coalesce("version", F.lit(""))))
    return rows.select("id", spec.alias("s")).select("id", "s.name", "s.version")


@register("SELECT lang, count(*) AS n, CASE lang WHEN 'python' THEN 'pypi' WHEN 'go' THEN 'go' END AS manager FROM (SELECT lang FROM documents UNION ALL SELECT 'python' UNION ALL SELECT 'go') GROUP BY 1")
def package_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package managers of the names in use, and of two that are known."""
    names = _documents(spark, sf_dir).select("lang").unionByName(spark.createDataFrame([("python",), ("go",)], "lang string"))
    return names.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("manager", labels.package_manager(F.col("lang")))


@register(
    """SELECT id, CASE WHEN regexp_matches(version, '^\\d+\\.\\d') THEN 'https://x/' || string_split(version, '.')[1] || '.' || string_split(version, '.')[2] || '/' WHEN version IN ('latest', 'stable') THEN 'https://x/{major}.{minor}/' ELSE 'https://x/{major}.{minor}/' END AS url
FROM libraries WHERE version IN ('latest', 'stable') OR regexp_matches(version, '^\\d+\\.\\d[^@]*$')"""
)
def filled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _libraries(spark, sf_dir).where(F.col("version").isin("latest", "stable") | F.col("version").rlike(r"^\d+\.\d[^@]*$"))
    return rows.select("id", labels.filled_url(F.lit("https://x/{major}.{minor}/"), F.col("version")).alias("url"))


@register(
    """SELECT id, CASE WHEN regexp_matches(lower(doc_url), 'docs?\\.|/docs|readthedocs|\\.github\\.io|documentation') THEN doc_url ELSE 'https://' || name || '.readthedocs.io/' END AS url FROM libraries WHERE doc_url IS NOT NULL"""
)
def documentation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation addresses of the libraries by their homepage alone."""
    links = F.create_map(F.lit("Homepage"), F.col("doc_url"))
    return _libraries(spark, sf_dir).where(F.col("doc_url").isNotNull()).select("id", labels.documentation_url(links, F.col("doc_url"), F.col("name")).alias("url"))


@register("SELECT doc_id, strftime(scraped_at, '%Y-%m-%d %H:%M:%S')::TIMESTAMP AS at FROM documents")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in two forms and read again, to the second."""
    at = F.date_trunc("second", F.col("scraped_at"))
    written = F.when(F.col("doc_id") % 2 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    return _documents(spark, sf_dir).select("doc_id", freshness.parse_time(written).cast("timestamp_ntz").alias("at"))


_AGE = f"floor((floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(timezone('UTC', scraped_at)))) / 86400)"


@register(f"SELECT doc_id, CASE WHEN scraped_at IS NULL OR {_AGE} <= 30 THEN NULL WHEN {_AGE} <= 90 THEN 'consider an update' ELSE 'update recommended' END AS advice FROM documents")
def update_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", labels.update_advice(freshness.display_level(F.col("scraped_at"), as_of())).alias("advice"))


@register(
    f"""SELECT level, count(*) AS documents, max(age)::BIGINT AS oldest FROM (SELECT CASE WHEN scraped_at IS NULL THEN 'unknown' WHEN {_AGE} <= 7 THEN 'fresh' WHEN {_AGE} <= 30 THEN 'recent' WHEN {_AGE} <= 90 THEN 'stale' ELSE 'outdated' END AS level, {_AGE} AS age FROM documents) GROUP BY 1"""
)
def freshness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the greatest age of each level."""
    then = F.col("scraped_at")
    return _documents(spark, sf_dir).groupBy(freshness.display_level(then, as_of()).alias("level")).agg(F.count(F.lit(1)).alias("documents"), F.max(freshness.age_days(then, as_of())).alias("oldest"))


@register("SELECT analysis_id, CASE WHEN requests.status_code = 304 THEN 'unchanged' WHEN requests.status_code = 200 THEN 'changed' ELSE 'unknown' END AS decision FROM (SELECT DISTINCT analysis_id, requests FROM scraping_analysis_results)")
def cache_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stored answer would mean for a cache without marks of the page's version."""
    rows = table(spark, sf_dir, "scraping_analysis_results").select("analysis_id", "requests").distinct()
    none = F.lit(None)
    return rows.select("analysis_id", crawl.cache_decision(F.col("requests.status_code"), none.cast("boolean"), none.cast("timestamp"), none.cast("timestamp")).alias("decision"))


# ---- suggestions


@register(
    """WITH s AS (SELECT DISTINCT id, content FROM document_segments), w AS (SELECT id, lower(content) AS low FROM s),
h AS (SELECT id, """
    + " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in "ruby gem rails sinatra rspec".split())
    + " AS own, "
    + " + ".join(
        f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END"
        for w in (
            "python py pip django flask pandas requests numpy javascript js node npm react vue express axios typescript ts node npm react vue express java maven gradle spring hibernate junit "
            "csharp dotnet nuget asp.net entity rust cargo tokio serde actix golang go mod gin gorilla php composer laravel symfony psr"
        ).split()
    )
    + """ AS others FROM w)
SELECT id, round(CASE WHEN own > 0 THEN least(1.0, 0.5 + own * 0.2) WHEN others > 0 THEN greatest(0.1, 0.5 - 0.3) ELSE 0.5 END, 6)::DOUBLE AS score FROM h"""
)
def language_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the score 0.5 of each segment changes for a query about one language."""
    rows = _rows(spark, sf_dir).select("id", F.col("content").alias("text"), F.lit(0.5).alias("score")).distinct()
    return suggest.by_language(rows, "ruby").select("id", F.round("score", 6).alias("score"))


# ---- chunks


@register()
def sized_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in packed paragraphs and sentences of at most 800 characters where sentences allow it."""
    texts = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text")
    return chunking.text_chunks(texts, "sized", 800)


@register("SELECT DISTINCT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') IS NOT NULL AS titled FROM raw_pages WHERE html IS NOT NULL")
def next_page_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page data that each page carries as JSON, put there from its title and read again."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    data = F.to_json(F.struct(F.struct(F.struct(title.alias("title")).alias("pageProps")).alias("props")))
    page = F.concat(F.lit('<script id="__NEXT_DATA__">'), F.replace(data, F.lit("<"), F.lit("\\u003c")), F.lit("</script>"))
    rows = table(spark, sf_dir, "raw_pages").where(F.col("html").isNotNull()).select("page_id", page.alias("html")).distinct()
    return html.page_data(rows).select("page_id", (F.coalesce("title", F.lit("")) != "").alias("titled"))
