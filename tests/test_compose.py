"""Compositions, chunk lookups and updates against plain restatements."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioforge import queries as core
from folioforge.functions import extract, labels, text, urls
from folioforge.operators import catalog, chunking, compose, search, suggest, summarise, versions
from folioforge.sources import dependencies


def values(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


# ---- search


def test_first_source_with_rows(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = lambda *s: sorted((r["id"], r["source"]) for r in compose.first_source(*s).collect())
    assert got(("a", rows()), ("b", rows(1, 2)), ("c", rows(3))) == [(1, "b"), (2, "b")]
    assert got(("a", rows(5)), ("b", rows(1))) == [(5, "a")]
    assert got(("a", rows()), ("b", rows())) == []


def test_search_falls_back(spark):
    segments = spark.createDataFrame(
        [(1, 10, "alpha text", "Head", "1", 1, "p", 0), (2, 10, "beta text", "Head", "2", 1, "p", 1), (3, 11, "gamma", None, None, 1, "p", 0)],
        "id long, document_id long, content string, section_title string, section_path string, section_level int, segment_type string, position int",
    )
    documents = spark.createDataFrame([(10, "T", "u", "1", 5, True, None, None), (11, "S", "v", "2", None, False, None, None)], "doc_id long, title string, url string, version string, library_id long, is_library_doc boolean, scraped_at timestamp, updated_at timestamp")
    libraries = spark.createDataFrame([(5, "lib")], "id long, name string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, embedding array<double>")
    view = search.segment_view(segments, documents, libraries)
    options = search.SearchOptions(limit=5, min_score=0.6)
    near = compose.search_segments(view, "beta", options, vectors, [1.0, 0.0]).collect()
    # of equal paths one, without a path none
    assert [(r["id"], r["score"], r["source"]) for r in near] == [(1, 1.0, "vector")]
    words = compose.search_segments(view, "beta", options, vectors.where("id < 0"), [1.0, 0.0]).collect()
    assert [(r["id"], r["source"]) for r in words] == [(2, "text")]
    listed = compose.search_segments(view, "nothing", search.SearchOptions(limit=5, filters=(F.col("library_name") == "lib",))).collect()
    assert [(r["id"], r["source"]) for r in listed] == [(1, "listing"), (2, "listing")]


def test_results_by_document(spark):
    hits = spark.createDataFrame([(1, 10, "T", "1", 2.0), (2, 10, "T", "1", 5.0), (3, 10, "T", None, 1.0), (4, 11, None, "2", 9.0)], "id long, document_id long, title string, section_path string, score double")
    got = [(r["document_id"], r["title"], [(s["section_path"], list(s["ids"])) for s in r["sections"]], r["hits"], r["score"]) for r in compose.by_document(hits).collect()]
    assert got == [(11, "Untitled", [("2", [4])], 1, 9.0), (10, "T", [("0", [3]), ("1", [1, 2])], 3, 5.0)]


# ---- names and suggestions


def test_identifiers(spark):
    code = "import os\nclass Reader:\n    def load(self): self.x.parse(Make(1)); go(2)\n"
    assert [tuple(r) for r in values(spark, [(code,), (None,)], "c string", extract.identifiers(F.col("c")))[0]] == [("load", "function"), ("parse", "function"), ("Reader", "class"), ("parse", "method"), ("os", "module")]
    assert values(spark, [("  f( a ,b )  ¶ ",)], "c string", extract.clean_signature(F.col("c"))) == ["f( a, b )"]


def test_reference_names_equal_references(spark, sf_dir):
    contents = core._contents(spark, sf_dir)
    ascii_only = contents.where(~F.col("content").rlike(r"[^\x00-\x7f]"))
    columns = ("segment_id", "reference_type", "reference_text", "confidence")
    count = lambda df: {tuple(r[:4]): r["count"] for r in df.groupBy(*columns).count().collect()}
    assert count(extract.reference_names(ascii_only)) == count(extract.references(ascii_only))


def test_suggestions_from_all_sources(spark):
    segments = spark.createDataFrame(
        [(1, 1, "Reading", "use read_file(x) here"), (1, 2, "Other", "mentions read file plainly"), (2, 3, "Writing", "def write_file(y)"), (2, 4, "None", "nothing of the kind")], "document_id long, segment_id long, section_title string, content string"
    )
    documents = spark.createDataFrame([(1, "Guide"), (2, "Files")], "doc_id long, title string")
    anchors = spark.createDataFrame([(2, 3, "function", "write_file", "write_file(y)"), (1, 1, "function", "read_file", "read_file(x)")], "document_id long, segment_id long, anchor_type string, anchor_name string, anchor_signature string")
    resolved = spark.createDataFrame([(1, 2, "function", "write_file", 3, 2)], "document_id long, segment_id long, reference_type string, reference_text string, target_segment_id long, target_document_id long")
    query = "read file"
    got = [(r["identifier"], r["kind"], r["document_id"], round(r["score"], 4)) for r in compose.suggestions(segments, documents, anchors, resolved, query, 10).collect()]
    # by category: words read, file and the category's read, write; three or more of four in each
    terms = ["read", "file", "read", "write"]
    rows = [("Guide", "Reading", "use read_file(x) here", 1), ("Guide", "Other", "mentions read file plainly", 1), ("Files", "Writing", "def write_file(y)", 2)]
    best = {}
    for title, head, body, document in rows:
        matches = sum(any(t in part.lower() for part in (title, head, body)) for t in terms)
        for name in re.findall(r"\b(\w+)\s*\(", body):
            score = min(0.9, 0.4 + 0.15 * matches)
            score = min(1.0, score + 0.2) if any(w in name for w in query.split()) else score
            key = (name, "function", document)
            best[key] = max(best.get(key, 0), score)
    # what the segment that mentions the query refers to
    best["write_file", "function", 2] = max(best["write_file", "function", 2], 0.8)
    expected = sorted(((*k, round(v, 4)) for k, v in best.items()), key=lambda r: (-r[3], r[0]))
    assert got == expected
    assert compose.suggestions(segments.limit(0), documents, anchors.limit(0), resolved.limit(0), query).count() == 0


def test_definitions_and_references(spark):
    anchors = spark.createDataFrame([(1, 1, "function", "run", None), (1, 2, "class", "run", "class run")], "document_id long, segment_id long, anchor_type string, anchor_name string, anchor_signature string")
    documents = spark.createDataFrame([(1, "T")], "doc_id long, title string")
    segments = spark.createDataFrame([(1, 1, "A"), (2, 1, "B")], "segment_id long, document_id long, section_title string")
    found = compose.find_definitions(anchors, documents, segments, "run").orderBy("segment_id").collect()
    assert [(r["segment_id"], r["section_title"], r["signature"]) for r in found] == [(1, "A", "run"), (2, "B", "class run")]
    assert compose.find_definitions(anchors, documents, segments, "run", "class").count() == 1
    references = spark.createDataFrame([(2, "function", "run")], "segment_id long, reference_type string, reference_text string")
    assert [(r["segment_id"], r["title"]) for r in compose.find_references(references, documents, segments, "run").collect()] == [(2, "T")]


# ---- chunks


def packs_of(rows, size):
    """Greedy packing of (document, id, path, length) in path order."""
    out = {}
    by_document = defaultdict(list)
    for document, i, path, n in rows:
        by_document[document].append((path or "", i, n))
    for document, sections in by_document.items():
        chunk, held, first = 1, 0, True
        for _, i, n in sorted(sections):
            if held + n > size and not first:
                chunk, held = chunk + 1, 0
            held, first = held + n, False
            out[document, i] = chunk
    return out


def test_chunk_navigation_on_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/document_segments.parquet").select("document_id", "id", "section_path", F.length("content")).distinct().collect()]
    chunk = packs_of(rows, 5_000)
    order = defaultdict(list)
    for document, i, path, n in rows:
        order[document].append((path or "", i, path))
    expected = set()
    for document, sections in order.items():
        sections.sort()
        for k, (_, i, path) in enumerate(sections):
            before, after = sections[k - 1] if k else None, sections[k + 1] if k + 1 < len(sections) else None
            expected.add((document, i, path, chunk[document, i], before and before[2], before and chunk[document, before[1]], after and after[2], after and chunk[document, after[1]]))
    assert {tuple(r) for r in core.queries()["chunk_navigation"](spark, sf_dir).collect()} == expected


def test_a_document_of_many_sections_is_packed(spark):
    rows = [(1, k, f"{k:05d}", 30 + k % 50) for k in range(4_000)] + [(2, 9_000 + k, str(k), 10) for k in range(3)]
    df = spark.createDataFrame([(d, i, p, "x" * n) for d, i, p, n in rows], "document_id long, id long, section_path string, content string")
    got = {(r["document_id"], r["id"]): r["chunk_number"] for r in chunking.section_packs(df, 500).collect()}
    assert got == packs_of(rows, 500)


def test_lookups_in_a_chunk_index(spark):
    df = spark.createDataFrame([(1, 1, "1", "a" * 4), (1, 2, "2", "b" * 8), (1, 3, "3", "")], "document_id long, id long, section_path string, content string")
    spans = chunking.section_spans(df, 5)
    assert {(r["id"], tuple(r["chunk_numbers"]), r["primary_chunk"], r["start"], r["end"]) for r in spans.collect()} == {(1, (1,), 1, 0, 4), (2, (1, 2, 3), 1, 4, 12), (3, (), 1, 12, 12)}
    assert {r["id"] for r in chunking.sections_in_chunk(spans, 1).collect()} == {1, 2} and {r["id"] for r in chunking.sections_in_chunk(spans, 3).collect()} == {2}
    assert [tuple(r) for r in chunking.section_chunk(spans, 1, "2").collect()] == [(2, 1)]
    assert [tuple(r) for r in chunking.section_chunk(chunking.section_packs(df, 5), 1, "2").collect()] == [(2, 2)]


# ---- store


AS_OF = "2025-01-10 00:00:00"


def test_updates(spark):
    now = F.lit(AS_OF).cast("timestamp")
    rows = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2025-01-09', false, 'old', TIMESTAMP '2024-01-01'), (2L, TIMESTAMP '2024-12-20', false, 'old', NULL), (3L, NULL, true, 'old', NULL) AS t(doc_id, last_checked, is_pinned, staleness_status, scraped_at)")
    status = lambda df: {r["doc_id"]: r["staleness_status"] for r in df.collect()}
    assert status(catalog.update_staleness(rows, now)) == {1: "fresh", 2: "stale", 3: "fresh"}
    assert status(catalog.mark_checked(rows, F.col("doc_id") == 2, now)) == {1: "fresh", 2: "fresh", 3: "fresh"}
    fetched = catalog.mark_updated(rows, F.col("doc_id") == 2, now)
    assert status(fetched) == {1: "old", 2: "fresh", 3: "old"} and fetched.where("doc_id = 2 AND scraped_at = last_checked").count() == 1
    assert status(catalog.pin(rows, F.col("doc_id") == 1)) == {1: "fresh", 2: "old", 3: "fresh"}
    assert values(spark, [("2025-01-09",), ("2025-01-03",), (None,)], "d string", catalog.check_due(F.col("d").cast("timestamp"), now)) == [False, True, True]


def test_parts_of_a_query(spark):
    rows = spark.createDataFrame([(1, "a", "1"), (2, "b", "2"), (3, "a", "2")], "id long, lang string, version string")
    assert [r[0] for r in catalog.Select(rows).columns("id").where("version", "=", "2").order_by("id", "DESC").limit(1).build().collect()] == [3]
    assert {tuple(r) for r in catalog.Select(rows).group_by("lang").build().collect()} == {("a", 2), ("b", 1)}
    assert catalog.Select(rows).where_in("lang", []).build().count() == 3
    assert catalog.Select(rows).join(rows.select("id").limit(0), "id").build().count() == 0
    for call in (lambda: catalog.Select(rows).order_by("id", "down"), lambda: catalog.Select(rows).columns("nothing")):
        with pytest.raises(ValueError):
            call()


def test_encoded_columns(spark):
    assert values(spark, [('["a","b"]',), ("",), ("{",), (None,)], "t string", catalog.tags_from_json(F.col("t"))) == [["a", "b"], [], [], []]
    assert values(spark, [(["a"],), (None,)], "t array<string>", catalog.tags_to_json(F.col("t"))) == ['["a"]', None]
    assert values(spark, [(1, None)], "a int, b string", catalog.text_values({"a": F.col("a"), "b": F.col("b")})) == [{"a": "1"}]


# ---- labels, URLs, dependencies


def test_more_labels(spark):
    pairs = [("Basics", "x"), (None, "def f():"), (None, "plain")]
    assert values(spark, pairs, "t string, c string", labels.complexity(F.col("t"), F.col("c"))) == ["Beginner", "Technical (contains code)", None]
    assert values(spark, pairs, "t string, c string", labels.reading_level(F.col("t"), F.col("c"))) == ["Beginner", "Technical", "Intermediate"]
    assert values(spark, [("x" * 201,), ("# y",)], "c string", text.result_preview(F.col("c"))) == ["x" * 200 + "...", "# y"]


def test_versions_in_urls(spark):
    forms = ["https://a.org/V1.2.3.4/x", "https://a.org/1.2", "https://a.org/?version=3.4.5", "https://a.org/Tag=v6.7", "https://a.org/v2/", None]
    assert values(spark, [(u,) for u in forms], "u string", urls.url_version(F.col("u"))) == ["1.2.3.4", "1.2", "3.4.5", "6.7", None, None]
    paths = ["docs/a.txt", "x/B.MD", "a.rst", "README.md", "sub/readme.md", "src/a.py"]
    assert values(spark, [(p,) for p in paths], "p string", urls.repository_document(F.col("p"))) == [True, True, True, False, True, False]


def test_npm_versions():
    cases = {"^1.2.0": "^1.2.0", "1.0 beta": "1.0", ">=1 <2": ">=1 <2", "1.2 - 2.3": "1.2 - 2.3", "1 || 2": "1 || 2", "git+ssh://x": "", "user/repo": "", "file:../a": "", "https://x/y.tgz": "", "npm:other@^3": "^3", "*": "*", "latest": "latest", "workspace:*": "", "v2.0.0": "v2.0.0"}
    assert {k: dependencies.npm_version(k) for k in cases} == cases


# ---- summaries and versions


def test_more_of_a_summary():
    body = """# T

def run(a):
    :param a: the value
    :returns: a number

The following example shows a simple call.

```python
import x
run(1)
```

Usage:
run it twice in a row

>>> run(2)
4

💡 Keep the value small in every call.

Warning: this may crash the process. Solution: restart the process first.
"""
    got = summarise.summary(body)
    assert got["parameters"][0] == {"function": "run", "name": "a", "description": "the value"}
    assert got["returns"] == [{"function": "run", "description": "a number"}]
    first = got["examples"][0]
    assert first["is_complete"] and first["complexity"] == "basic" and "following example shows" in first["description"]
    assert {e["language"] for e in got["examples"]} == {"python", "usage", "session"}
    assert any("small" in p["text"] for p in got["practices"])
    assert any(p["severity"] == "error" and p["solution"].startswith("restart the process") for p in got["pitfalls"])
    assert "## Functions" in summarise.format_summary(got) and "```python" in summarise.format_summary(got)
    assert summarise.format_summary(summarise.summary("")) == ""


def test_versions_in_a_row(spark):
    rows = [(1, "https://a/v1/x", "one", "2024-01-01"), (2, "https://a/v2/x", "one", "2024-01-02"), (3, "https://a/v3/x", "two", "2024-01-03"), (4, "https://a/y", "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "doc_id long, url string, text string, at string").withColumn("scraped_at", F.col("at").cast("timestamp"))
    got = {(r["old_id"], r["new_id"]): (r["similarity"], r["change"]) for r in versions.differences(versions.consecutive(df)).collect()}
    assert got[1, 2] == (1.0, "no significant changes") and got[2, 3][0] == pytest.approx(2 / 6) and set(got) == {(1, 2), (2, 3)}


def test_similar_names_need_half_of_their_characters(spark):
    names = spark.createDataFrame([("abc",), ("abcd",), ("xyz",)], "identifier string")
    assert {(r["identifier"], round(r["score"], 4)) for r in suggest.similar_names(names, "abc").collect()} == {("abcd", 0.525)}
