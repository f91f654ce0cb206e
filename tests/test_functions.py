from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioforge.functions import extract, freshness, html, text, urls
from folioforge.operators import catalog, chunking, crossrefs, mutations, search, sections, suggest, summarise, vector, versions
from folioforge.sources import dependencies, llms, store

NOW = datetime(2025, 1, 1)


def values(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_query_terms():
    assert text.query_terms("Caching Retries fast") == ["caching", "retries", "fast"]
    assert text.query_terms("caching retries") == ["caching", "retries", "cach"]
    assert text.query_terms("was") == ["was"]
    assert text.query_terms("") == []


@pytest.mark.parametrize(
    ("age", "level", "status"),
    [
        (timedelta(days=7), "fresh", "stale"),
        (timedelta(days=7) - timedelta(seconds=1), "fresh", "fresh"),
        (timedelta(days=8), "recent", "stale"),
        (timedelta(days=30), "recent", "outdated"),
        (timedelta(days=31), "stale", "outdated"),
        (timedelta(days=91), "outdated", "outdated"),
    ],
)
def test_both_scales(spark, age, level, status):
    then, now = F.col("t"), F.lit(NOW)
    assert values(spark, [(NOW - age,)], "t timestamp", freshness.display_level(then, now), freshness.cache_status(then, now)) == [(level, status)]


def test_ages_in_words(spark):
    ages = {5: "just now", 60: "1 minute ago", 7200: "2 hours ago", 86400: "1 day ago", 86400 * 14: "2 weeks ago", 86400 * 60: "2 months ago", 86400 * 800: "2 years ago"}
    got = values(spark, [(NOW - timedelta(seconds=s),) for s in ages] + [(None,)], "t timestamp", freshness.age_text(F.col("t"), F.lit(NOW)))
    assert [g[0] for g in got] == [*ages.values(), "unknown"]


def test_pinned_and_unchecked(spark):
    got = values(spark, [(None, True), (None, False)], "t timestamp, p boolean", freshness.cache_status(F.col("t"), F.lit(NOW), F.col("p")))
    assert got == [("fresh",), ("outdated",)]


def test_written_times(spark):
    got = values(spark, [("2024-05-01 10:00:00",), ("2024-05-01T10:00:00",), ("soon",)], "t string", freshness.parse_time(F.col("t")))
    assert got == [(datetime(2024, 5, 1, 10),), (datetime(2024, 5, 1, 10),), (None,)]


def test_link_decisions(spark):
    base = F.lit("https://a.org/docs/v1/")
    got = values(
        spark,
        [("https://b.org/docs/",), ("https://a.org/docs/x.pdf",), ("https://a.org/docs/api/reference/x",), ("https://a.org/blog/news/x",), ("https://a.org/x",)],
        "u string",
        urls.link_decision(F.col("u"), base, 2).alias("d"),
    )
    assert [(g[0]["follow"], g[0]["reason"]) for g in got] == [(False, "other domain"), (False, "file type .pdf"), (True, "documentation path"), (False, "other path"), (True, "uncertain")]


def test_numeric_paths(spark):
    df = spark.createDataFrame([("1.10",), ("",), ("2",), ("1.2",), ("1",)], "p string")
    assert [r["p"] for r in df.orderBy(sections.path_key(F.col("p"))).collect()] == ["", "1", "1.2", "1.10", "2"]


def test_subtree_needs_the_dot(spark):
    df = spark.createDataFrame([(1, 1, "1"), (2, 1, "1.1"), (3, 1, "10")], "id long, document_id long, section_path string")
    assert {r["id"] for r in sections.subtree(df, 1, "1").collect()} == {1, 2}


def test_first_rule_wins_in_search(spark):
    view = spark.createDataFrame(
        [(1, 1, "alpha beta", "beta", "1", "t"), (2, 1, "alpha", "x", "2", "t"), (3, 1, "zzz", "alpha", "3", "t"), (4, 2, "alpha", "x", "2", "t")],
        "id long, document_id long, content string, section_title string, section_path string, title string",
    )
    got = {r["id"]: r["score"] for r in search.text_search(view, "alpha beta", search.SearchOptions(limit=9)).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 0.5}
    per_document = search.text_search(view, "alpha beta", search.SearchOptions(limit=9, dedup="document_section"))
    assert {r["id"] for r in per_document.collect()} == {1, 2, 3, 4}


def test_vector_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0])], "id long, embedding array<float>")
    got = [(r["id"], r["score"]) for r in vector.knn(df, [1.0, 0.0], 9).collect()]
    assert got == [(1, 1.0), (6, 1.0), (3, -1.0)]
    assert [r["id"] for r in vector.knn(df, [1.0, 0.0], 9, "l2").collect()] == [1, 2, 6, 3]
    assert [r["id"] for r in vector.knn(df, [1.0, 0.0], 9, min_score=0.5).collect()] == [1, 6]


def test_tag_division(spark):
    documents = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    tags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "document_id long, tag string")
    ids = lambda df: {r["document_id"] for r in df.collect()}
    assert ids(catalog.documents_with_all(documents, tags, ["A ", "b"])) == {1}
    assert ids(catalog.documents_with_all(documents, tags, ["a", "new"])) == {1, 2}
    assert ids(catalog.documents_with_all(documents, tags, ["new"])) == {1, 2, 3}
    assert ids(catalog.documents_with_all(documents, tags, ["a", "new"], strict=True)) == set()
    assert ids(catalog.documents_with_any(tags, ["b", "new"])) == {1}


def test_latest_version_order(spark):
    rows = [(1, "a", "1.9.0", True), (2, "a", "1.10.0", True), (3, "a", "latest", True), (4, "b", "2.0", True), (5, "b", "main", True), (6, "c", "stable", True), (7, "c", "9.9.9", True), (8, "a", "8.0.0", False)]
    df = spark.createDataFrame(rows, "id long, name string, version string, is_available boolean").withColumn("last_checked", F.lit(None).cast("timestamp"))
    assert {r["id"] for r in catalog.latest_versions(df).collect()} == {1, 4, 6}


def test_filters():
    with pytest.raises(ValueError):
        catalog.FilterSet().where("no_such", "=", 1)


def test_unknown_lists_filter_nothing(spark):
    df = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert df.where(catalog.FilterSet().among("doc_id", []).column()).count() == 2


def test_paragraph_packing():
    body = "aaaa\n\nbbbb\n\ncccccccccc\n\nd"
    assert [body[a:b] for a, b in chunking.paragraph_spans(body, 12)] == ["aaaa\n\nbbbb", "cccccccccc\n\nd"]


def test_semantic_spans_cover_the_text():
    body = "# A\n\ntext one\n\n```\n# not a heading\n\n- nor an item\n```\n\n- item\n- item two\n\n" + "x" * 90
    for size in (10, 25, 40, 500):
        spans = chunking.semantic_spans(body, size)
        assert spans[0][0] == 0 and spans[-1][1] == len(body)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all("not a heading" not in body[p : p + 15] for p in chunking.unit_starts(body))


def test_stream_overlaps():
    body = "Sentence one is here. " * 40
    spans = chunking.stream_spans(body, 100, 10)
    assert all(b[0] == a[1] - 10 for a, b in zip(spans, spans[1:]))
    assert spans[-1][1] == len(body)


def test_markdown_segments():
    body = "intro\n# A\nx\n## B\n```py\ncode\n```\ny\n### C\nz\n## D\n# E\nend"
    got = [(kind, path, title) for kind, _, title, _, path in chunking.markdown_segments(body)]
    assert got == [("text", "", "Introduction"), ("h1", "1", "A"), ("h2", "1.1", "B"), ("code", "1.1", "B"), ("h2", "1.1", "B"), ("h3", "1.1.1", "C"), ("h2", "1.2", "D"), ("h1", "1", "E")]
    assert chunking.markdown_segments("") == [("text", "", "Introduction", 0, "")]


def test_split_sections():
    long = "\n\n".join(["p" * 60] * 5)
    got = chunking.split_sections(f"pre\n# One\n{long}\n### Deep\nshort\n# Two\n", least=10, most=130)
    assert [(t, p) for t, _, p, _ in got] == [("One (Part 1)", "2.1"), ("One (Part 2)", "2.2"), ("One (Part 3)", "2.3"), ("Two", "3")]


def test_section_packs_equal_a_loop(spark):
    rows = [(1, k, f"{k // 10}.{k}", "x" * (7 * k % 40)) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "document_id long, id long, section_path string, content string")
    expected, chunk, held = {}, 1, 0
    for _, i, _, content in sorted(rows, key=lambda r: (r[2], r[1])):
        if held and held + len(content) > 60:
            chunk, held = chunk + 1, 0
        held += len(content)
        expected[i] = chunk
    assert {r["id"]: r["chunk_number"] for r in chunking.section_packs(df, 60).collect()} == expected


def test_references_and_resolution(spark):
    kinds = {(k, n) for k, n, _, _ in extract.references_in("call `run()` in [here](#top) and import os; class Foo")}
    assert {("function", "run"), ("link", "here"), ("module", "os"), ("class", "Foo")} <= kinds
    references = spark.createDataFrame([(1, 10, "function", "f"), (2, 20, "function", "f"), (2, 21, "link", "g"), (3, 30, "class", "f")], "document_id long, segment_id long, reference_type string, reference_text string")
    anchors = spark.createDataFrame([(1, 11, "function", "f"), (5, 50, "function", "f"), (5, 51, "class", "g")], "document_id long, segment_id long, anchor_type string, anchor_name string")
    got = {(r["segment_id"], r["target_segment_id"], r["target_document_id"]) for r in crossrefs.resolve(references, anchors).collect()}
    assert got == {(10, 11, 1), (20, 50, 5), (21, 51, 5)}


def test_anchor_signatures(spark):
    df = spark.createDataFrame([(1, 2, "def run(a, b)\nclass Foo(Bar)\n    def inner(self)")], "document_id long, segment_id long, content string")
    got = {(r["anchor_type"], r["anchor_name"], r["anchor_signature"]) for r in extract.anchors(df).collect()}
    assert got == {("function", "run", "run(a, b)"), ("function", "inner", "inner(self)"), ("class", "Foo", "class Foo(Bar)"), ("method", "inner", None)}


def test_page_description():
    page = """<html><head><title> A  page </title><meta name="generator" content="Sphinx 5"><link href="_static/pygments.css"><script>var a="<p>";</script></head>
    <body><nav><a href="/x">x</a></nav><main><h1>Top</h1><p>One <b>two</b> <a href="b.html">b</a></p><ul><li>i<li>j</ul><pre><code class="language-py">x = 1</code></pre>
    <table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><dl class="function"><dt>f(x)¶</dt></dl><div class="admonition warning">Hot</div></main>"""
    row = html.describe(1, "https://a.org/d/", page)
    found = dict(zip([c.split()[0] for c in html.PAGE_SCHEMA.replace("array<struct<level:int,text:string>>", "x").replace("array<struct<language:string,code:string>>", "x").replace("array<struct<kind:string,signature:string>>", "x").replace("array<struct<kind:string,text:string>>", "x").split(", ")], row))
    assert found["title"] == "A page" and found["kind"] == "sphinx" and found["confidence"] == 0.7
    assert found["links"] == ["https://a.org/x", "https://a.org/d/b.html"]
    assert found["codes"] == [("py", "x = 1")] and found["tables"] == 1
    assert found["elements"] == [("function", "f(x)")] and found["notes"] == [("warning", "Hot")]
    assert "# Top" in found["markdown"] and "```py\nx = 1\n```" in found["markdown"] and "- i\n- j" in found["markdown"]
    assert html.describe(2, None, "<p>cut <b")[2] is None


def test_page_tables(spark):
    df = spark.createDataFrame([(1, None, "<h1>T</h1>", 5), (2, "u", None, 5)], "page_id long, url string, html string, title int")
    assert [(r["page_id"], r["title"]) for r in html.pages(df).collect()] == [(1, "T")]


def test_api_description():
    assert html.spec_markdown('{"openapi": "3.0", "info": {"title": "T", "version": "1"}, "paths": {"/a": {"get": {"summary": "S"}}}}') == "# T (v1)\n\n## GET /a\n\nS"
    assert html.spec_markdown("no json") is None and html.spec_markdown("[1]") is None


def test_dependencies(spark):
    assert list(dependencies.from_requirements("# c\n-r x\na==1.0\nb[x]>=2 # note\nc\n")) == [("a", "1.0"), ("b", ">=2"), ("c", "")]
    assert dependencies.parse("d/package.json", '{"dependencies": {"x": "^1", "y": "git+ssh://z"}, "devDependencies": {"z": "1.0 beta"}}') == [("x", "^1"), ("y", ""), ("z", "1.0")]
    toml = '[project]\ndependencies = ["a>=1"]\n[tool.poetry.dependencies]\npython = "^3"\nb = {version = "2"}\n'
    assert dependencies.parse("pyproject.toml", toml) == [("a", ">=1"), ("b", "2")]
    assert dependencies.parse("go.mod", "x") == [] and dependencies.parse("package.json", "{") == []
    files = spark.createDataFrame([("a/requirements.txt", "X\ny==1"), ("b/requirements.txt", "x==2\n")], "source_file string, content string")
    got = {(r["name"], r["version"]) for r in dependencies.merged(dependencies.dependencies(files)).collect()}
    assert got == {("X", "2"), ("y", "1")}


def test_llms_files(spark):
    body = "# T\n> one\n> two\n\nintro\n## Docs\n- [A](a.md): about\n- [B](https://b)\n## Optional\n* [C](c)\n"
    files = spark.createDataFrame([(1, "https://h/llms.txt", body), (2, None, None)], "document_id long, url string, text string")
    meta = llms.metadata(files).collect()
    assert [(m["title"], m["summary"], m["introduction"], m["sections"], m["errors"]) for m in meta] == [("T", "one two", "intro", ["Docs", "Optional"], [])]
    got = [(r["section"], r["title"], r["url"], r["description"], r["is_optional"]) for r in llms.entries(files).collect()]
    assert got == [("Docs", "A", "https://h/a.md", "about", False), ("Docs", "B", "https://b", None, False), ("Optional", "C", "https://h/c", None, True)]
    assert llms.problems(llms.parse("")) == ["no title", "nothing but a title"]


def test_store(spark, tmp_path):
    documents = spark.createDataFrame([(1, "T<", "body", "u", "1")], "doc_id long, title string, text string, url string, version string")
    forms = {f: store.export_rows(documents, f).first()["body"] for f in ("markdown", "html", "json", "xml", "llms")}
    assert forms["markdown"] == "# T<\n\nbody" and "T&lt;" in forms["xml"] and '"content":"body"' in forms["json"] and forms["llms"] == "- [T<](u)"
    store.backup({"documents": documents}, str(tmp_path / "b"))
    assert store.restore(spark, str(tmp_path / "b"), ["documents"])["documents"].count() == 1
    store.export(documents, "markdown", str(tmp_path / "e"))
    for bad in ("../x", "/x", "a/../b", ""):
        with pytest.raises(ValueError):
            store.safe_member(bad)
    assert store.id_ranges("1-3,7,2") == [1, 2, 3, 7] and store.id_ranges("3-1", strict=False) == [1, 2, 3]
    with pytest.raises(ValueError):
        store.id_ranges("3-1")


def test_suggestions(spark):
    assert suggest.language_of("parse json") == "javascript" and suggest.language_of("plain") is None
    assert suggest.task_categories("read a file") == ["file_operations"]
    segments = spark.createDataFrame([(1, 1, "use load(x) then save(y) and save(z)"), (1, 2, "other()")], "document_id long, segment_id long, content string")
    got = {r["identifier"]: round(r["score"], 2) for r in suggest.co_occurring(segments, "load").collect()}
    assert got == {"save": 0.7}
    names = spark.createDataFrame([("getUser",), ("openFile",), ("x",)], "n string")
    assert [r[0] for r in names.select(suggest.paired_name(F.col("n"))).collect()] == ["setuser", "closefile", None]
    scored = spark.createDataFrame([("pip install", 0.5), ("cargo build", 0.5), ("plain", 0.5)], "text string, score double")
    assert [round(r["score"], 1) for r in suggest.by_language(scored, "python").collect()] == [0.7, 0.2, 0.5]


def test_summary():
    body = "# T\n\nFirst line.\nSecond.\n\n```python\ndef run(a):\n    return a\n```\n\nWarning: never do this at all, please.\n\nSee also: alpha tool, beta tool\n\nclass Foo\n"
    got = summarise.summary(body)
    assert got["overview"].startswith("First line. Second.")
    assert [f["name"] for f in got["functions"]] == ["run"] and [c["name"] for c in got["classes"]] == ["Foo"]
    assert got["examples"][0]["is_complete"] and got["pitfalls"][0]["severity"] == "critical"
    assert got["related"] == ["alpha tool", "beta tool"]
    assert summarise.snippets("alpha " * 3 + "x " * 200 + "beta end", ["beta"], around=5) == ["...x x x **beta** end"]


def test_version_differences(spark):
    assert versions.compare("a\nb", "a\nb") == (1.0, 1.0, 0, 0, 0, 0, "no significant changes")
    ratio, similarity, added, removed, more, less, words = versions.compare("a\ndef f():\n", "a\nb\nc\n")
    assert (added, removed, more, less, words) == (2, 1, 0, 1, "added 2 lines; removed 1 lines; removed 1 functions") and 0 < similarity < 1
    df = spark.createDataFrame([(1, "1.2"), (2, "v3"), (3, "latest"), (4, None)], "doc_id long, version string")
    got = {(r["doc_id"], r["candidate"]) for r in versions.next_versions(df).collect()}
    assert got == {(1, "1.2.1"), (1, "1.3.0"), (1, "2.0.0"), (2, "3.0.1"), (2, "3.1.0"), (2, "4.0.0")}


def test_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(tuple(r) for r in mutations.upsert(table, rows, ["id"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    members = spark.createDataFrame([("x", 1, 0), ("x", 2, 1)], "collection string, document_id long, position int")
    added = spark.createDataFrame([("x", 1), ("x", 9), ("x", 8), ("y", 5)], "collection string, document_id long")
    got = {(r["collection"], r["document_id"], r["position"]) for r in mutations.append_members(members, added).collect()}
    assert got == {("x", 1, 0), ("x", 2, 1), ("x", 8, 2), ("x", 9, 3), ("y", 5, 0)}
    moved = mutations.reorder(members, spark.createDataFrame([("x", 2, 0), ("x", 1, 1)], "collection string, document_id long, new_position int"))
    assert {(r["document_id"], r["position"]) for r in moved.collect()} == {(2, 0), (1, 1)}
