import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge import queries as core
from folioforge.functions import checks, labels
from folioforge.operators import chunking, crawl, lookups, sections, vector


def one(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_input_checks():
    assert checks.query(" <b>words</b> ") == "words"
    assert checks.tag("a.b-c") == "a.b-c" and checks.version("1.2.3-rc1") == "1.2.3-rc1" and checks.document_id("7") == 7
    for call, bad in ((checks.query, ""), (checks.query, "a;b"), (checks.query, "x" * 1001), (checks.name, "a b"), (checks.version, "1"), (checks.document_id, 0)):
        with pytest.raises(ValueError):
            call(bad)


def test_urls_that_are_not_fetched(spark):
    good = ["https://a.org/x", "http://sub.a.org:8080/"]
    bad = ["ftp://a.org", "http://localhost/", "http://10.0.0.1/", "http://169.254.169.254/", "http://a.org:22/", "http://b.blocked.org/", "x", "https://" + "a" * 3000, None]
    assert [checks.url(u, blocked=["blocked.org"]) for u in good] == good
    for u in filter(None, bad):
        with pytest.raises(ValueError):
            checks.url(u, blocked=["blocked.org"])
    assert one(spark, [(u,) for u in good + bad], "u string", checks.fetchable(F.col("u"), ["blocked.org"])) == [True] * 2 + [False] * len(bad)
    assert checks.url("https://docs.a.org", allowed=["a.org"])


def test_escapes(spark):
    assert one(spark, [("\x1b[31mred\x1b[0m\x07 ok\n",)], "t string", checks.without_escapes(F.col("t"))) == ["red ok\n"]


def test_labels(spark):
    df = spark.createDataFrame([("API guide", "how to install"), (None, "nothing")], "title string, content string")
    rows = df.select(labels.content_kinds(F.col("title"), F.col("content")), labels.section_type(F.col("title")), labels.document_kind(F.col("title"), F.col("content"))).collect()
    assert [tuple(r) for r in rows] == [(["API Reference", "Tutorial/Guide", "Setup/Config"], "api", "api"), ([], None, "general")]
    assert one(spark, [(0.9,), (0.7,), (0.1,)], "s double", labels.relevance_band(F.col("s"))) == ["high", "medium", "basic"]
    assert one(spark, [("PIP",), ("x",)], "n string", labels.package_manager(F.col("n"))) == ["pypi", None]
    assert [tuple(r) for r in one(spark, [("a@1",), ("b",)], "n string", labels.library_spec(F.col("n")))] == [("a", "1"), ("b", "latest")]
    assert one(spark, [("https://x/{version}/", "latest"), ("https://x/{major}.{minor}/", "1.2.3")], "p string, v string", labels.filled_url(F.col("p"), F.col("v"))) == ["https://x/stable/", "https://x/1.2/"]
    packages = [({"Docs": "d", "Documentation": "e"}, "h", "p"), ({}, "https://p.github.io", "p"), ({}, "https://shop.com", "p")]
    assert one(spark, packages, "l map<string,string>, h string, p string", labels.documentation_url(F.col("l"), F.col("h"), F.col("p"))) == ["e", "https://p.github.io", "https://p.readthedocs.io/"]


def test_crawl_policy(spark):
    page = "<pre>x</pre><code>y</code> def run returns parameter example usage syntax"
    scores = one(spark, [(page,), ("",)], "p string", crawl.content_scores(F.col("p")))
    assert scores[1] is None and scores[0]["code_density"] == 1.0 and scores[0]["api_indicators"] == 1.0 and scores[0]["navigation_ratio"] == 1.0
    assert one(spark, [(0.9,), (0.5,), (0.3,), (0.1,)], "s double", crawl.depth_after(F.col("s"), 2)) == [3, 2, 1, 0]
    links = spark.createDataFrame([("https://a.org/docs/", 0, "https://a.org/docs/x/"), ("https://a.org/docs/", 1, "https://a.org/docs/api/reference/y"), ("https://a.org/docs/", 2, "https://b.org/"), ("https://a.org/docs/", 3, "https://a.org/docs/seen/")], "page string, position int, link string")
    seen = spark.createDataFrame([("https://a.org/docs/seen/",)], "url string")
    got = [(r["link"], r["rank"]) for r in crawl.next_links(links, seen, 2).orderBy("rank").collect()]
    assert got == [("https://a.org/docs/api/reference/y", 1), ("https://a.org/docs/x/", 2)]
    assert one(spark, [('<a href="https://a.org/x"><link href="https://a.org/s.css"><a href="https://a.org/x">',)], "p string", crawl.plain_links(F.col("p"))) == [["https://a.org/x"]]


def test_lookups(spark):
    documents = spark.createDataFrame([(1, "u", 5), (2, "u", None)], "doc_id long, url string, library_id long")
    libraries = spark.createDataFrame([(5, "lib", "1.0")], "id long, name string, version string")
    assert lookups.document_by_url(documents, "u").first()["doc_id"] == 1
    assert lookups.document_exists(documents, libraries, "lib:1.0") and lookups.document_exists(documents, libraries, "2")
    assert not lookups.document_exists(documents, libraries, "lib:2") and not lookups.document_exists(documents, libraries, "x")
    segments = spark.createDataFrame([(1, 1, 0, "a", "1.10"), (1, 1, 0, "a", "1.10"), (2, 1, 1, "b", "1.2")], "id long, document_id long, position int, section_title string, section_path string")
    assert [r["id"] for r in lookups.segments_of(segments, 1).collect()] == [1, 2]
    assert [r["id"] for r in lookups.sections_of(segments, 1).collect()] == [1, 2]
    assert [r["id"] for r in lookups.sections_of(segments, 1, "numeric").collect()] == [2, 1]


def test_index_and_sized_spans():
    body = "\n".join(["five words in this line"] * 60)
    spans = chunking.index_spans(body, 100, 20)
    assert spans[0][0] == 0 and spans[-1][1] == len(body) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert chunking.index_spans("  \n ") == []
    text = "First one. Second one. Third one here.\n\nshort"
    assert [text[a:b] for a, b in chunking.sized_spans(text, 24)] == ["First one. Second one. ", "Third one here.", "short"]


def test_batch_search_equals_single_searches(spark):
    rows = [(k, [float(k % 5), float(k % 3), 1.0]) for k in range(30)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(7)] + [(50, None), (51, [0.0, 0.0, 0.0])], "query_id long, query array<float>")
    got = {}
    for r in vector.knn_batch(df, queries, 4, max_queries=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for k in range(7):
        single = [r["id"] for r in vector.knn(df, [float(k), 1.0, 2.0], 4).collect()]
        assert [got[k][n] for n in (1, 2, 3, 4)] == single
    assert set(got) == set(range(7))


def test_batch_search_of_the_whole_query_set_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    base, asked = rng.normal(size=(40, 64)).astype("float32"), rng.normal(size=(2_050, 64)).astype("float32")
    # more than one block of 2,000 queries, and ids that aren't asked for
    numbers = [50 * k for k in range(2_050)]
    rows = [(n, v.tolist()) for n, v in zip(numbers, asked)] + [(n + 1, asked[0].tolist()) for n in numbers[:20]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(base)], "id long, document_id long, embedding array<float>").write.parquet(f"{tmp_path}/document_segments.parquet")
    got = {(r["query_id"], r["rank"]): r["id"] for r in core.queries()["vector_knn_batch_all"](spark, str(tmp_path)).collect()}
    unit = lambda m: m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    best = np.argsort(-(unit(asked) @ unit(base).T), axis=1, kind="stable")[:, :5]
    assert got == {(numbers[q], r + 1): int(best[q, r]) for q in range(len(numbers)) for r in range(5)}


def test_siblings_and_contents(spark):
    df = spark.createDataFrame([(1, 1, "1"), (2, 1, "2"), (3, 1, "1.1"), (4, 1, "1.2"), (5, 2, "1")], "id long, document_id long, section_path string").withColumn("section_title", F.lit("t"))
    assert {(r["id"], r["sibling_id"]) for r in sections.siblings(df, df).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    got = {r["id"]: (r["parent_id"], r["children"]) for r in sections.toc(df).collect()}
    assert got == {1: (None, 2), 2: (None, 0), 3: (1, 0), 4: (1, 0), 5: (None, 0)}


def test_neighbours_of_a_hot_group(spark):
    """A group with most of the rows is spread over partitions, and its neighbours are right across their borders."""
    from folioforge.operators import adjacent

    rows = [(1, k) for k in range(3_000)] + [(g, k) for g in range(2, 30) for k in range(g % 3)]
    df = spark.createDataFrame(rows, "g long, k long")
    got = {(r["group"], r["value"]): (r["prev"], r["next"]) for r in adjacent.neighbours(df, F.col("g"), [F.col("k")], F.col("k")).collect()}
    groups = {}
    for g, k in rows:
        groups.setdefault(g, []).append(k)
    assert got == {(g, k): (k - 1 if k else None, k + 1 if k + 1 < len(ks) else None) for g, ks in groups.items() for k in ks}
    ranged = df.repartitionByRange(8, "g", "k").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 4 * sorted(r["count"] for r in ranged)[len(ranged) // 2]
    assert adjacent.neighbours(df.limit(0), F.col("g"), [F.col("k")], F.col("k")).count() == 0


def test_sibling_groups(spark):
    df = spark.createDataFrame([(1, 1, "1.1"), (2, 1, "1.2"), (3, 1, "2"), (4, 2, "1.1")], "id long, document_id long, section_path string")
    assert {(r["id"], r["parent_path"], r["siblings"]) for r in sections.sibling_groups(df).collect()} == {(1, "1", 1), (2, "1", 1), (3, "", 0), (4, "1", 0)}
