import difflib
import re
from collections import Counter
from html import unescape

import pytest
from oracle import spark_rows, sql_rows, views

from folioforge import queries as core

SQL = core.oracle_sql()
#: Compared with brute force in test_hierarchy.
SLOW = {"p6_paths", "p6_descendants"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    if name in SLOW:
        pytest.skip("covered elsewhere")
    assert spark_rows(core.queries()[name](spark, sf_dir)) == sql_rows(con, SQL[name])


# ---- queries that SQL can't say, restated


def texts_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r["text"]}


def chunks_of_texts(size, covers, strip=False):
    """Chunks are the stated ranges of their texts, numbered in order, and (but for what separates them) cover them."""

    def check(spark, sf_dir, rows):
        texts = texts_of(spark, sf_dir)
        found = {}
        for r in rows:
            found.setdefault(r["document_id"], []).append(r)
        assert set(found) <= set(texts) and (not covers or set(found) == set(texts))
        for document, parts in found.items():
            text = texts[document]
            parts.sort(key=lambda r: r["chunk_number"])
            assert [p["chunk_number"] for p in parts] == list(range(1, len(parts) + 1)) and {p["total_chunks"] for p in parts} == {len(parts)}
            for p in parts:
                whole = text[p["start_position"] : p["end_position"]]
                assert p["content"] == (whole.strip() if strip else whole)
                # a separator counts only before a further paragraph
                assert len(p["content"]) <= size + 2 or "\n\n" not in p["content"].strip() or strip
            at = 0
            for p in parts:
                assert p["start_position"] <= at or not text[at : p["start_position"]].strip()
                at = max(at, p["end_position"])
            assert not covers or not text[at:].strip()

    return check


def check_segments(spark, sf_dir, rows):
    texts = texts_of(spark, sf_dir)
    for r in rows:
        body = " ".join(r["content"].split())
        assert not body or all(word in texts[r["document_id"]] for word in body.split()[:20])


def check_sections(spark, sf_dir, rows):
    texts = texts_of(spark, sf_dir)
    for r in rows:
        words = [w for w in re.findall(r"\w+", r["section_title"] or "") if len(w) > 3]
        assert r["section_title"] in ("Introduction", None) or all(w in texts[r["document_id"]] for w in words)
        assert r["section_level"] == len(r["section_path"].split(".")) or r["section_level"] >= 1


def check_section_chunks(spark, sf_dir, rows):
    packs = {}
    for r in core.queries()["section_chunk_index"](spark, sf_dir).collect():
        packs.setdefault((r["document_id"], r["chunk_number"]), set()).add(r["section_path"] or "")
    assert {(r["document_id"], r["chunk_number"]) for r in rows} == set(packs)
    for r in rows:
        paths = packs[r["document_id"], r["chunk_number"]]
        assert r["section_path"] == f"{min(paths)}-{max(paths)}" and r["end_position"] == len(r["content"])


def check_links(spark, sf_dir, rows):
    seen = {r["url"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("url").collect()}
    ranks = {}
    for r in rows:
        assert r["link"] not in seen and r["link"].split("/")[2] == r["page"].split("/")[2]
        ranks.setdefault(r["page"], []).append((r["rank"], -r["priority"]))
    for found in ranks.values():
        found.sort()
        assert [k for k, _ in found] == list(range(1, len(found) + 1)) and len(found) <= 20 and [p for _, p in found] == sorted(p for _, p in found)


def check_decisions(spark, sf_dir, rows):
    """Scores of the paths by the stated patterns, and what follows from them for a crawl of the host's documents."""
    good = ["/docs?/", "/api/", "/reference/", "/guide/", "/manual/", "/tutorial/", "/documentation/", "/resources/docs/", "/developer/", "/dev-?guide/", "/learn/", "/getting-?started/"]
    url = {r["doc_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "url").collect()}
    for r in rows:
        path = "/" + re.sub(r"[?#].*", "", url[r["doc_id"]]).split("/", 3)[-1].lower()
        tenths = 3 * sum(bool(re.search(p, path)) for p in good) + (3 if "/api/" in path and re.search("reference|docs|v1|v2", path) else 0)
        if tenths > 5:
            assert r["follow"] and r["priority"] >= tenths / 10 - 1e-9 or r["priority"] == 1.0
        assert 0 <= r["priority"] <= 1 and (r["suggested_depth"] is None or r["follow"])


def check_pages(spark, sf_dir, rows):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/raw_pages.parquet").select("page_id", "html").collect() if r["html"]}
    assert {r["page_id"] for r in rows} == set(source)
    for r in rows:
        html = source[r["page_id"]]
        assert len(r["headings"]) == len(re.findall(r"<h[1-6][\s>]", html))
        title = re.search(r"(?s)<title>(.*?)</title>", html)
        assert not title or r["title"] == " ".join(unescape(title.group(1)).split())


def check_codes(spark, sf_dir, rows):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/raw_pages.parquet").select("page_id", "html").collect() if r["html"]}
    for r in rows:
        plain = " ".join(unescape(re.sub("<[^>]*>", " ", source[r["page_id"]])).split())
        assert "<pre" in source[r["page_id"]] and r["code"].split()[0] in plain


def check_page_scores(spark, sf_dir, rows):
    for r in rows:
        assert all(0 <= r[c] <= 1 for c in ("code_density", "api_indicators", "navigation_ratio", "overall")) and r["depth"] in (0, 1, 2, 3)
        assert r["depth"] == (3 if r["overall"] > 0.7 else 2 if r["overall"] > 0.4 else 1 if r["overall"] > 0.2 else 0) or r["overall"] in (0.7, 0.4, 0.2)


def check_summaries(spark, sf_dir, rows):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    assert len(rows) == documents.count()
    texts = texts_of(spark, sf_dir)
    for r in rows:
        text = texts.get(r["document_id"], "")
        assert all(e["code"] in text for e in r["examples"]) and all(f["signature"] in text for f in r["functions"])
        assert len(re.findall(r"(?s)```\w*[^\n]*\n(.*?)\n?```", text)) >= sum(e["language"] not in ("html", "session", "usage") for e in r["examples"])
        assert all(p["importance"] in ("critical", "high", "medium", "low") for p in r["practices"])


def check_patterns(spark, sf_dir, rows):
    found = core.queries()["document_summaries"](spark, sf_dir).collect()
    expected = Counter()
    for r in found:
        expected.update((r["document_id"], "usage_example", e["code"]) for e in r["examples"] if e["is_complete"] and e["complexity"] in ("basic", "intermediate"))
        expected.update((r["document_id"], "best_practice", p["text"]) for p in r["practices"] if p["importance"] in ("high", "critical"))
        expected.update((r["document_id"], "common_pitfall", p["text"]) for p in r["pitfalls"])
    assert Counter((r["document_id"], r["category"], r["text"]) for r in rows) == expected


def check_snippets(spark, sf_dir, rows):
    contents = {}
    for r in spark.read.parquet(f"{sf_dir}/document_segments.parquet").select("id", "content").collect():
        contents.setdefault(r["id"], r["content"])
    wanted = {i for i, c in contents.items() if "collector" in c.lower() or "nightly" in c.lower()}
    assert {r["id"] for r in rows} == wanted
    for r in rows:
        assert 1 <= len(r["snippets"]) <= 3
        for piece in r["snippets"]:
            assert piece.removeprefix("...").removesuffix("...").replace("**", "") in contents[r["id"]].replace("**", "")


def check_differences(spark, sf_dir, rows):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    history = {}
    for r in core.queries()["version_history"](spark, sf_dir).collect():
        history.setdefault(r["page"], []).append(r)
    pairs = 0
    for found in history.values():
        pairs += len(found) - 1
    assert len(rows) <= pairs
    for r in rows:
        old, new = texts[r["old_id"]] or "", texts[r["new_id"]] or ""
        assert (r["similarity"] == 1.0) == (old == new) or len(old) > 200
        assert r["similarity"] == pytest.approx(difflib.SequenceMatcher(None, old, new).ratio())


def check_llms(spark, sf_dir, rows):
    named = {}
    libraries = {r["id"]: r["name"] for r in spark.read.parquet(f"{sf_dir}/libraries.parquet").select("id", "name").collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "title", "url", "library_id").collect():
        if r["library_id"] in libraries and r["url"] is not None:
            named.setdefault(libraries[r["library_id"]], []).append((r["doc_id"], f"- [{r['title'] or r['url']}]({r['url']})"))
    expected = {n: f"# {n}\n\nThis is the documentation collection for {n}.\n\n## Docs\n\n" + "\n".join(line for _, line in sorted(lines)) + "\n" for n, lines in named.items()}
    assert {r["name"]: r["text"] for r in rows} == expected


def check_suggestions(spark, sf_dir, rows):
    scores = [r["score"] for r in rows]
    assert len(rows) == 25 and scores == sorted(scores, reverse=True) and all(0 < x <= 1 for x in scores)
    keys = [(r["identifier"], r["kind"], r["document_id"]) for r in rows]
    assert len(set(keys)) == len(keys)


def check_references(spark, sf_dir, rows):
    contents = {r["segment_id"]: r["content"] for r in core._contents(spark, sf_dir).collect()}
    for r in rows:
        assert r["reference_type"] == "link" or r["reference_context"] in contents[r["segment_id"]]


RESTATED = {
    "paragraph_chunks": chunks_of_texts(1_000, True), "stream_chunks": chunks_of_texts(1_000, True), "semantic_chunks": chunks_of_texts(1_000, False, strip=True), "index_segments": chunks_of_texts(10**9, False), "sized_segments": chunks_of_texts(10**9, True),
    "markdown_segments": check_segments, "markdown_sections": check_sections, "section_chunks": check_section_chunks, "links_to_follow": check_links, "link_decisions": check_decisions, "page_descriptions": check_pages,
    "page_codes": check_codes, "page_scores": check_page_scores, "document_summaries": check_summaries, "usage_patterns": check_patterns, "relevant_snippets": check_snippets, "version_differences": check_differences,
    "export_llms": check_llms, "get_suggestions": check_suggestions, "references_in_context": check_references,
}
#: Restated in test_compose.
ELSEWHERE = {"chunk_navigation"}


def test_every_query_has_a_twin():
    assert set(core.queries()) - set(SQL) == set(RESTATED) | ELSEWHERE


@pytest.mark.parametrize("name", sorted(RESTATED))
def test_query_without_sql_equals_its_restatement(spark, sf_dir, name):
    df = core.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    rows = df.collect()
    assert rows
    RESTATED[name](spark, sf_dir, rows)


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    names = ["text_search", "section_toc", "section_chunk_index", "vector_knn_batch", "version_history"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({k: spark_rows(core.queries()[k](spark, sf_dir)) for k in names})
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filters_reach_the_scan(spark, sf_dir):
    plan = core.queries()["documents_filtered"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(version,latest)" in plan
    assert "text:string" not in plan


def test_unused_contents_are_not_read(spark, sf_dir):
    for name in ("section_toc", "section_ancestors", "section_prev_next"):
        plan = core.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "content:string" not in plan and "embedding" not in plan, name


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.queries()) <= set(entry.queries())
