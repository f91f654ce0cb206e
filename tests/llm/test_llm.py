"""Each operator against a plain restatement, and on nulls, empty and long texts, ties, copies, empty tables and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import spark_rows, sql_rows, views
from pyspark.sql import functions as F

from folioforge.llm import boilerplate, hashknn, leakage, mojibake, neardup, residue, residue_seeds, sitelines, splitting, textkernel, tokenise
from folioforge.llm import queries as llm

SQL = llm.oracle_sql()
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(llm.queries()[name](spark, sf_dir)) == sql_rows(views(sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


# ---- words


def test_words_and_runs_equal_regular_expressions():
    texts = ["Ab_c d-e'f  Ünï 12x", "", "日本語 テスト a", "x\x00y", "one", "É́a İb", "a b c d"]
    hashes, owner = textkernel.words(texts)
    expected = [w for t in texts for w in words_of(t)]
    assert len(hashes) == len(expected)
    assert Counter(owner.tolist()) == Counter(i for i, t in enumerate(texts) for _ in words_of(t))
    named = defaultdict(set)
    for h, w in zip(hashes.tolist(), expected):
        named[h].add(w)
    assert all(len(v) == 1 for v in named.values()) and len(named) == len(set(expected))
    keys, at = textkernel.runs(hashes, owner, 3)
    assert len(keys) == sum(max(0, len(words_of(t)) - 2) for t in texts)
    assert list(textkernel.slices(["a" * 5, "b" * 5, "c" * 50, ""], 12)) == [(0, 2), (2, 3), (3, 4)]


# ---- 1 near-duplicates


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def similar(rows, size, threshold, least):
    sets = {i: shingles(t, size) for i, t in rows if i is not None and t and len(words_of(t)) >= least and len(words_of(t)) >= size}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = rng.choices(WORDS, k=rng.randrange(3))
    return " ".join(w)


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        text = " ".join(rng.choices(WORDS, k=rng.randrange(42, 90)))
        rows += [(len(rows) + k, edited(rng, text, rng.randrange(9))) for k in range(4)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, "too short"), (None, rows[0][1]), (905, " ".join(rng.choices(WORDS, k=4000)))]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, content string, doc int, text string")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows, 3, 0.6, 40)


def test_hot_shingles_are_split(spark, monkeypatch):
    rows = near_rows(5)
    whole = similar(rows, 3, 0.6, 40)
    monkeypatch.setattr(neardup, "BLOCK_POSTINGS", 2)
    df = spark.createDataFrame(rows, "id long, content string")
    assert {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()} == whole


def test_no_key_holds_more_than_a_block():
    """A shingle in a third of all postings: its blocks are even, and every pair of its postings meets once."""
    rng = np.random.default_rng(3)
    n, hot = 3_000, 1_000
    token = np.concatenate((np.full(hot, 77), rng.integers(1_000, 1 << 40, n - hot)))
    doc = rng.integers(0, 1 << 60, n)
    log = np.where(token == 77, np.uint8(np.ceil(neardup.LOG_STEP * np.log2(1 + hot))), np.uint8(neardup.LOG_STEP))
    neardup_block, neardup.BLOCK_POSTINGS = neardup.BLOCK_POSTINGS, 50
    try:
        at, key, role = neardup._blocked(token, doc, log)
    finally:
        neardup.BLOCK_POSTINGS = neardup_block
    longer = Counter(key[role & 2 > 0].tolist())
    assert max(longer.values()) <= 2 * 50
    meets = Counter()
    by_key = defaultdict(lambda: ([], []))
    for a, k, r in zip(at.tolist(), key.tolist(), role.tolist()):
        if token[a] == 77:
            if r & 1:
                by_key[k][0].append(a)
            if r & 2:
                by_key[k][1].append(a)
    for left, right in by_key.values():
        meets.update((a, b) for a in left for b in right)
    assert len(meets) == hot * hot and set(meets.values()) == {1}


def test_links_and_members_are_the_whole(spark):
    rows = near_rows(6)
    df = spark.createDataFrame(rows, "id long, content string")
    members = {r["segment_id"]: (r["class_id"], r["copies"], r["expanded"]) for r in neardup.near_duplicate_members(df).collect()}
    links = {(r["class_a"], r["class_b"]) for r in neardup.near_duplicate_links(df).collect()}
    copies = defaultdict(set)
    for i, (c, _, _) in members.items():
        copies[c].add(i)
    expanded = {(min(x, y), max(x, y)) for a, b in links for x in copies[a] for y in copies[b]} | {(x, y) for c in copies.values() for x in c for y in c if x < y}
    assert expanded == similar(rows, 3, 0.6, 40)
    assert all(n == len(copies[c]) and whole for c, n, whole in members.values())


def test_large_classes_become_stars(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND_CLASS", 3)
    text = " ".join(WORDS * 3)
    other = " ".join(WORDS * 3 + ["more"])
    df = spark.createDataFrame([(k, text) for k in range(6)] + [(10, other)], "id long, content string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    assert got == {(0, k) for k in range(1, 6)} | {(0, 10)}


def test_classes_name_every_text(spark):
    rows = near_rows(4)
    df = spark.createDataFrame(rows, "id long, content string")
    pairs = similar(rows, 5, 0.8, 5)
    parent = {i: i for i, t in rows if i is not None and t}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["segment_id"]: r["class_id"] for r in neardup.near_duplicate_classes(df).collect()}
    assert got == {i: find(i) for i in parent}


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, content string")
    assert neardup.near_duplicate_pairs(empty).count() == 0
    assert neardup.near_duplicate_classes(empty).count() == 0


# ---- 2 page furniture


def furniture_tables(spark, extra=()):
    rng = random.Random(5)
    segments, documents, expected = [], [], set()
    for d in range(30):
        documents.append((d, f"https://www.Acme.example:80/docs/{d}", f"/h/{d}" if d != 29 else None, "host"))
        body = " ".join(rng.sample([f"Set the {rng.choice(WORDS)} of {rng.choice(WORDS)} with care.", f"It then keeps {rng.choice(WORDS)} {d} times.", f"No {rng.choice(WORDS)} waits for the {rng.choice(WORDS)}."], 3))
        lines = ["Menu", "Search", "", body, "", "```", "Menu", "© 2020 x", "```", "", f"Cookies help us keep the {rng.choice(WORDS)} of {rng.choice(WORDS)} working; choose agree or settings [{d}].", "", "| Menu | x |", "Share this page with your hybrid team on the Acme board"]
        segments.append((d, d, "\r\n".join(lines) if d == 3 else "\n".join(lines), 7))
        if d != 29:
            expected |= {(d, 0), (d, 1), (d, 10), (d, 13)}
    segments += [(100, 0, None, 7), (101, 1, "", 7), (102, 2, "x" * 50_000, 7), (0, 0, segments[0][2], 7), *extra]
    return (
        spark.createDataFrame(segments, "id long, document_id long, content string, host int"),
        spark.createDataFrame(documents, "doc_id long, url string, html_path string, host string"),
        expected,
    )


def test_furniture(spark):
    segments, documents, expected = furniture_tables(spark)
    got = [tuple(r) for r in boilerplate.furniture_lines(segments, documents).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    bodies = {r["segment_id"]: r for r in boilerplate.main_bodies(segments, documents).collect()}
    assert bodies[4]["removed"] == 4 and "Cookies" not in bodies[4]["body"] and "with care" in bodies[4]["body"]


def test_block_goes_with_its_template(spark):
    block = "See also\n- the first entry\n- another entry"
    segments, documents, expected = furniture_tables(spark, [(200 + k, k, f"{WORDS[k]} is here. And more of it.\n\n{block}\n\n{WORDS[-k]} ends all {WORDS[k]}.", 7) for k in range(12)])
    got = {tuple(r) for r in boilerplate.furniture_lines(segments, documents).collect()}
    assert got - expected == {(200 + k, n) for k in range(12) for n in (2, 3, 4)}


def test_furniture_of_nothing(spark):
    segments = spark.createDataFrame([], "id long, document_id long, content string")
    documents = spark.createDataFrame([], "doc_id long, url string, html_path string")
    assert boilerplate.furniture_lines(segments, documents).count() == 0


def unlisted_tables(spark):
    """A host of 300 pages with furniture of no known kind on 20 of them, and prose, headings and lists that recur."""
    rng = random.Random(9)
    pick = lambda: rng.choice(WORDS)
    segments, documents, expected = [], [], set()
    long = f"Everything on these pages is given as it stands and without any promise of use. Whoever relies on it does so alone. {' '.join(WORDS)} end of statement."
    for d in range(300):
        documents.append((d, f"https://big.example/p/{d}", f"/h/{d}"))
        prose = [f"Compare the {pick()} with the {pick()} first.", f"Each {pick()} of page {d} holds the {pick()}.", f"Then the {pick()} starts {d} times, as a {pick()} does."]
        lead, middle, last = " ".join(rng.sample(prose, 3)), rng.choice(prose), " ".join(rng.sample(prose, 3))
        lines = [lead, "", middle, "", last]
        if d % 20 == 19:
            lines = ["## Common options", "", *lines, "", "- keep the list entry"]
        if d < 20:
            lines = [f"Maintained by {pick()} since {2000 + d}", "", *lines]
            segments += [(1000 + d, d, f"{lead}\n\nPowered by Forge"), (2000 + d, d, f"{lead}\n\n{long}"), (3000 + d, d, f"{pick()} {d} keeps this mirror alive\n\n{lead}")]
            expected |= {(d, 0), (1000 + d, 2), (2000 + d, 2), (3000 + d, 0)}
        if 40 <= d < 70:
            lines = [middle, *lines[1:], "", middle]
        segments.append((d, d, "\n".join(lines)))
    return spark.createDataFrame(segments, "id long, document_id long, content string"), spark.createDataFrame(documents, "doc_id long, url string, html_path string"), expected


def test_furniture_of_no_known_kind(spark, monkeypatch):
    segments, documents, expected = unlisted_tables(spark)
    assert {tuple(r) for r in boilerplate.furniture_lines(segments, documents).collect()} == expected
    # the same where nothing is small enough to be broadcast
    for bound in ("BROADCAST_TEMPLATES", "BROADCAST_DOCUMENTS"):
        monkeypatch.setattr(boilerplate, bound, 0)
    assert {tuple(r) for r in boilerplate.furniture_lines(segments, documents).collect()} == expected


def test_furniture_is_judged_by_whole_lines(spark):
    """Long lines that are alike only at their ends are main body; those that are alike all through but near an end are not."""
    segments, documents, expected = unlisted_tables(spark)
    legal = " ".join(f"clause{a}{b}" for a in "abcdefg" for b in "uvwxyz")
    series = "This belongs to the long series on tables, filled and read by many hands. Its plan stands beside the first of them all."
    more = []
    for d in range(20):
        own = [f"{w}{chr(97 + d)}" for w in WORDS]
        lead = " ".join(own[k] + " moves" for k in range(0, 24, 3))
        more += [
            (4000 + d, d, f"{lead}\n\nPlease note these twelve things about our site as they stand today, namely {' '.join(own)}. And {' '.join(reversed(own))}. That is all we hold."),
            (5000 + d, d, f"{lead}\n\nLegal matters {' '.join(own[:12])}. Whoever reads on accepts {legal} for good and all, {' '.join(own[12:20])}."),
            (6000 + d, d, f"{lead}\n\n{' '.join(own[4:10])}. {series}"),
            (7000 + d, d, f"{lead}\n\nOur {'own ' * (d == 3)}terms of use bind {legal} as ever. They hold for all who come by."),
        ]
        expected |= {(5000 + d, 2), (6000 + d, 2), (7000 + d, 2)}
    more = spark.createDataFrame(more, "id long, document_id long, content string")
    got = {tuple(r) for r in boilerplate.furniture_lines(segments.unionByName(more), documents).collect()}
    assert got == expected


# ---- 3 residue


def residue_prose():
    return [f"The {a} {b} reads the {c} before the {a} {c} writes it. Compared with a {b}, the {c} needs fewer {a} rows. By default, every {b} keeps its {c}." for a in WORDS[:12] for b in WORDS[12:18] for c in WORDS[18:]]


def test_residue_on_held_out_texts(spark):
    prose = residue_prose()
    bad = {
        "placeholder": ["Dear {{ buyer.name }}, the order of {{ shop.title }} is ready. The alpha beta reads the gamma before the delta writes it.", "<%= page.title %> - Alpha | <%= site.name %>\nThe alpha beta reads the gamma.", "Price: ${item.price}"],
        "filler": ["Lorem ipsum dolor sit amet, consectetur elit sed do tempor.", "asdf asdf qwer qwer test test", "Text goes here. More text goes here."],
        "error": ["404 Not Found\n\nnginx/1.2", "Access denied. You do not have permission to view Alpha. Reference #11", "Diese Seite wurde nicht gefunden. Fehler 404 (alpha)."],
        "script": ["You need to enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript, um alpha anzuzeigen."],
    }
    good = ["Template syntax. Write `{{ alpha.title }}` inside a template and the beta replaces it. " + prose[0], "Status codes. A 404 Not Found answer means that the alpha has no such beta. " + prose[1], "Shell variables. The installer expands ${ALPHA_HOME} and %PATH% before the alpha starts. " + prose[2]]
    rows = [(k, t) for k, t in enumerate(prose + good)]
    first = len(rows)
    rows += [(first + k, t) for k, t in enumerate(t for ts in bad.values() for t in ts)]
    rows += [(5_000, None), (5_001, "  \n"), (first, rows[first][1]), (None, "404 Not Found"), (5_002, prose[0] * 200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, kind string")
    got = {r["analysis_id"]: r["kind"] for r in residue.residue(df).collect()}
    kinds = [k for k, ts in bad.items() for _ in ts]
    assert set(got) == {first + k for k in range(len(kinds))}
    wrong = {rows[first + k][1]: got[first + k] for k, kind in enumerate(kinds) if (got[first + k] == "placeholder") != (kind == "placeholder")}
    assert not wrong
    assert residue.residue(df.limit(0)).count() == 0


#: Wordings of other makers; none shares a phrase of four words with a training example.
OTHER_MAKERS = (
    "We searched everywhere but this address leads nowhere; maybe the page was removed. Error 404.", "Whoops, our server hit an unexpected error while handling this request.", "Too many login attempts. Retry in 15 minutes.", "This resource is forbidden for anonymous users. Please log in first.",
    "Gateway error: upstream server timed out after 30 seconds.", "Turn JavaScript on to use this site; your browser has disabled it.", "Scripts seem blocked by the browser, so nothing can be shown.", "Ihr Browser blockiert JavaScript. Bitte aktivieren Sie es und laden Sie die Seite neu.",
    "Dolor sit ipsum lorem, tempor magna aliqua veniam dolore sed elit.", "Your headline here. Your text here. Add text here.", "TODO: describe the garden", "Hello {{customer.first_name}}, welcome to {{shop.name}}",
)


def test_residue_of_other_makers():
    """Recall on wordings that the models weren't fitted on, against prose that holds none."""
    pieces = {tuple(w[i : i + 4]) for k, ts in residue_seeds.seeds().items() if k != "placeholder" for t in ts for w in [re.findall(r"[a-z]+", t.lower())] for i in range(len(w) - 3)}
    for text in OTHER_MAKERS:
        words = re.findall(r"[a-z]+", text.lower())
        assert not {tuple(words[i : i + 4]) for i in range(len(words) - 3)} & pieces, text
    prose = residue_prose()
    part = residue.Slice(prose)
    counts = np.zeros((2 + len(residue.CLASSES), 1 << residue.TABLE_BITS))
    counts[0], counts[1] = residue._bins(part.plain), residue._bins(part.shape)
    model = residue.models(counts)
    _, whole, left, _ = residue.judge([*OTHER_MAKERS, *prose[:50]], model)
    hit = (whole >= residue.COVERAGE) | (left >= residue.SHAPE_CHARS)
    assert hit[: len(OTHER_MAKERS)].mean() >= 0.9 and not hit[len(OTHER_MAKERS) :].any()


def test_residue_arrays_equal_plain_text():
    texts = ["Ab `c {{ d }}` EF 12 3`x", "", "`a\nb` g_H1", "ß ГД 9"]
    part = residue.Slice(texts)
    gap = "\x00" * residue._PAD
    back = "".join(map(chr, part.plain)).split(gap)[:-1]
    assert back == ["ab " + " " * 11 + " ef 00 0`x", "", "`a\nb` g_h0", "ß гд 0"]
    assert "".join(map(chr, part.shape)).split(gap)[:-1] == ["a" + " " * 13 + "A 0 0`a", "", "`a\na` a_a0", "a A 0"]


def test_failed_requests_are_no_cases(spark):
    rows = [(1, (None, None)), (2, None), (3, ("404 Not Found", None)), (3, ("404 Not Found", None))]
    df = spark.createDataFrame(rows, "analysis_id long, requests struct<content_preview:string,error:string>")
    assert [r["analysis_id"] for r in residue.residue_previews(df).collect()] == [3]


# ---- 4 similar vectors


def vector_rows(seed, width=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        base = rng.normal(size=width)
        for _ in range(rng.integers(1, 14)):
            rows.append((len(rows), (base + rng.normal(size=width) * rng.uniform(0, 0.35)).astype(np.float32).tolist()))
    same = rng.normal(size=width).astype(np.float32).tolist()
    rows += [(1000 + k, same) for k in range(15)] + [(1000, same), (2000, None), (2001, [0.0] * width), (2002, [1.0] * 48), (2003, [float("nan")] * width), (None, same)]
    return rows


def true_neighbours(rows, k):
    ok = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 64 and np.any(v) and not np.any(np.isnan(v))}
    ids = np.array(sorted(ok))
    m = np.array([ok[i] for i in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for a, row in enumerate(np.round(m @ m.T, 9)):
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-row[j], ids[j]))[:k]
        out[ids[a]] = [(ids[j], row[j]) for j in order]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_against_brute_force(spark, seed):
    rows = vector_rows(seed)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "id long, embedding array<float>, v int")
    expected = {(min(i, j), max(i, j)) for i, near in true_neighbours(rows, 10).items() for j, s in near if s >= 0.9}
    got = [tuple(r) for r in hashknn.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= expected
    assert len(got) >= 0.97 * len(expected)


def test_nearest_recall(spark):
    rows = vector_rows(3)
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = defaultdict(set)
    for r in hashknn.nearest(df, df.where("id % 7 = 0")).collect():
        got[r["segment_id"]].add(r["neighbour_id"])
    near = true_neighbours(rows, 10)
    assert set(got) == {i for i in near if i % 7 == 0}
    hits = sum(len(got[i] & {j for j, _ in near[i]}) for i in got)
    assert hits >= 0.95 * 10 * len(got)


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, None)], "id long, embedding array<float>")
    assert hashknn.similar_pairs(empty).count() == 0
    assert hashknn.nearest(empty, empty).count() == 0


def test_exact_pairs_and_heavy_values(spark, monkeypatch):
    """Many nearly equal vectors: their substring values are split, and the scan without an index finds the same pairs."""
    rng = np.random.default_rng(8)
    crowd = rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.02
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate((crowd, rng.normal(size=(200, 64)))).astype("float32"))]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    expected = {(min(i, j), max(i, j)) for i, near in true_neighbours(rows, 10).items() for j, s in near if s >= 0.9}
    exact = {tuple(r) for r in hashknn.similar_pairs_exact(df).collect()}
    assert len(exact ^ expected) <= 0.01 * len(expected)
    monkeypatch.setattr(hashknn, "HEAVY", 60)
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    bits, tables, _ = hashknn.index_shape(len(rows), 0.9)
    rotations = hashknn.fit_rotations(unit, -(-tables * bits // 64)).astype(np.float32)
    heavy = hashknn.heavy_values(unit, rotations, bits, tables, len(rows))
    key, first = hashknn._codes(unit, rotations, bits, tables)
    before = max(Counter(key.ravel().tolist()).values())
    after = max(Counter(hashknn._split_heavy(key, first, heavy).ravel().tolist()).values())
    assert len(heavy[0]) and after < before
    got = {tuple(r) for r in hashknn.similar_pairs(df).collect()}
    assert len(got & expected) >= 0.9 * len(expected)


def test_every_pair_at_the_edge_is_found(spark, monkeypatch):
    """Pairs just at and just below the least similarity, a crowd beside them, in one block and in several."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = np.where(np.arange(300) % 3 < 2, 0.751, 0.749)[:, None]
    crowd = base[:1] + rng.normal(size=(200, 64)) * 0.004
    vectors = np.concatenate((base, (cosine * base + np.sqrt(1 - cosine**2) * aside) * 3, crowd, crowd[:2])).astype("float32")
    rows = [(k * 7 % 1009, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    near = true_neighbours(rows, 10)
    expected = {(int(min(i, j)), int(max(i, j))) for i, found in near.items() for j, s in found if s >= 0.75}
    edge = {(min(a, b), max(a, b)) for a, b in ((k * 7 % 1009, (300 + k) * 7 % 1009) for k in range(1, 300) if k % 3 < 2)}
    assert edge <= expected
    for most in (100_000, 150):
        monkeypatch.setattr(hashknn, "SCAN_CLASSES", most)
        got = [tuple(r) for r in hashknn.similar_pairs(df, least=0.75).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    hashed = {tuple(r) for r in hashknn.similar_pairs_hashed(df, least=0.75).collect()}
    assert not edge <= hashed


def test_the_radius_of_the_index():
    """Codes within the radius share a substring and pass the bound; the edge's recall doesn't fall with size."""
    for n in (100, 10**4, 10**6, 10**9):
        bits, tables, bound = hashknn.index_shape(n, 0.9)
        p = 1 - np.arccos(0.9) / np.pi
        assert 64 * (1 - p) < bound < 24
        assert 1 - (1 - p**bits) ** tables >= hashknn.EDGE_RECALL - 1e-9
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(50, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    bits, tables, bound = hashknn.index_shape(5_000, 0.9)
    rotations = hashknn.fit_rotations(unit, -(-tables * bits // 64)).astype(np.float32)
    near = np.concatenate((unit, unit + rng.normal(size=unit.shape) * 0.004))
    code = ((near.astype(np.float32) @ rotations) > 0)[:, : tables * bits]
    key, first = hashknn._codes(near / np.linalg.norm(near, axis=1, keepdims=True), rotations, bits, tables)
    for k in range(50):
        if (code[k] != code[50 + k]).sum() <= min(tables - 1, bound):
            assert (key[k] == key[50 + k]).any() and int(first[k] ^ first[50 + k]).bit_count() <= bound


def test_nearest_is_exact_where_hashing_misses(spark):
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(20, 64)), 30, axis=0)
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True) + rng.normal(size=centres.shape) * 0.03
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(unit.astype("float32"))], "id long, embedding array<float>")
    got = {}
    for r in hashknn.nearest(df, df.where(F.col("id") % 5 == 0), k=2).collect():
        got.setdefault(r["segment_id"], {})[r["rank"]] = r["neighbour_id"]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    best = np.argsort(-score, axis=1, kind="stable")[:, :2]
    assert got == {q: {1: int(best[q, 0]), 2: int(best[q, 1])} for q in range(0, 600, 5)}


# ---- 5 splitting


@pytest.mark.parametrize("seed", range(6))
def test_pieces_cover_share_and_fit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "Another. ", "x" * rng.randrange(80), "\n\n", "\n# Head\n", "日本。", "\r\n", " ", "- item\n"]) for _ in range(300))
    for size, overlap in ((20, 0), (50, 7), (50, 49), (30, 99), (100_000, 10)):
        found = splitting.pieces(text, size, overlap)
        shared = min(overlap, size - 1)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        assert all(0 < b - a <= size for a, b, _ in found)
        assert all(later[0] == max(0, earlier[1] - shared) for earlier, later in zip(found, found[1:]))


def test_cuts_are_natural_where_they_can_be():
    text = "one two three. four five six.\n\nseven eight nine ten eleven"
    assert [text[a:b] for a, b, _ in splitting.pieces(text, 40, 0)] == ["one two three. four five six.\n\n", "seven eight nine ten eleven"]
    assert [level for _, _, level in splitting.pieces("a" * 25, 10, 0)] == ["character", "character", "end"]
    # the level is that of the cut, not of what stands before or after it
    assert [level for _, _, level in splitting.pieces("one two. three four.\n\n" + "five six seven eight. " * 3, 30, 0)] == ["paragraph", "sentence", "sentence", "end"]
    assert [level for _, _, level in splitting.pieces("# A\nsome words here\n## B\n" + "b" * 30 + " c", 24, 0)] == ["section", "sentence", "character", "end"]


def test_split_table(spark):
    profiles = spark.createDataFrame([("text", 10, 3), ("*", 5, 0), ("big", 1000, 0)], "segment_type string, chunk_size int, overlap int")
    rows = [(1, "a" * 11, " TEXT\t"), (1, "a" * 11, " TEXT\t"), (2, "a b c d e f", None), (3, "aaaaaa", "odd"), (4, None, "text"), (5, "", None), (6, "a" * 900, "big"), (7, "a b c", None), (None, "a b c d", None)]
    df = spark.createDataFrame([(i, c, t, 1) for i, c, t in rows], "id long, content string, segment_type string, chunk_size int")
    got = {r["segment_id"]: r["forced"] for r in splitting.oversized_segments(df, profiles).collect()}
    assert got == {1: 1, 2: 0, 3: 1, None: 0}
    many = splitting.split_oversized(df, profiles, max_profiles=1)
    same = splitting.split_oversized(df, profiles)
    assert sorted(map(str, many.collect())) == sorted(map(str, same.collect()))
    assert splitting.oversized_segments(df.limit(0), profiles).count() == 0


# ---- 7 lines of a site


def test_lines_by_share(spark):
    documents = spark.createDataFrame([(d, f"https://{'big' if d < 20 else 'small'}.example/{d}") for d in range(30)], "doc_id long, url string")
    segments = spark.createDataFrame([(d, d, ("the same line everywhere\n" if d % 20 < 6 else "") + f"a line of its own {d}") for d in range(30)], "id long, document_id long, content string")
    found = lambda **o: {r["segment_id"] for r in sitelines.repeated_lines(segments, documents, **o).collect()}
    # six of twenty documents, and six of ten
    assert found() == {*range(6), *range(20, 26)} and found(min_share=0.5) == set(range(20, 26))


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(2)
    common = ["All rights of this page are ours", "Subscribe to  our letter today", "short one"]
    documents = [(d, f"https://{'www.' if d % 2 else ''}Site{d % 3}.org{':8080' if d % 5 else ''}/p", "x") for d in range(40)] + [(40, None, "x"), (41, "no host", "x")]
    segments = []
    for s in range(120):
        lines = [rng.choice(common) if rng.random() < 0.3 else f"own line number {rng.randrange(9)} of all" for _ in range(6)]
        segments.append((s, s % 42, "\n".join(x.upper() if rng.random() < 0.2 else f"  {x}\t" for x in lines), "x"))
    segments += [segments[0], (900, 1, None, "x"), (901, 2, "", "x"), (902, None, common[0], "x"), (903, 3, common[0] * 5_000, "x")]
    site = {d: m.group(1).lower().removeprefix("www.") for d, u, _ in documents if u and (m := re.match(r"\w+://([^/:]+)", u))}
    normal = lambda x: " ".join(x.lower().split())
    where = defaultdict(set)
    for _, d, c, _ in segments:
        for line in (c or "").split("\n"):
            if d in site and len(normal(line)) >= 15:
                where[site[d], normal(line)].add(d)
    expected = {(s, n) for s, d, c, _ in segments for n, line in enumerate((c or "").split("\n")) if d in site and len(where[site[d], normal(line)]) >= 5}
    frame = spark.createDataFrame(segments, "id long, document_id long, content string, site string")
    pages = spark.createDataFrame(documents, "doc_id long, url string, site string")
    got = [tuple(r) for r in sitelines.repeated_lines(frame, pages).collect()]
    assert expected and len(got) == len(set(got)) and set(got) == expected
    clean = {r["segment_id"]: r["content"] for r in sitelines.without_repeated_lines(frame, pages).collect()}
    for s, _, c, _ in segments:
        assert clean[s] == (None if c is None else "\n".join(x for n, x in enumerate(c.split("\n")) if (s, n) not in expected))
    assert sitelines.repeated_lines(frame.limit(0), pages).count() == 0


# ---- 8 tokens


def test_stitched_encoding_is_the_encoding(spark):
    rng = random.Random(1)
    pieces = ["word", " don't", "  ", "\n\n", " 123", "é", "日本語", "!!'", "re", " \t ", "🙂", "a" * 70, " " * 50, "<|endoftext|>", "\r\n", "x'll"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 400))) for _ in range(60)] + [None, "", " " * 5_000, "a" * 5_000, "ab " * 5_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1]), (None, "a")]
    df = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, ids array<int>")
    enc = tokenise.encoding()
    for options in ({}, {"chunk_chars": 90, "overlap": 40}, {"chunk_chars": 400, "overlap": 100}):
        got = Counter((r["doc_id"], tuple(r["ids"])) for r in tokenise.encode_corpus(df, **options).collect())
        assert got == Counter((i, tuple(enc.encode_ordinary(t)) if t else ()) for i, t in rows)
    assert all(tokenise.decode_ids(enc.encode_ordinary(t)) == t.encode() for t in texts if t)
    assert tokenise.encode_corpus(df.limit(0)).count() == 0


def test_documents_of_the_tables_are_stitched(spark, sf_dir):
    """The tables' documents, and joins of several of them that are longer than a chunk of production size."""
    base = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").where(F.length("text") > 1_000).collect()]
    texts = dict(enumerate(base + ["\n\n".join(base[k : k + 8]) for k in range(0, len(base), 8)]))
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    enc = tokenise.encoding()
    assert sum(len(t) > 2 * tokenise.CHUNK_CHARS for t in texts.values()) >= len(base) // 10
    for options in ({}, {"chunk_chars": 1_500, "overlap": 200}):
        got = {r["doc_id"]: list(r["ids"]) for r in tokenise.encode_corpus(documents, **options).collect()}
        assert got == {i: enc.encode_ordinary(t) for i, t in texts.items()}


def test_ids_equal_the_other_file_of_the_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ("Hello  world\n\n x=1;", "naïve 日本 🙂", "<|endoftext|>"):
        assert tokenise.encoding().encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids


# ---- 9 leaked items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(8, 40)))) for k in range(50)]
    items += [(50, items[0][1]), (51, None), (52, ""), (0, items[0][1])]
    documents = []
    for d in range(60):
        words = rng.choices(WORDS + ["other", "words"], k=rng.randrange(0, 300))
        for _ in range(rng.randrange(3)):
            piece = rng.choice(items[:50])[1].split()
            a = rng.randrange(len(piece))
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece[a : a + rng.randrange(10, 20)]
        documents.append((d, ", ".join(words).upper()))
    documents += [(100, None), (101, ""), documents[0], (None, items[0][1]), (102, (items[3][1] + " ") * 2_000)]
    runs = lambda t: {tuple(w[k : k + 13]) for w in [words_of(t or "")] for k in range(len(w) - 12)}
    wanted = {(i, r) for i, t in items for r in runs(t)}
    index = defaultdict(set)
    for i, r in wanted:
        index[r].add(i)
    expected = {(d, i) for d, t in documents if d is not None for r in runs(t) for i in index[r]}
    left = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in leakage.leaked_items(left, right).collect()]
    assert expected and len(got) == len(set(got)) and set(got) == expected


def test_leaks_in_shards(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SCAN_CHARS", 200)
    monkeypatch.setattr(leakage, "SHARD_ITEMS", 2)
    monkeypatch.setattr(leakage, "POSTINGS", 200)
    text = " ".join(WORDS[:15])
    items = spark.createDataFrame([(k, text if k == 4 else f"{text[:30]} {k}") for k in range(7)], "item_id long, text string")
    documents = spark.createDataFrame([(1, f"x {text} y")], "doc_id long, text string")
    assert [tuple(r) for r in leakage.leaked_items(documents, items).collect()] == [(1, 4)]
    assert leakage.leaked_items(documents, items.limit(0)).count() == 0
    assert leakage.leaked_items(documents.limit(0), items).count() == 0


# ---- 10 garbled text


CLEAN = [
    "Der größte Händler prüft die übliche Straße über der Tür.", "Le contrôleur caché rétablit le écouteur après l'été à Besançon.", "El índice único añade el árbol después del señalador; ¿por qué?", "ATENÇÃO: A exceção NÃO divide a sessão (AÇÃO, ÂNGULO).",
    "Каждый новый агент снова пропускает адрес, пока не ждёт ответ.", "この部品は最初の設定を集めます。転送が大きいとき、複製を返します。", "├── src\n│   └── main\n┌─┬┐ └┴┘", "“Quotes” — and ‘more’ … 20 °C ± 5 %, §4 ¶2 €35 £30 ½ ×", "plain ascii only, nothing to see", "«\xa0privé\xa0» naïve façade œuvre", "👍🏽 emoji",
]


def test_wrong_decodings_are_found_and_restored(spark):
    rows = [(100 * k + n, t + f" {k}") for k in range(12) for n, t in enumerate(CLEAN)]
    bad = {}
    for k, (true, wrong) in enumerate(mojibake.PAIRS):
        for n, text in enumerate(CLEAN[:6]):
            try:
                raw = text.encode(true)
            except UnicodeEncodeError:
                continue
            chars = {b: c for c, b in enumerate(mojibake.byte_of(wrong)) if b < 256}
            garbled = "".join(chr(chars[b]) for b in raw)
            if garbled != text and (true == "utf-8" or n == {"cp1251": 4, "shift_jis": 5}[true]):
                bad[10_000 + 100 * k + n] = (garbled, text)
    once = CLEAN[1].encode("utf-8").decode("latin-1")
    bad[20_000] = (f"{CLEAN[0]} {once} {CLEAN[0]}", f"{CLEAN[0]} {CLEAN[1]} {CLEAN[0]}")
    twice = CLEAN[0].encode("utf-8").decode("cp1252", "replace")
    if "�" not in twice:
        bad[20_001] = (twice.encode("utf-8").decode("latin-1"), None)
    bad[20_002] = ("Gr��e und 锟斤拷 mehr", None)
    rows += [(i, g) for i, (g, _) in bad.items()] + [(30_000, None), (30_001, ""), (20_002, bad[20_002][0]), (None, bad[20_002][0])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    found = mojibake.garbled_documents(df).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(got) and set(got) == set(bad)
    for i, (_, text) in bad.items():
        if text is not None:
            assert got[i]["text"] == text and got[i]["restored"], (i, got[i]["text"], text)
    assert got[20_002]["lost"] == 5 and not got[20_002]["restored"]
    assert mojibake.garbled_documents(df.limit(0)).count() == 0


def test_text_garbled_many_times(spark):
    text = CLEAN[0]
    rows = [(100 * k + n, t + f" {k}") for k in range(12) for n, t in enumerate(CLEAN)]
    deep = {}
    for times in range(1, 7):
        text = text.encode("utf-8").decode("latin-1")
        deep[5_000 + times] = text
    found = {r["doc_id"]: r for r in mojibake.garbled_documents(spark.createDataFrame(rows + list(deep.items()), "doc_id long, text string")).collect()}
    assert set(found) == set(deep)
    for i in deep:
        # the flag says whether the original came out
        assert found[i]["restored"] == (found[i]["text"] == CLEAN[0]), (i, found[i]["text"])
    assert all(found[5_000 + k]["restored"] for k in range(1, 5))


def test_best_span_equals_viterbi():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        score, gap = rng.normal(-1, 4, n), np.abs(rng.normal(0, 1, n))
        inside = np.zeros(n, dtype=bool)
        for state, (true, _) in enumerate(mojibake.PAIRS):
            scores = np.full((len(mojibake.PAIRS), n), -50.0)
            scores[state] = score
            labels = mojibake.viterbi(scores, np.tile(gap, (len(mojibake.PAIRS), 1)), np.zeros_like(scores))
            hot = mojibake.best_span(score, np.concatenate(([0.0], gap[1:])), inside).max() > mojibake.COST[state]
            assert hot == bool((labels == state).any())


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(boilerplate.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "folioforge.llm" not in path.read_text(), path
    assert F is not None
