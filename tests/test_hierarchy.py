import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators.components import connected_components
from folioforge.operators.hierarchy import descendants, nested_sets


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            held = parent.get(i)
            parent[i] = p if held is None else held if p is None else min(p, held)
    out = {}
    for i in parent:
        seen, x = [], i
        while True:
            if x in seen:
                out[i] = (min(seen[seen.index(x) :]), -1, None)
                break
            seen.append(x)
            p = parent[x]
            if p is None or p not in parent:
                out[i] = (x, len(seen) - 1, tuple(reversed(seen)))
                break
            x = p
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, p, "a", 1) for i, p in rows], "id long, parent_id long, depth string, lo int")
    return nested_sets(df, "id", "parent_id", with_path=True)


def check(spark, rows):
    sets = run(spark, rows)
    found = sets.collect()
    expected = brute(rows)
    got = {r["id"]: (r["root_id"], r["depth"], tuple(r["path"]) if r["path"] else None) for r in found}
    assert got == expected and len(found) == len(expected)
    sizes = {i: sum(1 for r, d, path in expected.values() if path and i in path) for i in expected}
    ranges = {r["id"]: (r["root_id"], r["lo"], r["size"]) for r in found if r["depth"] >= 0}
    assert all(sizes[i] == size for i, (_, _, size) in ranges.items())
    for i, (root, lo, size) in ranges.items():
        inside = {j for j, (r, other, _) in ranges.items() if r == root and lo <= other < lo + size}
        assert inside == {j for j, (_, d, path) in expected.items() if path and i in path}
    pairs = {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in descendants(sets).collect()}
    assert pairs == {(a, path[-1], len(path) - 1 - k) for _, _, path in expected.values() if path for k, a in enumerate(path[:-1])}


def test_tree_loops_lost_parents_and_copies(spark):
    check(spark, [(1, None), (2, 1), (3, 1), (4, 2), (5, 99), (6, 6), (7, 8), (8, 9), (9, 7), (10, 9), (11, 10), (4, 2), (12, None), (None, 1)])


def test_empty_and_only_loops(spark):
    check(spark, [])
    check(spark, [(2, 3), (3, 2), (4, 3)])


def test_long_chain(spark):
    check(spark, [(i, i - 1 if i else None) for i in range(40)])


def test_chain_of_a_hundred_thousand(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end as parent_id")
    sets = nested_sets(chain, "id", "parent_id")
    asked = spark.createDataFrame([(0,), (n // 2,), (n - 3,), (n - 1,), (n + 5,)], "id long")
    found = descendants(sets, asked).groupBy("ancestor_id").agg(F.count("*"), F.min("descendant_id"), F.max("distance"), F.count_distinct("descendant_id")).collect()
    assert {tuple(r) for r in found} == {(a, n - 1 - a, a + 1, n - 1 - a, n - 1 - a) for a in (0, n // 2, n - 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest(spark, seed):
    rng = random.Random(seed)
    check(spark, [(i, rng.choice([None, *range(60)])) for i in rng.sample(range(60), 50)])


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 5), (9, 9), (None, 3), (7, 8), (8, 10), (10, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 10: 7}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
