"""Parent-child rows to full hierarchies, as nested sets.

``nested_sets`` works in two sweeps, both by pointer doubling, so a tree of
depth D takes about ``log2(D)`` rounds rather than D:

* upward: every node ends up with the size of its subtree.  In round k a node
  hands what it has gathered within distance ``2**k`` to its ancestor at exactly
  that distance.  A node whose pointer never reaches a root is not processed:
  it lies on a loop or below one.
* downward: siblings get disjoint preorder ranges by a prefix sum over their
  sizes, and the offsets are summed along the path to the root.

``lo`` is the preorder number inside the tree of ``root_id`` and the subtree of
a node is exactly the rows of the same root with ``lo`` in ``[lo, lo + size)``.

Defined results
    * repeated rows count once; of several parents of one id the smallest counts
    * a null id is left out; a null or unknown parent makes a root (depth 0)
    * on or below a loop: depth -1, ``root_id`` the smallest id on the loop,
      ``size`` and ``lo`` null, ``path`` null
    * an empty table gives an empty result; other columns are ignored
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.session import cut, discard

#: Siblings are prefix-summed in chunks of this many consecutive ids, so that a
#: parent of millions of children never becomes one task's window.
SIBLING_CHUNK = 65_536


def _links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent) once per id, with parents that don't exist set to null."""
    nodes = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return nodes.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _sizes_upward(links: DataFrame) -> tuple[DataFrame, int]:
    """(id, anc, dist, done, sz) of the nodes in a tree of two or more, and the rounds it took."""
    child = links.where(F.col("parent").isNotNull())
    tops = child.select(F.col("parent").alias("id")).distinct().join(child.select("id"), "id", "left_anti")
    state = cut(
        child.select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("done"), F.lit(1).cast("long").alias("sz")).unionByName(
            tops.select("id", F.col("id").alias("anc"), F.lit(0).cast("long").alias("dist"), F.lit(True).alias("done"), F.lit(1).cast("long").alias("sz"))
        ),
        "up",
    )
    done, rounds = -1, 0
    while True:
        reach = 1 << rounds
        given = state.where(F.col("dist") == reach).groupBy(F.col("anc").alias("id")).agg(F.sum("sz").alias("more"))
        far = state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = state.where(~F.col("done")).join(far, "anc").select("id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), "sz")
        new = cut(
            moved.unionByName(state.where(F.col("done"))).join(given, "id", "left").select("id", "anc", "dist", "done", (F.col("sz") + F.coalesce("more", F.lit(0))).alias("sz")),
            "up",
            {"done": F.count_if("done"), "all": F.count(F.lit(1))},
        )
        discard(state)
        state, before, rounds = new, done, rounds + 1
        done = state._folio_measures["done"]
        if done in (state._folio_measures["all"], before):
            return state, rounds


def _ranges_downward(sizes: DataFrame, links: DataFrame, rounds: int, with_path: bool) -> DataFrame:
    """(id, root_id, depth, size, lo[, path]) of the processed nodes of ``sizes``."""
    tree = sizes.where("done").select("id", F.col("sz").alias("size")).join(links, "id")
    child = tree.where(F.col("parent").isNotNull()).withColumn("chunk", F.expr(f"id div {SIBLING_CHUNK}"))
    per_chunk = child.groupBy("parent", "chunk").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("parent").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select("parent", "chunk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("parent", "chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = child.join(base, ["parent", "chunk"]).select(
        "id", "size", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("dist"), (1 + F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("lo"), F.lit(False).alias("done")
    )
    top = tree.where(F.col("parent").isNull()).select("id", "size", F.col("id").alias("anc"), F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("lo"), F.lit(True).alias("done"))
    both = placed.unionByName(top)
    if with_path:
        both = both.withColumn("path", F.array("id"))
    state = cut(both, "down")
    extra = ["path"] if with_path else []
    for _ in range(rounds):
        far = state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("lo").alias("lo2"), F.col("done").alias("done2"), *[F.col(c).alias("path2") for c in extra])
        moved = (
            state.where(~F.col("done"))
            .join(far, "anc")
            .select("id", "size", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("lo") + F.col("lo2")).alias("lo"), F.col("done2").alias("done"), *[F.concat("path2", "path").alias("path") for _ in extra])
        )
        new = cut(moved.unionByName(state.where(F.col("done"))), "down", {"open": F.count_if(~F.col("done"))})
        discard(state)
        state = new
        if not state._folio_measures["open"]:
            break
    return state.select("id", F.col("anc").alias("root_id"), F.col("dist").alias("depth"), "size", "lo", *extra)


def _loops(sizes: DataFrame, links: DataFrame) -> DataFrame | None:
    """(id, root_id) of the nodes that the upward sweep left unprocessed."""
    state = cut(sizes.where(~F.col("done")).select("id", "anc"), "loop", {"n": F.count(F.lit(1))})
    if not state._folio_measures["n"]:
        discard(state)
        return None
    # f**n maps the nodes into the loops once its image stops shrinking
    size = -1
    while (now := state.select("anc").distinct().count()) != size:
        size = now
        new = cut(state.join(state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2")), "anc").select("id", F.col("anc2").alias("anc")), "loop")
        discard(state)
        state = new
    on_loop = state.select(F.col("anc").alias("id")).distinct()
    low = cut(links.join(on_loop, "id").select("id", F.col("parent").alias("nxt"), F.col("id").alias("low")), "low")
    changed = 1
    while changed:
        far = low.select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"))
        new = cut(low.join(far, "nxt").select("id", F.col("nxt2").alias("nxt"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")), "low", {"fell": F.count_if("fell")})
        changed = new._folio_measures["fell"]
        discard(low)
        low = new.drop("fell")
        low._folio_path = new._folio_path
    return state.join(low.select(F.col("id").alias("anc"), F.col("low").alias("root_id")), "anc").select("id", "root_id")


def nested_sets(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", with_path: bool = False) -> DataFrame:
    """(id, root_id, depth, size, lo[, path]) of every id; see the module text for the defined results.

    ``path`` is the array of ids from the root down to the node itself; it has as many
    elements as the node is deep, so ask for it only where paths are wanted.
    """
    links = cut(_links(df, id_col, parent_col), "links")
    sizes, rounds = _sizes_upward(links)
    tree = _ranges_downward(sizes, links, rounds, with_path)
    loops = _loops(sizes, links)
    lone = links.where(F.col("parent").isNull()).join(links.select(F.col("parent").alias("id")).where(F.col("id").isNotNull()), "id", "left_anti")
    cols = [F.col("id"), F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("lo")]
    out = tree.unionByName(lone.select(*cols, *([F.array("id").alias("path")] if with_path else [])))
    if loops is not None:
        null = F.lit(None).cast("long")
        out = out.unionByName(
            loops.select("id", "root_id", F.lit(-1).cast("long").alias("depth"), null.alias("size"), null.alias("lo"), *([F.lit(None).cast("array<bigint>").alias("path")] if with_path else []))
        )
    return out


def descendants(sets: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of every pair, from the ranges of ``nested_sets``.

    The subtree of a node is the range ``(lo, lo + size)`` of its root.  A range is
    the disjoint union of at most two aligned blocks of each power of two, and a
    place lies in one block of each, so the range join is an equality join on (root,
    block): every pair meets exactly once, and nothing else meets.  ``ancestors``
    (column ``id``) keeps the descendants of some nodes only.
    """
    nodes = cut(sets.where(F.col("lo").isNotNull()).select("id", "root_id", "depth", "size", "lo"), "ranges")
    asked = nodes.where(F.col("size") > 1)
    if ancestors is not None:
        asked = asked.join(ancestors.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("size"))).cast("int"))
    wide = asked.select("id", "root_id", "depth", (F.col("lo") + 1).alias("s"), (F.col("lo") + F.col("size")).alias("e"), F.explode(levels).alias("level"))
    wide = wide.select("id", "root_id", "depth", "level", F.expr("shiftright(s + shiftleft(1L, level) - 1, level)").alias("l"), F.expr("shiftright(e, level)").alias("r")).where(F.col("l") < F.col("r"))
    pieces = F.filter(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)), lambda b: b.isNotNull())
    wide = wide.select(F.col("id").alias("ancestor_id"), "root_id", F.col("depth").alias("above"), "level", F.explode(pieces).alias("block"))
    # at most 63 values
    used = sorted(r["level"] for r in wide.select("level").distinct().collect())
    if not used:
        return wide.select("ancestor_id", F.col("ancestor_id").alias("descendant_id"), F.lit(0).cast("long").alias("distance"))
    # a root lies in no range
    places = nodes.where(F.col("lo") > 0).select(F.col("id").alias("descendant_id"), "root_id", F.col("depth").alias("below"), "lo", F.explode(F.array(*[F.lit(k) for k in used])).alias("level"))
    places = places.select("descendant_id", "root_id", "below", "level", F.expr("shiftright(lo, level)").alias("block"))
    return wide.join(places, ["root_id", "level", "block"]).select("ancestor_id", "descendant_id", (F.col("below") - F.col("above")).cast("long").alias("distance"))
