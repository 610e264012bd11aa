"""Parent-child rows to full hierarchies: leaf peeling, Euler tours and parallel list ranking.

``hierarchy`` works on rows (id, parent) that form a functional graph, so each component is a tree or a
cycle with trees hanging off it.

1. Leaves are peeled for a few rounds; what is left holds every cycle. Trees higher than the number of
   rounds leave their tops too; pointer doubling on that small core tells the tops from the cycles, so the
   number of rounds is logarithmic in the height.
2. Each tree (a cycle's node counts as the root of what hangs below it) gets its Euler tour: an arc down and
   an arc up for each inner node, one merged arc for a leaf. The successor of an arc needs the next sibling
   and the first child; families larger than ``family_rows`` are cut into buckets that are linked to each
   other, so that no task holds an unbounded family.
3. List ranking by pointer doubling gives, for each arc, the number of arcs and the sum of +1/-1 to the end of
   its tour. Arcs that have reached the end leave the active set. From these: entry, exit, depth, root and
   the number of descendants.

Defined results: rows with a null id are ignored; of several rows of one id the smallest non-null parent
holds; a parent that is null or does not exist makes the node a root of depth 0; nodes on or below a cycle
get the smallest id on the cycle as root, depth -1 and no path. Empty input gives empty output.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

PEEL_ROUNDS = 5
FAMILY_ROWS = 100_000


def normalized(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row (id, parent, known) per id; known tells whether the parent exists."""
    rows = (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(parent_col).cast("bigint").alias("parent"))
        .filter("id is not null")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    ids = rows.select(F.col("id").alias("pid"))
    return rows.join(ids, rows.parent == ids.pid, "left").select("id", "parent", F.col("pid").isNotNull().alias("known"))


def cycles(links: DataFrame, peel_rounds: int = PEEL_ROUNDS) -> DataFrame | None:
    """(id, cycle) of each node on a cycle; cycle is its smallest id. ``links``: (id, parent) with existing parents.

    None where there is no cycle.
    """
    core = links.select("id", "parent")
    for _ in range(peel_rounds):
        core = core.join(core.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
    core = cut(core)
    left = core.count()
    if not left:
        return None
    jump = core.select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low"))
    steps = 1
    while steps < left:
        to = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        # a pointer that leaves the core has reached a root: that chain is no cycle
        jump = cut(jump.join(to, "ptr").select("id", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low")))
        steps *= 2
        left = min(left, jump.count())
        if not left:
            return None
    on = jump.select(F.col("ptr").alias("id")).distinct()
    return cut(jump.join(on, "id", "left_semi").select("id", F.col("low").alias("cycle")))


def tours(edges: DataFrame, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """The arcs (node, up, next_node, next_up, arcs, rise, root) of the Euler tours of ``edges`` (id, parent)."""
    largest = edges.groupBy("parent").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, math.ceil(largest / family_rows))
    kids = edges.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    within = Window.partitionBy("parent", "salt").orderBy("id")
    kids = kids.withColumn("sibling", F.lead("id").over(within))
    families = edges.groupBy("parent").agg(F.min(F.struct(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"), F.col("id")))["id"].alias("first"))
    if buckets > 1:
        heads = kids.groupBy("parent", "salt").agg(F.min("id").alias("head"))
        heads = heads.withColumn("head", F.lead("head").over(Window.partitionBy("parent").orderBy("salt")))
        kids = kids.join(heads, ["parent", "salt"]).withColumn("sibling", F.coalesce("sibling", "head")).drop("head")
    families = cut(families)
    kids = kids.select("id", "parent", "sibling")
    kids = kids.join(families.select(F.col("parent").alias("id"), "first"), "id", "left")
    inner = kids.filter("first is not null").select(F.col("id").alias("parent"), F.lit(True).alias("parent_has_arcs"))
    kids = kids.join(inner, "parent", "left")
    after = F.when(F.col("sibling").isNotNull(), F.struct(F.col("sibling").alias("n"), F.lit(False).alias("u"))).when(
        F.col("parent_has_arcs"), F.struct(F.col("parent").alias("n"), F.lit(True).alias("u"))
    )
    ends = F.when(after.isNull(), F.col("parent"))

    def arc(up, following, arcs, rise, root):
        return F.struct(F.lit(up).alias("up"), following["n"].alias("next_node"), following["u"].alias("next_up"), F.lit(arcs).cast("bigint").alias("arcs"), F.lit(rise).cast("bigint").alias("rise"), root.alias("root"))

    down = F.struct(F.col("first").alias("n"), F.lit(False).alias("u"))
    nobody = F.lit(None).cast("bigint")
    return kids.select(
        F.col("id").alias("node"),
        F.explode(
            F.when(F.col("first").isNull(), F.array(arc(False, after, 2, 0, ends))).otherwise(
                F.array(arc(False, down, 1, 1, nobody), arc(True, after, 1, -1, ends))
            )
        ).alias("a"),
    ).select("node", "a.*")


def ranked(arcs: DataFrame) -> DataFrame:
    """List ranking: every arc with the arcs and the rise from it to the end of its tour, and the tour's root."""
    state = cut(arcs)
    while state.filter("next_node is not null").limit(1).count():
        to = state.select(
            F.col("node").alias("next_node"), F.col("up").alias("next_up"), F.col("next_node").alias("n2"), F.col("next_up").alias("u2"),
            F.col("arcs").alias("arcs2"), F.col("rise").alias("rise2"), F.col("root").alias("root2"),
        )
        moved = state.filter("next_node is not null").join(to, ["next_node", "next_up"]).select(
            "node", "up", F.col("n2").alias("next_node"), F.col("u2").alias("next_up"), (F.col("arcs") + F.col("arcs2")).alias("arcs"),
            (F.col("rise") + F.col("rise2")).alias("rise"), F.col("root2").alias("root"),
        )
        state = cut(state.filter("next_node is null").unionByName(moved))
    return state.select("node", "up", "arcs", "rise", "root")


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", peel_rounds: int = PEEL_ROUNDS, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """(id, parent, known, root, depth, entry, exit, descendants) of every id of ``df``.

    entry and exit are positions in the tour of the root's tree: x is below a iff both have one root and
    entry(a) < entry(x) and exit(x) < exit(a); a root has entry -1 and, as exit, the largest bigint. On or below
    a cycle depth is -1, and entry, exit and descendants are null.
    """
    nodes = cut(normalized(df, id_col, parent_col))
    links = nodes.filter("known").select("id", "parent")
    ring = cycles(links, peel_rounds)
    edges = links.join(ring.select("id"), "id", "left_anti") if ring is not None else links
    ranks = ranked(tours(edges, family_rows))
    spans = ranks.groupBy("node").agg(
        F.min("root").alias("root"),
        F.max(F.when(~F.col("up"), F.col("arcs"))).alias("enter"),
        F.max(F.when(~F.col("up"), F.col("rise"))).alias("rise"),
        F.max(F.when(F.col("up"), F.col("arcs"))).alias("leave"),
    )
    # positions count from the tour's end, so the larger number is the earlier one; a leaf leaves right after it entered
    spans = spans.select(
        F.col("node").alias("id"), "root", (1 - F.col("rise")).cast("bigint").alias("depth"), (-F.col("enter")).alias("entry"),
        (-F.coalesce("leave", F.col("enter") - 1)).alias("exit"), ((F.col("enter") - F.coalesce("leave", F.col("enter") - 1) - 1) / 2).cast("bigint").alias("descendants"),
    )
    sizes = spans.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("below"))
    out = nodes.join(spans, "id", "left").join(sizes, "id", "left")
    top = F.col("depth").isNull()
    out = out.select(
        "id", "parent", "known", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
        F.when(top, F.lit(-(2**63)).cast("bigint")).otherwise(F.col("entry")).alias("entry"), F.when(top, F.lit(2**63 - 1)).otherwise(F.col("exit")).alias("exit"),
        F.when(top, F.coalesce("below", F.lit(0))).otherwise(F.col("descendants")).cast("bigint").alias("descendants"),
    )
    if ring is None:
        return out
    looped = F.col("cycle").isNotNull()
    none = F.lit(None).cast("bigint")
    return out.join(ring.select(F.col("id").alias("root"), "cycle"), "root", "left").select(
        "id", "parent", "known", F.coalesce("cycle", "root").alias("root"), F.when(looped, F.lit(-1)).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        *[F.when(looped, none).otherwise(F.col(c)).alias(c) for c in ("entry", "exit", "descendants")],
    )


def roots_and_depths(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root, depth) of the rows with a non-null parent."""
    return hierarchy(df, id_col, parent_col).filter("parent is not null").select("id", "root", "depth")


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for all pairs of ``hierarchy``'s trees, by doubling of ancestor lists.

    Pairs are rows, so a root above a third of all nodes stays spread over tasks. Nodes on or below cycles have none.
    """
    return ancestor_lists(tree).select(F.col("id").alias("descendant"), F.posexplode("above").alias("distance", "ancestor")).select("ancestor", "descendant", (F.col("distance") + 1).cast("bigint").alias("distance"))


def ancestor_lists(tree: DataFrame) -> DataFrame:
    """(id, above): the ancestors of each node of a tree, nearest first; rounds are logarithmic in the depth."""
    state = cut(tree.filter("depth >= 0").select("id", "depth", F.when(F.col("known"), F.array("parent")).otherwise(F.array().cast("array<bigint>")).alias("above")))
    while True:
        todo = state.filter("size(above) < depth")
        if not todo.limit(1).count():
            return state.select("id", "above")
        to = state.select(F.col("id").alias("far"), F.col("above").alias("more"))
        moved = todo.withColumn("far", F.element_at("above", -1)).join(to, "far").select("id", "depth", F.concat("above", "more").alias("above"))
        state = cut(state.filter("size(above) >= depth").unionByName(moved))


def paths(tree: DataFrame, names: DataFrame, separator: str = ".") -> DataFrame:
    """``tree`` with ``path``: the names from the root to the node. ``names``: (id, name), a null name reads as ''.

    Nodes on or below a cycle have a null path.
    """
    names = names.groupBy("id").agg(F.coalesce(F.min("name"), F.lit("")).alias("name"))
    state = tree.select("id", "depth", F.when(F.col("known") & (F.col("depth") > 0), F.col("parent")).alias("far")).join(names, "id", "left")
    state = cut(state.select("id", F.when(F.col("depth") >= 0, F.col("far")).alias("far"), "depth", F.coalesce("name", F.lit("")).alias("path")))
    while state.filter("far is not null").limit(1).count():
        to = state.select(F.col("id").alias("far"), F.col("far").alias("far2"), F.col("path").alias("head"))
        moved = state.filter("far is not null").join(to, "far").select("id", F.col("far2").alias("far"), "depth", F.concat_ws(separator, "head", "path").alias("path"))
        state = cut(state.filter("far is null").unionByName(moved))
    return tree.join(state.select("id", F.when(F.col("depth") >= 0, F.col("path")).alias("path")), "id")
