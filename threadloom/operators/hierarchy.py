"""Parent-child rows to full hierarchies, by hash splitters and a reduced pointer graph.

Following parents one step per round needs as many joins as the deepest tree has
levels. Instead:

1. *Splitters.* A fixed hash of the id makes one node in ``split`` a splitter;
   nodes without a parent node (tree tops) are splitters too.
2. *Walk.* Every other node doubles its pointer (pointer of the pointer) until
   it reaches a splitter. About log2 of the longest gap rounds are needed,
   whatever the depth. Nodes that have arrived take no further part.
3. *Reduce.* Splitters alone, one node in ``split``, form a pointer graph which
   is solved by the same doubling.
4. *Expand.* Each node adds its splitter's answer to its own segment; exact
   paths come from concatenated segments.
5. *Cycles.* A round in which no node arrives proves that no walking node can
   ever arrive: on any finite chain some node has exactly the next gap. What is
   left lies on a cycle or runs into one. Those nodes (and the splitters found to
   be cyclic) are solved apart: the image of the 2^k-th parent shrinks until it
   is exactly the set of nodes on cycles.

All state is written to the shared folder between rounds, so plans stay short and
survive lost executors. Pointers are a function (one parent a node), so no join
multiplies rows. Nodes that point at one very frequent node do not meet in one
task: that node's row, one of at most ``2 / HOT_SHARE``, goes to them in a
broadcast (``join_hot``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import plain_id, plain_key
from threadloom.runtime import Scratch, broadcast_if_small, hot_keys, join_hot

#: One node in so many is a splitter, besides the tops.
SPLIT = 8


@dataclass
class Hierarchy:
    """nodes: one row per node; edges: (node, parent) for nodes whose parent is a node."""

    nodes: DataFrame
    edges: DataFrame
    with_paths: bool


def _is_splitter(c: Column, split: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(split)) == 0


def _double(state: DataFrame, scratch: Scratch, with_paths: bool) -> tuple[DataFrame, DataFrame, int]:
    """Pointer doubling until no node arrives any more.

    state: id, ptr, dist, done[, seg]. ``seg`` holds the ids from ptr (inclusive)
    down to the node's parent. Returns arrived rows, rows that can never arrive,
    and the number of the latter.
    """
    extra = ["seg"] if with_paths else []
    cols = ["id", "ptr", "dist", *extra]
    arrived = [state.filter("done").select(*cols)]
    table, walking = state, state.filter(~F.col("done"))
    left = walking.count()
    # A walking node's pointer is itself in the table: the look-up is total.
    while left:
        look = table.select(F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("dist").alias("_d"), F.col("done").alias("_done"), *[F.col("seg").alias("_s") for _ in extra])
        moved = join_hot(walking, look, "ptr", hot_keys(walking, "ptr")).select(
            "id", F.col("_p").alias("ptr"), (F.col("dist") + F.col("_d")).alias("dist"), F.col("_done").alias("done"), *[F.concat("_s", "seg").alias("seg") for _ in extra]
        )
        moved, seen = scratch.counted(moved, left=~F.col("done"))
        now = seen["left"]
        arrived.append(moved.filter("done").select(*cols))
        if now == left:
            return _all(arrived), moved.filter(~F.col("done")).select(*cols), now
        # Rows that still walk look up: rows that had arrived, and the moved ones.
        table = _all([a.withColumn("done", F.lit(True)) for a in arrived] + [moved.filter(~F.col("done"))])
        walking, left = moved.filter(~F.col("done")), now
    return _all(arrived), walking.select(*cols), 0


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _cycles(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, on_cycle, cycle_id (smallest id of its cycle; null off the cycle) of nodes that all run into cycles.

    edges: id, parent, with every parent an id of the table too.
    """
    jump = scratch.keep(edges.select("id", F.col("parent").alias("ptr")))
    image = jump.select(F.col("ptr").alias("id")).distinct()
    n_image = image.count()
    while True:  # sizes of f^1, f^2, f^4, ... (nodes): equal twice means only cycles are left
        step = join_hot(jump, jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("_next")), "ptr", hot_keys(jump, "ptr"))
        jump = scratch.keep(step.select("id", F.col("_next").alias("ptr")))
        image = jump.select(F.col("ptr").alias("id")).distinct()
        before, n_image = n_image, image.count()
        if n_image == before:
            break
    on = scratch.keep(image)
    # On the cycles the parent function is a permutation: double the smallest id seen.
    ring = scratch.keep(edges.join(on, "id", "left_semi").select("id", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")))
    while True:
        nxt = ring.alias("a").join(ring.alias("b"), F.col("a.ptr") == F.col("b.id")).select(
            F.col("a.id").alias("id"), F.col("b.ptr").alias("ptr"), F.least("a.low", "b.low").alias("low"), (F.least("a.low", "b.low") != F.col("a.low")).alias("changed")
        )
        nxt, seen = scratch.counted(nxt, changed=F.col("changed"))
        ring = nxt.drop("changed")
        if not seen["changed"]:
            break
    return edges.select("id").join(ring.select("id", F.col("low").alias("cycle_id")), "id", "left").select("id", F.col("cycle_id").isNotNull().alias("on_cycle"), "cycle_id")


def _cycle_paths(rest: DataFrame, rings: DataFrame, scratch: Scratch, split: int) -> DataFrame:
    """id, path of nodes on or below cycles: every ancestor once, the nearest last, then the node.

    Without the parent of its smallest id each cycle is a chain, and all nodes
    that run into it make a tree below that id. What that tree's path lacks are
    the cycle's ids between the node (or where its chain enters) and the cut.
    """
    low = rings.filter("on_cycle").select("id", "cycle_id")
    cut = scratch.keep(rest.join(low, "id", "left").select("id", F.when(F.col("cycle_id").isNull() | (F.col("id") != F.col("cycle_id")), F.col("parent")).alias("parent")))
    tree = scratch.keep(resolve(cut, scratch, split).nodes.select("id", "top", "height", "path"))
    whole = tree.join(low.select("id"), "id", "left_semi").groupBy("top").agg(F.max_by("path", "height").alias("_ring"))
    shared = F.size(F.array_intersect("path", "_ring"))
    return tree.join(whole, "top").select("id", F.concat(F.slice("_ring", shared + 1, F.size("_ring")), "path").alias("path"))


def resolve(nodes: DataFrame, scratch: Scratch, split: int = SPLIT, with_paths: bool = True, cycle_paths: bool = False) -> Hierarchy:
    """Depth, top and path of every node of a parent table.

    nodes: ``id`` (unique, not null) and ``parent`` (null, or an id that may or
    may not be in the table). Result columns: id, parent, kind (``tree``,
    ``cycle`` or ``below_cycle``), top (highest ancestor in the table, itself if
    its parent is no node), height (steps to the top, null with cycles), path
    (ids from the top to the node; only ``with_paths``; with cycles null, or if
    ``cycle_paths`` every ancestor once, the nearest last, then the node),
    cycle_id. A node that is its own parent is a cycle of one.
    """
    nodes = nodes.select("id", "parent")
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    hot = hot_keys(nodes, "parent")
    linked = scratch.keep(join_hot(nodes, known, "parent", hot, "left").select("id", "parent", F.col("_known").isNotNull().alias("inner"), (_is_splitter(F.col("id"), split) | F.col("_known").isNull()).alias("splitter")))
    edges = linked.filter("inner").select("id", "parent")
    seg = [F.array("parent").alias("seg")] if with_paths else []
    # A splitter's own walk starts in the reduced graph; here only others walk. The
    # parent's splitter flag needs a look-up for tops; hash splitters show by themselves.
    flags = linked.select(F.col("id").alias("parent"), F.col("splitter").alias("done"))
    first = join_hot(linked.filter("inner"), flags, "parent", hot).select("id", F.col("parent").alias("ptr"), F.lit(1).alias("dist"), "done", "splitter", *seg)
    first = scratch.keep(first)
    state = first.filter(~F.col("splitter")).drop("splitter")
    arrived, endless, n_endless = _double(state, scratch, with_paths)
    arrived = scratch.keep(arrived)

    # Reduced graph: each splitter below the tops points at the splitter that its parent leads to.
    extra = ["seg"] if with_paths else []
    tops = linked.filter(~F.col("inner")).select("id")
    inner_splitters = first.filter("splitter")
    direct = inner_splitters.filter("done").select("id", "ptr", "dist", *extra)
    via = inner_splitters.filter(~F.col("done")).select("id", F.col("ptr").alias("_via"), *[F.col("seg").alias("_seg") for _ in extra])
    lead = arrived.select(F.col("id").alias("_via"), "ptr", F.col("dist").alias("_d"), *extra)
    reduced = via.join(lead, "_via", "left").select("id", "ptr", (F.col("_d") + 1).alias("dist"), *[F.concat("seg", "_seg").alias("seg") for _ in extra])
    reduced, lost = scratch.counted(direct.unionByName(reduced), stuck=F.col("ptr").isNull())
    stuck = reduced.filter(F.col("ptr").isNull()).select("id")  # their parents never reach a splitter
    top_flag = tops.select(F.col("id").alias("ptr"), F.lit(True).alias("_top"))
    pointing = reduced.filter(F.col("ptr").isNotNull())
    rstate = scratch.keep(join_hot(pointing, top_flag, "ptr", hot_keys(pointing, "ptr"), "left").select("id", "ptr", "dist", F.col("_top").isNotNull().alias("done"), *extra))
    # A pointer at a stuck splitter can't be followed; such splitters are endless as well.
    n_stuck = lost["stuck"]
    if n_stuck:
        rstate = _without_stuck(rstate, stuck, scratch)
    solved, cyclic, n_cyclic = _double(rstate, scratch, with_paths)
    top_rows = tops.select("id", F.col("id").alias("ptr"), F.lit(0).alias("dist"), *[F.array().cast("array<string>").alias("seg") for _ in extra])
    answers = scratch.keep(solved.select("id", "ptr", "dist", *extra).unionByName(top_rows))

    ans = answers.select(F.col("id").alias("ptr"), F.col("ptr").alias("_top"), F.col("dist").alias("_d"), *[F.col("seg").alias("_s") for _ in extra])
    expanded = join_hot(arrived, ans, "ptr", hot_keys(arrived, "ptr")).select("id", F.col("_top").alias("top"), (F.col("dist") + F.col("_d")).alias("height"), *[F.concat("_s", "seg", F.array("id")).alias("path") for _ in extra])
    own = answers.select("id", F.col("ptr").alias("top"), F.col("dist").alias("height"), *[F.concat("seg", F.array("id")).alias("path") for _ in extra])
    tree = scratch.keep(own.unionByName(expanded))
    none = [F.lit(None).cast("array<string>").alias("path") for _ in extra]
    named = tree.select("id", F.lit("tree").alias("kind"), "top", "height", *[F.col("path") for _ in extra], F.lit(None).cast("string").alias("cycle_id"))
    if n_endless or n_stuck or n_cyclic:
        rest = scratch.keep(edges.join(tree.select("id"), "id", "left_anti"))
        rings = _cycles(rest, scratch)
        if with_paths and cycle_paths:
            rings = scratch.keep(rings)
            rings = rings.join(_cycle_paths(rest, rings, scratch, split), "id")
            none = [F.col("path")]
        named = named.unionByName(rings.select("id", F.when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("kind"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("int").alias("height"), *none, "cycle_id"))
    return Hierarchy(named, edges, with_paths)


def _without_stuck(state: DataFrame, stuck: DataFrame, scratch: Scratch) -> DataFrame:
    """Take out splitters that run, splitter by splitter, into one without a pointer."""
    # Give each stuck splitter a pointer at itself: it then never arrives, nor do those behind it.
    loops = stuck.select("id", F.col("id").alias("ptr"), F.lit(0).alias("dist"), F.lit(False).alias("done"), *[F.array("id").alias("seg") for _ in range("seg" in state.columns)])
    return scratch.keep(state.unionByName(loops))


def comment_nodes(comments: DataFrame) -> DataFrame:
    """One record per comment: id, parent (null at a submission), at_submission, submission, level, has_parent.

    Ids compare trimmed, lower-cased and without ``t1_``/``t3_``. Rows without an
    id are no node. A parent is a submission where any row says ``t3_`` or it
    equals the row's own submission id. Repeated rows are one record; where they
    differ, the greatest non-null value of a column holds.
    """
    c = comments.select(
        plain_id(F.col("comment_id").cast("string")).alias("id"),
        plain_id(F.col("parent_id").cast("string")).alias("p"),
        plain_id(F.col("submission_id").cast("string")).alias("s"),
        plain_key(F.col("parent_id").cast("string")).startswith("t3_").alias("t3"),
        F.col("level").cast("bigint").alias("level"),
    ).filter(F.col("id").isNotNull())
    c = c.withColumn("at_sub", F.coalesce(F.col("t3"), F.lit(False)) | F.coalesce(F.col("p") == F.col("s"), F.lit(False)))
    one = c.groupBy("id").agg(F.max("p").alias("p"), F.max(F.when(F.col("p").isNotNull(), F.col("at_sub"))).alias("at_submission"), F.max("s").alias("submission"), F.max("level").alias("level"))
    return one.select("id", F.when(~F.col("at_submission"), F.col("p")).alias("parent"), F.coalesce("at_submission", F.lit(False)).alias("at_submission"), F.when(F.col("at_submission"), F.col("p")).alias("root_submission"), "submission", "level", F.col("p").isNotNull().alias("has_parent"))


def comment_hierarchy(comments: DataFrame, split: int = SPLIT, with_paths: bool = True, every_path: bool = False) -> DataFrame:
    """Path, depth and root of every comment, with cycles named.

    Columns: comment_id, parent_id, kind, depth (1 under a submission; null where
    the chain does not end at one), root_submission, top_comment, cycle_id,
    level, and ``path`` (root submission first) if ``with_paths``. Other chains
    have a path only if ``every_path``: open ones from their top comment in the
    table; on or below a cycle every ancestor once, the nearest last, then the comment.

    Nulls: a comment without parent_id, or whose chain ends at an absent comment,
    is of kind ``open`` and has no depth. Empty input gives an empty result. Rows
    may repeat; extra columns are not read.
    """
    scratch = Scratch(comments.sparkSession, "hierarchy")
    nodes = scratch.keep(comment_nodes(comments))
    tree = resolve(nodes, scratch, split, with_paths, every_path).nodes
    hot = hot_keys(tree, "top")
    tops = nodes.filter("at_submission").select(F.col("id").alias("top"), F.col("root_submission").alias("_root"))
    out = join_hot(tree, tops, "top", hot, "left").join(nodes.select("id", "parent", "level"), "id")
    ends = F.col("_root").isNotNull()
    rooted = F.when(ends, F.concat(F.array("_root"), "path"))
    path = [(rooted.otherwise(F.col("path")) if every_path else rooted).alias("path")] if with_paths else []
    return out.select(
        F.col("id").alias("comment_id"), F.col("parent").alias("parent_id"),
        F.when(F.col("kind") != "tree", F.col("kind")).when(ends, "tree").otherwise("open").alias("kind"),
        F.when(ends, F.col("height") + 1).cast("bigint").alias("depth"),
        F.col("_root").alias("root_submission"), F.col("top").alias("top_comment"), "cycle_id", "level", *path,
    )


def descendants(hierarchy: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance: every pair on a path, submissions included as ancestors.

    On cycles the distance is the shortest, and no comment is its own descendant. The result is as large as the sum of all depths, which is what was asked for.
    """
    e = hierarchy.filter(F.col("path").isNotNull()).select(F.col("comment_id").alias("descendant_id"), F.size("path").alias("_n"), F.posexplode("path").alias("_pos", "ancestor_id"))
    return e.filter(F.col("_pos") < F.col("_n") - 1).select("ancestor_id", "descendant_id", (F.col("_n") - 1 - F.col("_pos")).cast("bigint").alias("distance"))


def below(hierarchy: DataFrame, ancestors: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance: as ``descendants``, but only of ``ancestors`` (a column ancestor_id of unique ids).

    Where the ancestors are few enough to be broadcast, ids of a path that nobody asked for are dropped in the stage that explodes it.
    """
    e = hierarchy.filter(F.col("path").isNotNull()).select(F.col("comment_id").alias("descendant_id"), F.size("path").alias("_n"), F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_pos", "ancestor_id"))
    wanted = broadcast_if_small(ancestors.select("ancestor_id"))
    return e.join(wanted, "ancestor_id", "left_semi").select("ancestor_id", "descendant_id", (F.col("_n") - 1 - F.col("_pos")).cast("bigint").alias("distance"))


def findings(hierarchy: DataFrame) -> DataFrame:
    """comment_id and finding: cycle, below_cycle or level_mismatch.

    The level is held against the expanded path (submission, then comments); a
    hierarchy made without paths is judged by its depth, which is the same number.
    """
    steps = F.size("path") - 1 if "path" in hierarchy.columns else F.col("depth")
    f = F.when(F.col("kind").isin("cycle", "below_cycle"), F.col("kind")).when((F.col("kind") == "tree") & F.col("level").isNotNull() & (F.col("level") != steps), "level_mismatch")
    return hierarchy.select("comment_id", f.alias("finding")).filter(F.col("finding").isNotNull())
