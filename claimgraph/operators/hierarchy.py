"""Forests of parent–child links: root, depth, tour intervals, paths, descendants and cycles.

Leaves (and tops) are peeled in doubled strides, which leaves exactly the nodes
on cycles; each cycle is opened at its smallest id. The forest is then laid out
as Euler tours, whose positions come from parallel list ranking by pointer
doubling. No step walks a tree: the number of rounds is the logarithm of the
longest chain or tour, and every round is one equi-join.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.sources.shared import stage

#: Children of one parent are chained within this many hash buckets, so that a parent of very many children is no single task's work.
SIBLING_BUCKETS = 64


def _on(left: str, right: str, space: Sequence[str], *pairs: tuple[str, str]) -> Column:
    test = F.lit(True)
    for c in space:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    for a, b in pairs:
        test = test & (F.col(f"{left}.{a}") == F.col(f"{right}.{b}"))
    return test


def cycle_nodes(edges: DataFrame, space: Sequence[str]) -> DataFrame | None:
    """The nodes of `edges` (space..., id, parent) that lie on cycles, with `head`, the smallest id of their cycle; None if there are none.

    Round k holds f^(2^k) on the nodes that still have 2^k nodes below and above
    them: a stride peels 2^k layers of leaves at once. When a stride peels nothing,
    it permutes what is left, so all of it lies on cycles.
    """
    now = stage(edges.select(*space, "id", "parent"))
    while now.rows:
        below = now.df.select(*space, F.col("parent").alias("id")).distinct()
        kept = now.df.alias("x").join(below.alias("b"), _on("x", "b", space, ("id", "id")), "left_semi")
        step = kept.alias("x").join(now.df.alias("y"), _on("x", "y", space, ("parent", "id")))
        following = stage(step.select(*(f"x.{c}" for c in space), "x.id", "y.parent"))
        now.drop()
        peeled, now = now.rows - following.rows, following
        if not peeled:
            break
    if not now.rows:
        now.drop()
        return None
    members = now.df.select(*space, "id")
    on_ring = edges.alias("e").join(members.alias("m"), _on("e", "m", space, ("id", "id")), "left_semi")
    ring = stage(on_ring.select(*space, "id", F.col("parent").alias("next"), F.col("id").alias("head"), F.lit(True).alias("moved")), "moved")
    now.drop()
    while ring.held:
        step = ring.df.alias("x").join(ring.df.alias("y"), _on("x", "y", space, ("next", "id")))
        least = F.least("x.head", "y.head")
        following = stage(step.select(*(f"x.{c}" for c in space), "x.id", F.col("y.next").alias("next"), least.alias("head"), (least < F.col("x.head")).alias("moved")), "moved")
        ring.drop()
        ring = following
    return ring.df.select(*space, "id", "head")


def _tour(edges: DataFrame, space: Sequence[str]) -> DataFrame:
    """The arcs of the Euler tours: (space..., id, up, nid, nup, n, d, root, first).

    Each edge gives an arc down into `id` and an arc up out of it. `nid`, `nup` name
    the next arc, or are null at a tour's end, where `root` is set. `n` counts arcs
    and `d` sums +1 for down and -1 for up, from the arc to before the next. `first`
    marks the arc that starts a tour.
    """
    bucket = F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS)).cast("int")
    chain = Window.partitionBy(*space, "parent", "bucket").orderBy("id")
    linked = edges.select(*space, "id", "parent", bucket.alias("bucket")).withColumns({"sibling": F.lead("id").over(chain), "place": F.row_number().over(chain)})
    firsts = linked.where("place = 1").select(*space, "parent", "bucket", "id")
    across = Window.partitionBy(*space, "parent").orderBy("bucket")
    # Whether a parent has one itself is found for its buckets, which are few, not for its children.
    inner = edges.select(*space, "id").withColumn("inner", F.lit(True))
    known = firsts.alias("f").join(inner.alias("p"), _on("f", "p", space, ("parent", "id")), "left").select("f.*", F.coalesce("p.inner", F.lit(False)).alias("inner"))
    heads = known.withColumns({"after": F.lead("id").over(across), "b": F.row_number().over(across)})
    joined = linked.alias("l").join(heads.alias("h"), _on("l", "h", space, ("parent", "parent"), ("bucket", "bucket")))
    sibling = F.coalesce("l.sibling", "h.after")
    eldest = (F.col("l.place") == 1) & (F.col("h.b") == 1)
    nodes = joined.select(*(f"l.{c}" for c in space), "l.id", "l.parent", sibling.alias("sibling"), eldest.alias("eldest"), "h.inner")
    children = heads.where("b = 1").select(*space, F.col("parent").alias("id"), F.col("id").alias("child"))
    full = nodes.alias("x").join(children.alias("c"), _on("x", "c", space, ("id", "id")), "left").select("x.*", "c.child")
    one, down, up = F.lit(1).cast("long"), F.lit(False), F.lit(True)
    null = F.lit(None).cast("long")
    into = F.struct(down.alias("up"), F.coalesce("child", "id").alias("nid"), F.col("child").isNull().alias("nup"), one.alias("n"), one.alias("d"), null.alias("root"), (F.col("eldest") & ~F.col("inner")).alias("first"))
    out = F.struct(
        up.alias("up"),
        F.coalesce("sibling", F.when(F.col("inner"), F.col("parent"))).alias("nid"),
        F.when(F.col("sibling").isNotNull(), down).when(F.col("inner"), up).alias("nup"),
        one.alias("n"),
        (-one).alias("d"),
        F.when(F.col("sibling").isNull() & ~F.col("inner"), F.col("parent")).alias("root"),
        F.lit(False).alias("first"),
    )
    return full.select(*space, "id", F.inline(F.array(into, out)))


def _rank(arcs: DataFrame, space: Sequence[str]) -> DataFrame:
    """List ranking by pointer doubling: every arc, with `n`, `d` and `root` of its way to the tour's end.

    A round joins the arcs that are not yet at the end to what is known of their
    next arc. Finished arcs stay where they were written. When most are finished,
    the trees that have no active arc (those whose first arc is finished) are set
    aside and no longer joined.
    """
    active, ended = "nid IS NOT NULL", "nid IS NULL"
    todo = stage(arcs, active)
    done, live, n_live = [], [], 0
    union = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    while todo.held:
        live.append(todo.df.where(ended))
        n_live += todo.rows - todo.held
        if n_live > 8 * todo.held:
            finished = union(live)
            whole = finished.where("first").select(*space, "root", F.lit(True).alias("whole"))
            flagged = finished.alias("e").join(whole.alias("w"), _on("e", "w", space, ("root", "root")), "left").select("e.*", F.coalesce("w.whole", F.lit(False)).alias("whole"))
            split = stage(flagged, "NOT whole")
            done.append(split.df.where("whole").drop("whole"))
            live, n_live = [split.df.where("NOT whole").drop("whole")], split.held
        targets = union([todo.df.where(active), *live])
        step = todo.df.where(active).alias("a").join(targets.alias("t"), _on("a", "t", space, ("nid", "id"), ("nup", "up")))
        n, d = (F.col(f"a.{c}") + F.col(f"t.{c}") for c in ("n", "d"))
        todo = stage(step.select(*(f"a.{c}" for c in (*space, "id", "up")), "t.nid", "t.nup", n.alias("n"), d.alias("d"), "t.root", "a.first"), active)
    return union([*done, *live, todo.df])


def forest(edges: DataFrame, space: Sequence[str] = ()) -> DataFrame:
    """Every linked node of `edges` (space..., id, parent) laid out in its tree.

    Returns space..., id, root, depth, enter, leave, cyclic. `enter` < `leave`
    are positions in the tour of the root, so that x is below y exactly if they
    have the same root and enter[y] < enter[x] and leave[x] < leave[y]. Rows with
    a null id or parent are no links; of several parents of one id the smallest
    counts. A tree that hangs on a cycle has that cycle's smallest id as its root
    and `cyclic` true; `depth` then counts the links to that id. Roots themselves
    have a row only if they lie on a cycle. An empty input gives an empty result.
    """
    space = list(space)
    links = edges.where("id IS NOT NULL AND parent IS NOT NULL").groupBy(*space, "id").agg(F.min("parent").alias("parent"))
    base = stage(links)
    rings = cycle_nodes(base.df, space)
    opened = base.df
    if rings is not None:
        heads = rings.where("id = head").select(*space, "id")
        opened = stage(base.df.alias("x").join(heads.alias("h"), _on("x", "h", space, ("id", "id")), "left_anti")).df
    ranked = _rank(_tour(opened, space), space)
    pairs = ranked.groupBy(*space, "id").agg(
        F.min("root").alias("root"),
        F.min(F.when(~F.col("up"), 1 - F.col("d"))).alias("depth"),
        F.min(F.when(~F.col("up"), -F.col("n"))).alias("enter"),
        F.min(F.when(F.col("up"), -F.col("n"))).alias("leave"),
    )
    if rings is None:
        return pairs.withColumn("cyclic", F.lit(False))
    known = rings.where("id = head").select(*space, F.col("head").alias("root"), F.lit(True).alias("cyclic"))
    result = pairs.alias("p").join(known.alias("k"), _on("p", "k", space, ("root", "root")), "left").select("p.*", F.coalesce("k.cyclic", F.lit(False)).alias("cyclic"))
    longest = ranked.groupBy(*space, "root").agg(F.max("n").alias("n")).alias("t")
    tops = rings.where("id = head").alias("k").join(longest, _on("k", "t", space, ("head", "root")), "left")
    zero = F.lit(0).cast("long")
    tops = tops.select(*(f"k.{c}" for c in space), "k.id", F.col("k.id").alias("root"), zero.alias("depth"), (-F.coalesce("t.n", zero) - 1).alias("enter"), zero.alias("leave"), F.lit(True).alias("cyclic"))
    return result.unionByName(tops)


def descendants(nodes: DataFrame, space: Sequence[str] = ()) -> DataFrame:
    """All pairs (space..., ancestor, descendant, links) of `forest` rows, roots included as ancestors.

    A node's interval is cut into dyadic blocks, and a node's position lies in one
    block of each size: equal blocks of one tree are the pairs, each found once.
    It is an equi-join whose input is a logarithm of the tree's size times the
    nodes; only the pairs asked for come out.
    """
    space = list(space)
    laid = nodes.select(*space, "id", "root", "depth", "enter", "leave")
    spans = laid.where("leave - enter > 1").select(*space, "root", F.col("id").alias("ancestor"), F.col("depth").alias("top"), F.col("enter").alias("lo"), F.col("leave").alias("hi"))
    # Position from the tour's start cannot be negative; the end of a tour is -1, and 62 levels hold any tour.
    longest = laid.groupBy(*space, "root").agg((-F.min("enter")).alias("size"))
    at = laid.alias("l").join(longest.alias("s"), _on("l", "s", space, ("root", "root")))
    points = at.select(*(f"l.{c}" for c in space), "l.root", F.col("l.id").alias("descendant"), "l.depth", (-F.col("l.enter")).alias("p"), F.ceil(F.log2(F.col("s.size") + 2)).cast("int").alias("top_level"))
    points = points.select(*space, "root", "descendant", "depth", "p", F.explode(F.sequence(F.lit(0), "top_level")).alias("level"))
    points = points.withColumn("block", F.expr("shiftright(p, level)"))
    # The interval (-hi, -lo) as positions, ends excluded; a block of a level is used where neither it nor its sibling's parent fits.
    ranges = spans.select(*space, "root", "ancestor", "top", (-F.col("hi") + 1).alias("a"), (-F.col("lo")).alias("b"))
    ranges = ranges.withColumn("levels", F.expr("sequence(0, cast(ceil(log2(b - a + 2)) as int))"))
    cut = F.expr(
        """flatten(transform(levels, l -> filter(array(
            named_struct('level', l, 'block', shiftright(a + shiftleft(1L, l) - 1, l), 'left', true),
            named_struct('level', l, 'block', shiftright(b, l) - 1, 'left', false)),
            x -> case when x.left then x.block % 2 = 1 and shiftleft(x.block + 1, l) <= b and shiftleft(x.block, l) >= a
                 else x.block % 2 = 0 and shiftleft(x.block + 1, l) <= b and shiftleft(x.block, l) >= a end)))"""
    )
    blocks = ranges.select(*space, "root", "ancestor", "top", F.explode(cut).alias("c")).select(*space, "root", "ancestor", "top", "c.level", "c.block")
    same = blocks.alias("r").join(points.alias("p"), _on("r", "p", space, ("root", "root"), ("level", "level"), ("block", "block")))
    inside = same.select(*(f"p.{c}" for c in space), "r.ancestor", "p.descendant", (F.col("p.depth") - F.col("r.top")).alias("links"))
    roots = laid.where("id <> root").select(*space, F.col("root").alias("ancestor"), F.col("id").alias("descendant"), F.col("depth").alias("links"))
    looped = nodes.where("cyclic AND id = root").select(*space, F.col("id").alias("ancestor")).alias("c")
    plain = roots.alias("r").join(looped, _on("r", "c", space, ("ancestor", "ancestor")), "left_anti")
    return inside.unionByName(plain)


def paths(nodes: DataFrame, space: Sequence[str] = ()) -> DataFrame:
    """space..., id, root, depth, cyclic and `path`, the ids from the node to its root, both included."""
    space = list(space)
    above = descendants(nodes, space).groupBy(*space, F.col("descendant").alias("id")).agg(F.sort_array(F.collect_list(F.struct("links", "ancestor"))).alias("up"))
    joined = nodes.alias("n").join(above.alias("a"), _on("n", "a", space, ("id", "id")), "left")
    path = F.concat(F.array("n.id"), F.coalesce(F.transform("a.up", lambda x: x.ancestor), F.array().cast("array<bigint>")))
    return joined.select(*(f"n.{c}" for c in space), "n.id", "n.root", "n.depth", "n.cyclic", path.alias("path"))
