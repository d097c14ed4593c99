"""Interval labels of trees from (id, parent) tables: descendants are ranges, roll-ups are differences of running sums.

``enter`` numbers the nodes of a tree in preorder (children by id), ``leave`` is the last number below a node. A node lies under another
if its number is between the two. Labels take a few numbers a node, however deep the tree is, where paths take one for each ancestor.

Work goes where it is cheapest, and every step moves a constant number of rows a node:

* While at least half of the nodes have no children, these leave in layers: their parents count them. Bushy trees and hubs are gone after
  a few rounds. At the end a layer hangs under the numbers of its parents, each node behind its siblings, whose sizes are summed over slices.
* What remains looks for its root by pointer doubling; nodes that found it are not joined again. Trees that fit a pack are dealt by
  their root, and a task walks along packs.
* Trees larger than a pack, and what never finds a root, are ranked in the Euler tour, a list for each tree that goes down and up every edge.
  Lists are ranked by contraction: each round a quarter of the elements, no two of them neighbours, hand their counts to the element behind
  them and leave, and elements behind the head of their list are finished and become its head. When ``SMALL`` are left, one task walks
  along them; then those that left get their places back in reverse.

No hub and no large tree is in one task. Tables of fewer elements than ``SMALL`` are walked at once; the labels are the same.

An unknown parent makes a node a root. Nodes on or under a cycle are in no list that has a head: they have no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lensfold.operators.sliced import SLICE, previous_value, range_slice, running_sum
from lensfold.session import cut_lineage

#: Elements of the tour that one task walks along; a pack of trees has a quarter of that in nodes.
SMALL = 200_000
#: Roots of large trees that are sent to all tasks, at most.
MOST_KEYS = 5_000
DOWN, UP = 0, 1


def _tour(nodes: DataFrame, on: list[str]) -> DataFrame:
    """(part, id, way, before, before_way, n) of every element: what stands before it in the tour, null before a root, and how many nodes
    the step passes: its own on the way down, and those of the layers that left between it and what stands before it."""
    sliced = range_slice(nodes.withColumn("_self", F.struct("_id", "_skip")), [*on, "_p"], ["_id"])
    kids = previous_value(sliced.where("_p is not null"), [*on, "_p"], ["_id"], "_self", "_sibling")
    last = kids.groupBy(*on, F.col("_p").alias("_id")).agg(F.max("_self").alias("_last"))
    behind = lambda at, first: [
        F.coalesce(f"{at}._id", first).alias("_b"), F.when(F.col(at).isNull(), DOWN).otherwise(UP).alias("_bw"),
    ]
    passed = lambda at: F.coalesce(f"{at}._skip", F.lit(0))
    down = kids.select(*on, "_id", F.lit(DOWN).alias("_way"), *behind("_sibling", "_p"), (1 + F.col("_skip") - passed("_sibling")).alias("_n"))
    no_id = F.lit(None).cast(nodes.schema["_id"].dataType)
    roots = sliced.where("_p is null").select(*on, "_id", F.lit(DOWN).alias("_way"), no_id.alias("_b"), F.lit(DOWN).alias("_bw"), F.lit(1).cast("long").alias("_n"))
    ups = nodes.select(*on, "_id", "_own").join(last, [*on, "_id"], "left").select(
        *on, "_id", F.lit(UP).alias("_way"), *behind("_last", "_id"), (F.col("_own") - 1 - passed("_last")).alias("_n")
    )
    return down.unionByName(roots).unionByName(ups)


def _coin(on: list[str], ident: str, way: str, turn: int) -> Column:
    return F.xxhash64(*on, F.col(ident), F.col(way), F.lit(turn)) % 2 == 0


def _walked(rest: DataFrame, on: list[str]) -> DataFrame:
    """Finished elements of a table of ``SMALL`` at most: from each head along its list."""
    names = [f.name for f in rest.schema.fields]
    arrow = to_arrow_schema(rest.schema)

    def walk(table: pa.Table) -> pa.Table:
        rows = table.select(names).to_pylist()
        key = lambda r, i, w: (*(r[p] for p in on), r[i], r[w])
        behind = {key(r, "_b", "_bw"): r for r in rows if r["_b"] is not None}
        found = [r for r in rows if r["_b"] is None]
        for head in list(found):
            before, r = head, behind.get(key(head, "_id", "_way"))
            while r is not None:
                r |= {"_n": r["_n"] + before["_n"], "_d": r["_d"] + before["_d"], "_root": head["_root"]}
                found.append(r)
                before, r = r, behind.get(key(r, "_id", "_way"))
        return pa.Table.from_pylist(found, arrow)

    return rest.groupBy().applyInArrow(walk, rest.schema)


def _added(rows: DataFrame, before: DataFrame, on: list[str], how: str) -> DataFrame:
    """Rows with what stands before them: its sums are added, and it hands on its root and what stands before it."""
    over = before.select(*on, F.col("_id").alias("_b"), F.col("_way").alias("_bw"), F.lit(True).alias("_met"), F.col("_b").alias("_b2"), F.col("_bw").alias("_bw2"),
                         F.col("_n").alias("_n2"), F.col("_d").alias("_d2"), F.col("_root").alias("_root2"))
    plus = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
    swap = lambda c: F.when(F.col("_met"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
    return rows.join(over, [*on, "_b", "_bw"], how).select(*on, "_id", "_way", swap("_b"), swap("_bw"), plus("_n"), plus("_d"), F.coalesce("_root2", "_root").alias("_root"))


def _ranked(tour: DataFrame, on: list[str], small: int) -> DataFrame:
    """Sums ``_n`` (nodes passed) and ``_d`` (1 for down, -1 for up) from the head of its list up to and with each element, and its root."""
    rest = cut_lineage(tour.select(
        *on, "_id", "_way", "_b", "_bw", "_n", F.when(F.col("_way") == DOWN, 1).otherwise(-1).cast("long").alias("_d"),
        F.when(F.col("_b").isNull(), F.col("_id")).alias("_root"),
    ))
    found, gone = [], []
    while True:
        heads, others = rest.agg(F.count_if(F.col("_b").isNull()), F.count_if(F.col("_b").isNotNull())).first()
        if not heads:  # what is left runs in circles
            break
        if heads + others <= small:
            found.append(_walked(rest, on))
            break
        done = cut_lineage(rest.where("_b is null"))
        found.append(done)
        rest = cut_lineage(_added(rest.where("_b is not null"), done, on, "left"))
        # Out goes what has heads up behind one with tails up: neither neighbour goes in the same round.
        turn = len(gone)
        out = F.col("_b").isNotNull() & _coin(on, "_id", "_way", turn) & ~_coin(on, "_b", "_bw", turn)
        left = cut_lineage(rest.where(out))
        rest = cut_lineage(_added(rest.where(~out), left, on, "left"))
        gone.append(left)
    known = cut_lineage(reduce(DataFrame.unionByName, found)) if found else rest.where("false")
    for left in reversed(gone):
        known = cut_lineage(known.unionByName(_added(left, known, on, "inner")))
    return known


def _walked_trees(rows: DataFrame, on: list[str], pack: str | None = None) -> DataFrame:
    """(part, id, root, depth, enter, leave) of whole trees, walked pack by pack or at once; nulls where no root is above."""
    ident = rows.schema["_id"]
    numbers = [T.StructField(c, T.LongType()) for c in ("depth", "enter", "leave")]
    out = T.StructType([*[rows.schema[p] for p in on], ident, T.StructField("root", ident.dataType), *numbers])
    arrow = to_arrow_schema(out)

    def walk(table: pa.Table) -> pa.Table:
        n, ids = table.num_rows, table["_id"].combine_chunks()
        above = table["_p"].combine_chunks()
        both = [ids, above] if ids.type == above.type else [c.cast("int64") for c in (ids, above)]  # whole numbers of two widths
        codes = pa.concat_arrays(both).dictionary_encode().indices
        keys = codes.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
        for p in on:
            code = table[p].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            keys = np.where(keys < 0, -1, keys * (code.max(initial=0) + 1) + np.tile(code, 2))
            known = keys >= 0
            keys[known] = np.unique(keys[known], return_inverse=True)[1]
        place = np.full(keys.max(initial=0) + 2, -1)  # the last for null
        place[keys[:n]] = np.arange(n)
        up = np.where(keys[n:] < 0, -1, place[keys[n:]])
        by_id = pc.sort_indices(ids).to_numpy()
        kids = by_id[np.argsort(up[by_id], kind="stable")]  # by parent, then by id
        many = np.bincount(up + 1, minlength=n + 1)
        start = np.cumsum(many) - many
        levels = [kids[: many[0]]]
        while len(levels[-1]):
            at = levels[-1] + 1
            ends = np.cumsum(many[at])
            levels.append(kids[np.repeat(start[at] - ends + many[at], many[at]) + np.arange(ends[-1])])
        size, skip = table["_own"].to_numpy().copy(), table["_skip"].to_numpy()
        for level in reversed(levels[1:]):
            np.add.at(size, up[level], size[level])
        root, depth, enter = np.full(n, -1), np.ones(n, "int64"), np.zeros(n, "int64")
        root[levels[0]] = levels[0]
        for level in levels[1:]:
            over = up[level]
            upto = np.cumsum(size[level]) - size[level]
            family = np.cumsum(np.diff(over, prepend=over[:1]) != 0)
            first = np.searchsorted(family, family)
            root[level], depth[level] = root[over], depth[over] + 1
            enter[level] = enter[over] + 1 + skip[level] + upto - upto[first]
        lost = root < 0
        numbers = [pa.array(c, "int64", mask=lost) for c in (depth, enter, enter + size - 1)]
        columns = [*[table[p] for p in on], ids, ids.take(pa.array(root, mask=lost)), *numbers]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return (rows.groupBy(pack) if pack else rows.groupBy()).applyInArrow(walk, out)


def _before(kids: DataFrame, on: list[str]) -> DataFrame:
    """Children with ``_skip``: the sum of ``_size`` over their siblings with smaller ids."""
    sliced = range_slice(kids, [*on, "_p"], ["_id"])
    return running_sum(sliced, [*on, "_p"], ["_id"], F.col("_size"), "_upto").withColumn("_skip", F.col("_upto") - F.col("_size")).drop("_upto", SLICE)


def _shares(live: DataFrame, on: list[str]) -> tuple[int, int]:
    """Nodes, and about how many of them have children."""
    parents = F.approx_count_distinct(F.when(F.col("_p").isNotNull(), F.xxhash64(*on, "_p")))
    return tuple(live.agg(F.count(F.lit(1)), parents).first())


def _raked(up: DataFrame, on: list[str], small: int, size: int, parents: int) -> tuple[DataFrame, int, list[DataFrame]]:
    """Nodes that stay, with ``_own`` (themselves and what left below them), their number, and layers of childless nodes that left, the lowest first."""
    live, layers = up.withColumn("_own", F.lit(1).cast("long")), []
    while 2 * size > small and 2 * parents <= size:
        above = live.where("_p is not null").groupBy(*on, F.col("_p").alias("_id")).agg(F.lit(True).alias("_has"))
        flagged = cut_lineage(live.join(above, [*on, "_id"], "left"))
        layers.append(flagged.where("_has is null").drop("_has"))
        less = layers[-1].where("_p is not null").groupBy(*on, F.col("_p").alias("_id")).agg(F.sum("_own").alias("_less"))
        live = cut_lineage(flagged.where("_has").join(less, [*on, "_id"], "left").select(*on, "_id", "_p", (F.col("_own") + F.coalesce("_less", F.lit(0))).alias("_own")))
        size, parents = _shares(live, on)
    return live, size, layers


def _with_roots(up: DataFrame, on: list[str], rounds: int) -> tuple[DataFrame, DataFrame, int]:
    """Nodes with their root ``_top``, and those that don't have it after ``rounds`` doublings and their number: deep ones, and those without
    a root. Stops where eight doublings find the root of less than a tenth of the nodes."""
    open_ = up.where("_p is not null").withColumn("_top", F.col("_p"))
    found = [up.where("_p is null").withColumn("_top", F.col("_id"))]
    size, turn = None, 0
    while turn < rounds:
        at = [d.select(*on, F.col("_id").alias("_top"), F.col("_top").alias("_over"), F.lit(done).alias("_done")) for d, done in [*[(f, True) for f in found], (open_, False)]]
        next_ = open_.join(reduce(DataFrame.unionByName, at), [*on, "_top"]).select(*open_.drop("_top").columns, F.col("_over").alias("_top"), "_done")
        next_ = cut_lineage(next_)
        found.append(next_.where("_done").drop("_done"))
        open_ = next_.where("not _done").drop("_done")
        left, all_ = next_.agg(F.count_if(~F.col("_done")), F.count(F.lit(1))).first()
        size, turn = size or all_, turn + 1
        if not left or (turn >= 8 and 10 * left > 9 * size):
            break
    return reduce(DataFrame.unionByName, found), open_, left


def _core(live: DataFrame, on: list[str], small: int, size: int) -> DataFrame:
    """(part, id, root, depth, enter, leave) of ``size`` nodes with ``_own`` and ``_skip``; nulls where no root is above."""
    if 2 * size <= small:
        return cut_lineage(_walked_trees(live, on))
    pack = max(1, small // 4)
    rooted, deep, left = _with_roots(live, on, pack.bit_length())
    tree = [*on, "_top"]
    # A tree goes whole into one pack. Packs that are too full hold the trees that are too large.
    packs = rooted.withColumn("_pack", F.pmod(F.xxhash64(*tree), F.lit(-(-size // pack))))
    full = cut_lineage(packs.groupBy("_pack").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * pack).select("_pack"))
    if not left and full.isEmpty():
        return cut_lineage(_walked_trees(packs, on, "_pack"))
    large = packs.join(F.broadcast(full), "_pack", "left_semi").groupBy(*tree).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > pack).select(*tree)
    if left:
        over = rooted.select(*on, F.col("_id").alias("_top"), F.col("_top").alias("_root"))
        large = large.unionByName(deep.join(over, tree).select(*on, F.col("_root").alias("_top"))).distinct()
    large = cut_lineage(large)
    large = F.broadcast(large) if large.count() <= MOST_KEYS else large
    rest = cut_lineage(packs.join(large, tree, "left_semi").drop("_pack").unionByName(deep).drop("_top"))
    rows = packs.join(large, tree, "left_anti").drop("_top")
    if 2 * rest.count() <= small:
        return cut_lineage(_walked_trees(rows.unionByName(rest.withColumn("_pack", F.lit(-1).cast("long"))), on, "_pack"))
    found = _ranked(_tour(rest, on), on, small)
    down = F.col("_way") == DOWN
    ends = found.groupBy(*on, "_id").agg(
        F.min("_root").alias("root"), F.max(F.when(down, F.col("_d"))).alias("depth"), (F.min(F.when(down, F.col("_n"))) - 1).alias("enter"),
        (F.max("_n") - 1).alias("leave"),
    )
    ends = rest.select(*on, "_id").join(ends, [*on, "_id"], "left")
    return cut_lineage(_walked_trees(rows, on, "_pack").unionByName(ends))


def _hung(core: DataFrame, live: DataFrame, layers: list[DataFrame], on: list[str]) -> DataFrame:
    """The core's labels and those of the layers, each under the numbers of its parents."""
    sized = live.where("_p is not null").join(core.select(*on, "_id", (F.col("leave") - F.col("enter") + 1).alias("_size")), [*on, "_id"])
    sized = sized.select(*on, "_id", "_p", "_size", F.lit(None).cast("int").alias("_layer"))
    left = [d.where("_p is not null").select(*on, "_id", "_p", F.col("_own").alias("_size"), F.lit(i).alias("_layer")) for i, d in enumerate(layers)]
    kids = cut_lineage(_before(reduce(DataFrame.unionByName, left, sized), on).where("_layer is not null"))
    known = core
    for i, layer in reversed(list(enumerate(layers))):
        heads = layer.where("_p is null").select(*on, "_id", F.col("_id").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(0).cast("long").alias("enter"), (F.col("_own") - 1).alias("leave"))
        over = known.select(*on, F.col("_id").alias("_p"), "root", (F.col("depth") + 1).alias("depth"), (F.col("enter") + 1).alias("_first"))
        enter = F.col("_first") + F.col("_skip")
        below = kids.where(F.col("_layer") == i).join(over, [*on, "_p"]).select(*on, "_id", "root", "depth", enter.alias("enter"), (enter + F.col("_size") - 1).alias("leave"))
        known = known.unionByName(cut_lineage(below.unionByName(heads)))
    return known


def labels(nodes: DataFrame, key: str, parent: str, part: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """(part, key, root, depth, enter, leave, cycle): depth is 1 at a root, enter and leave count from 0 in each tree."""
    on = list(part)
    rows = cut_lineage(nodes.select(*on, F.col(key).alias("_id"), F.col(parent).alias("_p")))
    one, none = F.lit(1).cast("long").alias("_own"), F.lit(0).cast("long").alias("_skip")
    size, parents = _shares(rows, on)
    if 2 * size <= small:
        ends = cut_lineage(_walked_trees(rows.select("*", one, none), on))
    else:
        known = rows.select(*on, F.col("_id").alias("_p"), F.lit(True).alias("_has"))
        up = cut_lineage(rows.join(known, [*on, "_p"], "left").select(*on, "_id", F.when(F.col("_has"), F.col("_p")).alias("_p")))
        live, size, layers = _raked(up, on, small, size, parents)
        if layers:
            # Only what left right below a node that stays lies between its children.
            over = live.select(*on, F.col("_id").alias("_p"))
            left = reduce(DataFrame.unionByName, layers).join(over, [*on, "_p"], "left_semi").select(*on, "_id", "_p", F.col("_own").alias("_size"), F.lit(None).cast("long").alias("_own"))
            kids = live.where("_p is not null").select(*on, "_id", "_p", F.lit(0).cast("long").alias("_size"), "_own")
            kids = _before(kids.unionByName(left), on).where("_own is not null").select(*on, "_id", "_p", "_own", "_skip")
            live = cut_lineage(kids.unionByName(live.where("_p is null").select("*", none)))
            ends = _hung(_core(live, on, small, size), live, layers, on)
        else:
            ends = _core(live.select("*", none), on, small, size)
    return ends.select(*on, F.col("_id").alias(key), "root", F.col("depth").cast("int").alias("depth"), "enter", "leave", F.col("root").isNull().alias("cycle"))


def descendants(labelled: DataFrame, key: str, part: Sequence[str] = (), of: DataFrame | None = None) -> DataFrame:
    """(part, ancestor, key), each node with itself, of all nodes or of those in ``of`` (part, key). Rows are made for the answer only."""
    on = list(part)
    asked = labelled if of is None else labelled.join(of.select(*on, key), [*on, key], "left_semi")
    ranges = asked.where("not cycle").select(*on, F.col(key).alias("ancestor"), "root", F.explode(F.sequence("enter", "leave")).alias("enter"))
    return ranges.join(labelled.select(*on, key, "root", "enter"), [*on, "root", "enter"]).select(*on, "ancestor", key)


def subtree_sums(labelled: DataFrame, key: str, per_node: DataFrame, sums: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """(part, key, sums) over each node and everything below it, where that has a row in ``per_node`` (unique part, key). Sums of whole
    numbers are exact; others carry the rounding of a difference of running sums."""
    on = list(part)
    tree = [*on, "root"]
    names = [f"_s{i}" for i in range(len(sums))]
    known = labelled.where("not cycle")
    nothing = [F.lit(None).cast(per_node.schema[s].dataType).alias(n) for s, n in zip(sums, names)]
    no_key = F.lit(None).cast(labelled.schema[key].dataType).alias("_asks")
    # Values lie between the two questions of their own node: first, value, first of the next, ..., last.
    values = known.join(per_node, [*on, key]).select(*tree, (F.col("enter") * 3 + 1).alias("_at"), no_key, F.lit(0).alias("_sign"), F.lit(1).alias("_c"), *[F.col(s).alias(n) for s, n in zip(sums, names)])
    asks = [
        known.select(*tree, at.alias("_at"), F.col(key).alias("_asks"), F.lit(sign).alias("_sign"), F.lit(0).alias("_c"), *nothing)
        for sign, at in ((-1, F.col("enter") * 3), (1, F.col("leave") * 3 + 2))
    ]
    sliced = range_slice(values.unionAll(asks[0]).unionAll(asks[1]), tree, ["_at"])
    inner = Window.partitionBy(*tree, SLICE).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*tree).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    cols = ["_c", *names]
    carried = sliced.groupBy(*tree, SLICE).agg(*[F.sum(c).alias(c) for c in cols])
    carried = carried.select(*tree, SLICE, *[F.sum(c).over(across).alias(f"{c}_before") for c in cols])
    upto = sliced.select(*tree, SLICE, "_asks", "_sign", *[F.sum(c).over(inner).alias(c) for c in cols]).where("_sign <> 0").join(carried, [*tree, SLICE])
    total = lambda c: F.sum(F.col("_sign") * (F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_before", F.lit(0))))
    out = upto.groupBy(*on, F.col("_asks").alias(key)).agg(*[total(c).alias(c) for c in cols])
    return out.where("_c > 0").select(*on, key, *[F.col(n).alias(s) for s, n in zip(sums, names)])


def moves_below(moves: DataFrame, labelled: DataFrame, key: str, target: str, part: Sequence[str] = (), max_depth: int | None = None, whole_subtree: bool = False) -> DataFrame:
    """Moves that would put a node under itself or under its own descendant, or too deep: see ``tree.rejected_moves``."""
    on = list(part)
    to = labelled.select(*on, F.col(key).alias(target), F.col("root").alias("_to_root"), F.col("enter").alias("_to"), F.col("depth").alias("_to_depth"))
    own = labelled.select(*on, key, F.col("root").alias("_root"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave"), F.col("depth").alias("_depth"))
    joined = moves.join(to, [*on, target]).join(own, [*on, key])
    inside = (F.col("_root") == F.col("_to_root")) & F.col("_to").between(F.col("_enter"), F.col("_leave"))
    bad = (F.col(key) == F.col(target)) | F.coalesce(inside, F.lit(False))
    if max_depth is not None:
        below = F.lit(1)
        if whole_subtree:
            deep = descendants(labelled, key, on, moves.select(*on, key).distinct()).join(labelled.select(*on, key, "depth"), [*on, key])
            joined = joined.join(deep.groupBy(*on, F.col("ancestor").alias(key)).agg(F.max("depth").alias("_deepest")), [*on, key], "left")
            below = F.coalesce(F.col("_deepest") - F.col("_depth") + 1, F.lit(1))
        bad = bad | F.coalesce(F.col("_to_depth") + below > max_depth, F.lit(False))
    return joined.where(bad).select(*moves.columns)
