"""Folder trees from (id, parent) tables, by pointer doubling: log2(depth) joins instead of one per level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.session import cut_lineage

#: Doublings before the first look at what is left: enough for 16 levels.
LAZY_ROUNDS = 4


def tree(nodes: DataFrame, key: str, parent: str, part: Sequence[str] = (), max_depth: int | None = 10) -> DataFrame:
    """Root, depth (root = 1), path from the root, and whether the node sits on or under a cycle.

    An unknown parent makes a node a root. Paths are whole however deep the tree is: doubling goes on until no node is
    open. ``max_depth`` only clips the reported ``depth`` (None: not at all); nodes on or under a cycle have no root and a partial path.
    """
    on = [*part]
    known = nodes.select(*on, F.col(key).alias("_k"))
    up = (
        nodes.select(*on, F.col(key).alias("_id"), F.col(parent).alias("_p"))
        .join(known.withColumnRenamed("_k", "_p").withColumn("_has", F.lit(True)), [*on, "_p"], "left")
        .select(*on, "_id", F.when(F.col("_has"), F.col("_p")).alias("_up"))
    )
    # _top: highest ancestor reached, _path: from just under _top down to the node itself
    state = up.select(*on, "_id", F.coalesce("_up", "_id").alias("_top"), F.array("_id").alias("_path"),
                      F.col("_up").isNull().alias("_done"), F.lit(False).alias("_loop"))
    for _ in range(LAZY_ROUNDS):
        state = _doubled(state, on)
    state = cut_lineage(state)
    while not state.where("not _done").isEmpty():
        state = cut_lineage(_doubled(state, on))
    depth = F.size("_path")
    return state.select(
        *on,
        F.col("_id").alias(key),
        F.when(~F.col("_loop"), F.col("_top")).alias("root"),
        (depth if max_depth is None else F.least(depth, F.lit(max_depth))).alias("depth"),
        F.col("_path").alias("path"),
        F.col("_loop").alias("cycle"),
    )


def _doubled(state: DataFrame, on: list[str]) -> DataFrame:
    """Every open node takes over what the node at its top has reached. A path that meets a node twice is on a cycle."""
    jump = state.select(*on, F.col("_id").alias("_top"), F.col("_top").alias("_t2"), F.col("_path").alias("_p2"),
                        F.col("_done").alias("_d2"), F.col("_loop").alias("_l2"))
    joined = state.join(jump, [*on, "_top"], "left").withColumn(
        "_long", F.when(F.col("_done"), F.col("_path")).otherwise(F.concat("_p2", "_path"))
    )
    loop = F.when(F.col("_done"), F.col("_loop")).otherwise(F.col("_l2") | (F.size(F.array_distinct("_long")) < F.size("_long")))
    return joined.select(
        *on, "_id",
        F.when(F.col("_done"), F.col("_top")).otherwise(F.col("_t2")).alias("_top"),
        F.col("_long").alias("_path"),
        (F.col("_done") | F.col("_d2") | loop).alias("_done"),
        loop.alias("_loop"),
    )


def closure(paths: DataFrame, key: str, part: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(ancestor, node) pairs including the node itself; as many rows per node as it is deep."""
    return paths.where(~F.col("cycle")).select(*part, F.explode("path").alias("ancestor"), key, *keep)


def subtree_rollup(paths: DataFrame, key: str, per_node: DataFrame, sums: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Sums over a node and everything below it. ``per_node`` is already one row per node."""
    return (
        closure(paths, key, part)
        .join(per_node, [*part, key])
        .groupBy(*part, F.col("ancestor").alias(key))
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def rejected_moves(
    moves: DataFrame, paths: DataFrame, key: str, target: str, part: Sequence[str] = (), max_depth: int | None = None,
    whole_subtree: bool = False,
) -> DataFrame:
    """Moves that would put a node under itself or under its own descendant, or too deep.

    With ``max_depth`` a move is also rejected when the node itself would lie deeper. That is the reference's rule: it
    looks at the new parent's depth only, so what hangs below the node may end up deeper. ``whole_subtree`` counts the
    height of the moved subtree as well.
    """
    to = paths.select(*part, F.col(key).alias(target), F.col("path").alias("_target_path"), F.col("cycle").alias("_target_cycle"))
    joined = moves.join(to, [*part, target])
    bad = F.array_contains("_target_path", F.col(key))
    if max_depth is not None:
        below = F.lit(1)
        if whole_subtree:
            deepest = closure(paths.withColumn("_depth", F.size("path")), key, part, ["_depth"]).groupBy(*part, F.col("ancestor").alias(key)).agg(F.max("_depth").alias("_deepest"))
            own = paths.select(*part, key, F.size("path").alias("_own")).join(deepest, [*part, key])
            joined = joined.join(own.select(*part, key, (F.col("_deepest") - F.col("_own") + 1).alias("_height")), [*part, key], "left")
            below = F.coalesce("_height", F.lit(1))
        bad = bad | (F.size("_target_path") + below > max_depth)
    return joined.where(bad).select(*moves.columns)


def rejected_creates(new: DataFrame, paths: DataFrame, key: str, parent: str, part: Sequence[str] = (), max_depth: int = 10) -> DataFrame:
    """New nodes whose parent is already as deep as a tree may be; nodes without a parent are always allowed."""
    to = paths.where(F.size("path") >= max_depth).select(*part, F.col(key).alias(parent))
    return new.join(to, [*part, parent], "left_semi").select(*new.columns)
