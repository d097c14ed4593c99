"""Which rows can lie within a cosine of each other, by the triangle inequality on angles.

A key with many rows gets pivots: sampled rows, moved once to the mean of the rows nearest to them. A row within ``REACH`` of
its nearest pivot is at home in that pivot's cell, in its inner or its outer ring; others are far. Let a ring reach out to its farthest row,
at angle R. A row can be near one of the ring only if its angle to the pivot is at most R plus the angle asked for, so it visits no
other rings. Two rows at home in different cells are compared in the cell of the smaller number only. Far rows visit rings like others
and are compared among themselves in blocks.

So every pair within reach is in exactly one of three tables of groups: rows at home in one cell, rows at home and visitors of one
ring, far rows. Groups of any size are cut into blocks as everywhere (``similarity``). Tight groups cost their own size and a few
visitors; where nothing is near anything, all rows are far and the work is that of the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensfold.operators import similarity as S
from lensfold.operators.centroids import weighted_unit_mean
from lensfold.operators.listing import best_per_group
from lensfold.session import cut_lineage

#: Keys with fewer rows are one block anyway.
PIVOTS_FROM = 2 * S.BLOCK
#: Angle from the pivot within which a row is at home, as a part of the angle asked for.
REACH = 0.5
#: Room for the last bits of angles.
SLACK = 1e-5
CELL, RING = "_cell", "_outer"


@dataclass(frozen=True)
class Pieces:
    """Groups of rows that hold every pair within reach once. ``small`` keys aren't cut."""

    small: DataFrame  # part, ident, vec
    home: DataFrame  # part, _cell, _outer, ident, vec
    visitors: DataFrame  # part, _cell, _outer, ident, vec: to be compared with what is at home in the ring
    far: DataFrame  # part, ident, vec


def _nearest(rows: DataFrame, pivots: DataFrame, ident: str, vec: str, on: list[str], floor: float, block: int) -> DataFrame:
    """(part, src, dst, score) of rows and pivots that are close enough to matter."""
    return S.similarity_join(rows.select(*on, ident, vec), pivots.select(*on, F.col("_pivot").alias(ident), F.col("_at").alias(vec)), ident, vec, on, floor, block)


def _pivots(rows: DataFrame, ident: str, vec: str, on: list[str], dim: int, floor: float, block: int) -> DataFrame:
    """(part, _pivot, _at): about twice the square root of a key's rows, each the mean of what lies around a sampled row among ten
    times as many rows."""
    share = rows.groupBy(*on).agg((2.0 / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("_share"))
    drawn = rows.join(share, on).withColumn("_u", F.shiftrightunsigned(F.xxhash64(ident), 11) / float(1 << 53))
    drawn = cut_lineage(drawn.where(F.col("_u") < 10 * F.col("_share")).select(*on, ident, vec, (F.col("_u") < F.col("_share")).alias("_chosen")))
    chosen = drawn.where("_chosen").select(*on, F.col(ident).alias("_pivot"), F.col(vec).alias("_at"))
    own = best_per_group(_nearest(drawn, chosen, ident, vec, on, floor, block), [*on, "src"], [-F.col("score"), F.col("dst")], ["dst"])
    moved = own.join(drawn.select(*on, F.col(ident).alias("src"), F.col(vec).alias("_v")), [*on, "src"])
    return cut_lineage(weighted_unit_mean(moved, [*on, "dst"], "_v", dim=dim).select(*on, F.col("dst").alias("_pivot"), F.col("centroid").alias("_at")))


def pieces(df: DataFrame, ident: str, vec: str, part: Sequence[str], min_cosine: float, dim: int, pivots_from: int = PIVOTS_FROM, block: int = S.BLOCK) -> Pieces:
    """Cut the rows of each key for pairs with cosine >= ``min_cosine``. Zero vectors are far; ``dim`` is their length."""
    on = list(part)
    if min_cosine <= 0:
        raise ValueError("angles tell nothing apart from 90 degrees on")
    angle = math.acos(min(1.0, min_cosine))
    home_floor = math.cos(REACH * angle)
    sizes = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= pivots_from).select(*on)
    small = df.select(*on, ident, vec).join(sizes, on, "left_anti")
    rows = cut_lineage(df.select(*on, ident, vec).join(sizes, on, "left_semi"))
    pivots = _pivots(rows, ident, vec, on, dim, home_floor, block)

    met = cut_lineage(_nearest(rows, pivots, ident, vec, on, math.cos(min(math.pi, (1 + REACH) * angle)) - SLACK, block))
    own = best_per_group(met, [*on, "src"], [-F.col("score"), F.col("dst")], ["dst", "score"]).where(F.col("score") >= home_floor)
    own = own.select(*on, F.col("src").alias(ident), F.col("dst").alias(CELL), F.acos(F.least(F.col("score"), F.lit(1.0))).alias("_angle"))
    middle = own.groupBy(*on, CELL).agg(F.avg("_angle").alias("_middle"))
    own = cut_lineage(own.join(middle, [*on, CELL]).select(*on, ident, CELL, (F.col("_angle") > F.col("_middle")).alias(RING), "_angle"))
    rings = own.groupBy(*on, F.col(CELL).alias("dst"), RING).agg((F.cos(F.least(F.lit(math.pi), F.max("_angle") + angle)) - SLACK).alias("_floor"))
    reached = met.join(rings, [*on, "dst"]).where(F.col("score") >= F.col("_floor")).select(*on, F.col("src").alias(ident), F.col("dst").alias(CELL), RING)
    at_home = own.select(*on, ident, F.col(CELL).alias("_own"))
    visits = reached.join(at_home, [*on, ident], "left").where(F.col("_own").isNull() | (F.col(CELL) < F.col("_own"))).drop("_own")
    return Pieces(
        small,
        cut_lineage(rows.join(own.drop("_angle"), [*on, ident]).select(*on, CELL, RING, ident, vec)),
        cut_lineage(rows.join(visits, [*on, ident]).select(*on, CELL, RING, ident, vec)),
        cut_lineage(rows.join(own.select(*on, ident), [*on, ident], "left_anti")),
    )


def large_keys(df: DataFrame, part: Sequence[str], pivots_from: int = PIVOTS_FROM) -> bool:
    """Whether a key has enough rows to be cut."""
    return not df.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pivots_from).isEmpty()


def compared(p: Pieces, part: Sequence[str]) -> DataFrame:
    """(part, compared): pairs that are looked at in the cut keys."""
    on, n = list(part), F.count(F.lit(1))
    half = lambda df, keys: df.groupBy(*keys).agg(n.alias("n")).select(*on, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("c"))
    ring = [*on, CELL, RING]
    beside = p.home.groupBy(*ring).agg(n.alias("h")).join(p.visitors.groupBy(*ring).agg(n.alias("v")), ring).select(*on, (F.col("h") * F.col("v")).alias("c"))
    return half(p.home, [*on, CELL]).unionAll(beside).unionAll(half(p.far, on)).groupBy(*on).agg(F.sum("c").alias("compared"))


def spanning_edges(p: Pieces, ident: str, vec: str, part: Sequence[str], min_cosine: float, block: int = S.BLOCK) -> DataFrame:
    """(part, src, dst) that connect exactly what ``cosine >= min_cosine`` connects; at most one edge a row and pair of blocks."""
    on = list(part)

    def emit(a: S._Side, b: S._Side, within: bool):
        label = S._bipartite_components(S._scores(a, b)[0] >= min_cosine)
        ids = pa.concat_arrays([a.ids, b.ids])
        node = np.flatnonzero(label != np.arange(len(label)))
        return {"src": ids.take(pa.array(label[node])), "dst": ids.take(pa.array(node))}

    ring = [*on, CELL, RING]
    sides = [S._sides(x, ident, [vec], ring) for x in (p.home, p.visitors)]
    beside = S._run(S._cross_blocks(*sides, ring, block), ring, 1, emit, S._schema(p.home, ring, ident))
    inside = S.spanning_edges(p.home, ident, vec, [*on, CELL], min_cosine, block)
    others = [S.spanning_edges(x, ident, vec, on, min_cosine, block) for x in (p.small, p.far)]
    return reduce(DataFrame.unionByName, [inside.drop(CELL), beside.drop(CELL, RING), *others])


def neighbour_counts(p: Pieces, ident: str, vec: str, part: Sequence[str], min_cosine: float, block: int = S.BLOCK) -> DataFrame:
    """(part, src, neighbours) with the row itself counted."""
    on = list(part)
    ring = [*on, CELL, RING]

    def emit(a: S._Side, b: S._Side, within: bool):
        hit = S._scores(a, b)[0] >= min_cosine
        sums = np.concatenate([hit.sum(axis=1), hit.sum(axis=0)]).astype(np.int64)
        return {"src": pa.concat_arrays([a.ids, b.ids]), "neighbours": pa.array(sums)}

    out = T.StructType([*[p.home.schema[c] for c in ring], T.StructField("src", p.home.schema[ident].dataType), T.StructField("neighbours", T.LongType())])
    sides = [S._sides(x, ident, [vec], ring) for x in (p.home, p.visitors)]
    beside = S._run(S._cross_blocks(*sides, ring, block), ring, 1, emit, out)
    inside = S.neighbour_counts(p.home, ident, vec, [*on, CELL], min_cosine, block)
    others = [S.neighbour_counts(x, ident, vec, on, min_cosine, block) for x in (p.small, p.far)]
    counts = reduce(DataFrame.unionByName, [inside.drop(CELL), beside.drop(CELL, RING), *others])
    return counts.groupBy(*on, "src").agg(F.sum("neighbours").alias("neighbours"))
