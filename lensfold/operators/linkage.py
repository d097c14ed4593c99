"""Average-linkage agglomeration without a distance matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensfold.functions import vectors as V
from lensfold.operators import similarity as S
from lensfold.session import cut_lineage


def _merge_in_block(mean: np.ndarray, size: np.ndarray, limit: float) -> np.ndarray:
    """Average linkage of one block of groups (mean vector, count): smallest row number of the final group of each row.

    The same rounds as ``_by_rounds``, with the same sums and the same order among equal similarities (smaller row
    first), so how many rows share a block never changes the outcome. Only rows that changed are compared anew.
    """
    n = len(mean)
    sim = np.round(mean @ mean.T, S.SCORE_DIGITS)
    np.fill_diagonal(sim, -np.inf)
    group, alive = np.arange(n), np.ones(n, bool)
    while n > 1:
        best = sim.argmax(axis=1)
        open_ = alive & (sim[np.arange(n), best] > limit)
        first = np.flatnonzero(open_ & open_[best] & (best[best] == np.arange(n)) & (np.arange(n) < best))
        if not len(first):
            return group
        second = best[first]
        total = size[first] + size[second]
        mean[first] = (mean[first] * size[first, None] + mean[second] * size[second, None]) / total[:, None]
        size[first] = total
        to = np.arange(n)
        to[second] = first
        group = to[group]
        alive = open_.copy()
        alive[second] = False
        sim[first] = np.round(mean[first] @ mean.T, S.SCORE_DIGITS)
        sim[:, first] = sim[first].T
        sim[~alive], sim[:, ~alive] = -np.inf, -np.inf
        sim[first, first] = -np.inf
    return group


def _in_blocks(points: DataFrame, part: list[str], limit: float) -> DataFrame:
    """Finish keys that fit into one block: (part, point, group)."""
    kind = points.schema["_g"].dataType
    fields = [points.schema[p] for p in part]

    def finish(table):
        table = table.take(pc.sort_indices(table.column("_g")))
        mean = np.array(table.column("_mean").combine_chunks().flatten()).reshape(table.num_rows, -1)
        size = np.array(table.column("_n"), dtype=np.float64)
        group = table.column("_g").combine_chunks().take(pa.array(_merge_in_block(mean, size, limit)))
        return table.select([*part, "_g"]).append_column("_to", group)

    out = T.StructType([*fields, T.StructField("_g", kind), T.StructField("_to", kind)])
    return points.groupBy(*part).applyInArrow(finish, out)


def average_linkage(
    points: DataFrame, ident: str, vec: str, part: Sequence[str], threshold: float, block: int = S.BLOCK
) -> DataFrame:
    """(part, id, group): average cosine linkage, cut where the distance reaches ``threshold`` (strict).

    Every round merges all groups that are each other's most similar one; among equal ones the smaller id counts. A key
    with at most ``block`` points takes its rounds in one task, a larger one by joins, with the same result.
    """
    on = list(part)
    units = cut_lineage(points.select(*on, F.col(ident).alias("_g"), V.unit(vec).alias("_mean"), F.lit(1).cast("bigint").alias("_n")))
    large = _oversized(units, on, block)
    if large.isEmpty():
        done = _in_blocks(units, on, 1.0 - threshold)
    else:
        large = cut_lineage(large)
        small = units.join(large, on, "left_anti")
        done = _in_blocks(small, on, 1.0 - threshold).unionByName(
            _by_rounds(units.join(large, on, "left_semi"), on, threshold, block)
        )
    return done.select(*on, F.col("_g").alias(ident), F.col("_to").alias("group"))


def _oversized(groups: DataFrame, on: list[str], block: int) -> DataFrame:
    return groups.groupBy(*on).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > block).select(*on)


def _by_rounds(points: DataFrame, on: list[str], threshold: float, block: int) -> DataFrame:
    """(part, point, group) by merging all mutual nearest neighbours per round.

    The average distance of two groups of unit vectors is ``1 - mean_a . mean_b``, so a group is its mean and
    its count. Average linkage is reducible: merging all pairs that are each other's nearest gives the same cut
    as merging one pair at a time. A group without any neighbour in reach can never get one later and is
    retired, so rounds run on a shrinking table; what is left is finished in blocks once every key fits.
    """
    active = points
    merged: list[DataFrame] = []
    while True:
        nearest = cut_lineage(S.nearest_other(active, "_g", "_mean", on, 1.0 - threshold, block))
        back = nearest.select(*on, F.col("src").alias("dst"), F.col("dst").alias("src"))
        pairs = nearest.where("src < dst").join(back, [*on, "src", "dst"], "left_semi").select(*on, "src", "dst")
        if pairs.isEmpty():
            break
        merged.append(pairs)
        alive = active.join(nearest.select(*on, F.col("src").alias("_g")), [*on, "_g"], "left_semi")
        partner = active.select(*on, F.col("_g").alias("dst"), F.col("_mean").alias("_mean2"), F.col("_n").alias("_n2"))
        grown = pairs.join(partner, [*on, "dst"]).select(*on, F.col("src").alias("_g"), "_mean2", "_n2")
        absorbed = pairs.select(*on, F.col("dst").alias("_g"))
        total = F.col("_n") + F.coalesce("_n2", F.lit(0))
        mean = F.when(
            F.col("_n2").isNotNull(),
            F.zip_with("_mean", "_mean2", lambda a, b: (a * F.col("_n") + b * F.col("_n2")) / (F.col("_n") + F.col("_n2"))),
        ).otherwise(F.col("_mean"))
        active = cut_lineage(
            alive.join(absorbed, [*on, "_g"], "left_anti").join(grown, [*on, "_g"], "left")
            .select(*on, "_g", mean.alias("_mean"), total.alias("_n"))
        )
        if _oversized(active, on, block).isEmpty():
            last = _in_blocks(active, on, 1.0 - threshold).where("_g <> _to")
            merged.append(last.select(*on, F.col("_to").alias("src"), F.col("_g").alias("dst")))
            break
    out = points.select(*on, "_g", F.col("_g").alias("_to"))
    for pairs in merged:
        step = pairs.select(*on, F.col("dst").alias("_to"), F.col("src").alias("_next"))
        out = out.join(step, [*on, "_to"], "left").select(*on, "_g", F.coalesce("_next", "_to").alias("_to"))
    return out
