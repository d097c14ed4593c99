"""Weighted unit means of vector columns as ordinary partial aggregates.

One ``sum`` per dimension: every task reduces its rows to one buffer per key before the shuffle, so a key with
a third of all rows moves one row per task. Sums are double, the result is float.

Beyond ``BLOCK_DIMS`` dimensions so many sums no longer compile into one loop. There each Arrow batch is first reduced to one matrix
row per key, and these are summed in blocks of dimensions, one row a key and block.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensfold.functions import vectors as V


BLOCK_DIMS = 64


def vector_dim(df: DataFrame, vec: str) -> int:
    """The length of all vectors of a column; fails when they differ."""
    least, most = df.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if least != most:
        raise ValueError(f"vectors of different lengths: {least} and {most}")
    return least or 0


def of_length(vec: str, dim: int) -> Column:
    """The vector, or null; any other length fails the query."""
    wrong = F.raise_error(F.concat(F.lit(f"a vector must have {dim} components, found "), F.size(vec).cast("string")))
    return F.when(F.col(vec).isNull() | (F.size(vec) == dim), F.col(vec)).otherwise(wrong.cast("array<double>"))


def vector_sum(vec: str, dim: int, weight: str | None = None) -> Column:
    """Sum of vectors (times a weight column), one partial sum per dimension. Check lengths with ``of_length`` first."""
    factor = "" if weight is None else f" * {weight}"
    return F.expr("array(" + ", ".join(f"sum(double(get({vec}, {i})){factor})" for i in range(dim)) + ")")


def _partial_sums(df: DataFrame, keys: list[str], vec: str, dim: int, weight: str | None) -> DataFrame:
    """(keys, _s, weight): sums over the rows of one Arrow batch and key."""
    rows = df.select(*keys, F.col(vec).cast("array<double>").alias("_v"), F.lit(1.0).alias("_w") if weight is None else F.col(weight).cast("double").alias("_w"))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_s", T.ArrayType(T.DoubleType())), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            groups = table.select(keys).append_column("_i", pa.array(np.arange(batch.num_rows))).group_by(keys, use_threads=False).aggregate([("_i", "list")])
            places = groups.column("_i_list").combine_chunks()
            order, starts = places.flatten().to_numpy(), np.asarray(places.offsets)[:-1]
            weights = batch["_w"].to_numpy(zero_copy_only=False)[order]
            matrix = batch["_v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order] * weights[:, None]
            sums = np.add.reduceat(matrix, starts, axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, dim, dtype="int32")), pa.array(sums.ravel()))
            yield from groups.select(keys).append_column("_s", lists).append_column("weight", pa.array(np.add.reduceat(weights, starts))).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def vector_sums(df: DataFrame, keys: Sequence[str], vec: str, dim: int, weight: str | None = None, aggregates: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, _s, aggregates): sums of vectors that are there, times a weight column, with other aggregates of the same groups. Check
    lengths with ``of_length`` first."""
    on, aggregates = list(keys), aggregates or {}
    others = [a.alias(n) for n, a in aggregates.items()]
    if dim <= BLOCK_DIMS:
        return df.groupBy(*on).agg(vector_sum(vec, dim, weight).alias("_s"), *others)
    starts = range(0, dim, BLOCK_DIMS)
    pieces = F.posexplode(F.array(*[F.slice("_s", at + 1, BLOCK_DIMS) for at in starts])).alias("_block", "_s")
    partial = _partial_sums(df.where(F.col(vec).isNotNull()), on, vec, dim, weight).select(*on, pieces)
    blocks = partial.groupBy(*on, "_block").agg(vector_sum("_s", BLOCK_DIMS).alias("_s"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_s"))), lambda b: b["_s"])
    sums = blocks.groupBy(*on).agg(F.slice(F.flatten(whole), 1, dim).alias("_s"))
    if not others:
        return sums
    both = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in on]).agg(*others)
    same = [F.col(f"_key_{k}").eqNullSafe(F.col(k)) for k in on]
    return both.join(sums, same, "left").select(*[F.col(f"_key_{k}").alias(k) for k in on], "_s", *aggregates)


def unit_float(v: Column | str) -> Column:
    return F.transform(V.unit(v), lambda x: x.cast("float"))


def weighted_unit_mean(
    df: DataFrame, keys: Sequence[str], vec: str, weight: str | None = None, empty: str = "error", *,
    dim: int, out: str = "centroid",
) -> DataFrame:
    """Unit vector of the weighted mean per key, with the total weight.

    ``error``: a total weight <= 0 fails the query and a zero mean stays zero. ``null``: both give null.
    """
    if empty == "null":
        df = df.where(F.col(vec).isNotNull())
        if weight is not None:
            df = df.where(F.col(weight) > 0)
    total = F.sum(weight) if weight is not None else F.count(F.lit(1))
    agg = vector_sums(df.withColumn(vec, of_length(vec, dim)), keys, vec, dim, weight, {"weight": total})
    mean = V.scale("_s", F.lit(1.0) / F.col("weight"))
    if empty == "null":
        value = F.when(V.norm("_s") > 0, unit_float(mean))
    else:
        value = F.when(F.col("weight") > 0, unit_float(mean)).otherwise(
            F.raise_error(F.lit("total weight of a centroid must be positive")).cast("array<float>")
        )
    return agg.withColumn(out, value).drop("_s")


def fold_members(
    clusters: DataFrame, members: DataFrame, keys: Sequence[str], centroid: str, size: str, vec: str,
    create: bool = True, *, dim: int,
) -> DataFrame:
    """New centroid and size of clusters that got members. An old size of 0 counts as 1.

    ``create`` makes a centroid where there was none; otherwise clusters without one are left out.
    """
    touched = members.select(*keys).distinct()
    old = (
        clusters.join(touched, list(keys), "left_semi")
        .where(F.col(centroid).isNotNull())
        .select(*keys, F.col(centroid).alias("_v"), F.greatest(F.col(size), F.lit(1)).cast("bigint").alias("_w"))
    )
    new = members.select(*keys, F.col(vec).alias("_v"), F.lit(1).cast("bigint").alias("_w"))
    if not create:
        new = new.join(old.select(*keys), list(keys), "left_semi")
    return weighted_unit_mean(old.unionByName(new), keys, "_v", "_w", dim=dim, out=centroid).withColumnRenamed("weight", size)


def refresh_from_members(
    clusters: DataFrame, members: DataFrame, touched: DataFrame, keys: Sequence[str], vec: str, out: str,
    dim: int,
) -> DataFrame:
    """Recompute ``out`` of touched clusters from member vectors; null when no member has one."""
    ids = touched.select(*keys).distinct()
    fresh = weighted_unit_mean(
        members.join(ids, list(keys), "left_semi"), keys, vec, empty="null", dim=dim, out="_fresh"
    ).drop("weight")
    return (
        clusters.join(ids.withColumn("_hit", F.lit(True)), list(keys), "left")
        .join(fresh, list(keys), "left")
        .withColumn(out, F.when(F.col("_hit"), F.col("_fresh")).otherwise(F.col(out)))
        .drop("_hit", "_fresh")
    )
