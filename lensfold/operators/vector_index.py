"""Top-k search by hash tables of random projections, for partition keys with many targets.

A table cuts space by hyperplanes; a vector's code says on which side of each it lies. Targets are kept under their code in
every table, a query looks under its own code and under those that differ where it lies closest to a plane (multi-probe). Codes have
as many bits as leave ``BUCKET`` targets under one on average, so work grows slower than the number of targets.

How many tables and probes are needed is computed, not guessed: two vectors at cosine c see a plane as two normal variables
with correlation c, whatever their length or direction. ``scheme`` draws such pairs once and takes the cheapest choice by which
targets at the threshold are met with probability ``recall``; nearer ones are met more surely.

What is met is scored in blocks like the exact search, the ``pool`` best of a query over all tables are scored again on the stored
vectors, and the best k of these are the answer. Partition keys with fewer than ``index_from`` targets are searched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.functions import vectors as V
from lensfold.operators import similarity as S
from lensfold.operators.listing import first_n

BUCKET, MOST_BITS, MOST_FLIPS = 64, 24, 3
RECALL = 0.97
#: Fixed for all tables: the same vectors have the same codes in every run.
SEED, TRIALS = 17, 4000


def bits_for(targets: int) -> int:
    """Length of the codes of so many targets."""
    return min(MOST_BITS, max(1, int(math.log2(max(2, targets / BUCKET)))))


@lru_cache(maxsize=None)
def flips(bits: int) -> np.ndarray:
    """Sets of up to ``MOST_FLIPS`` bits as rows of zeros and ones; none first."""
    sets = [s for n in range(min(MOST_FLIPS, bits) + 1) for s in combinations(range(bits), n)]
    out = np.zeros((len(sets), bits))
    for row, s in enumerate(sets):
        out[row, list(s)] = 1
    return out


@lru_cache(maxsize=None)
def scheme(bits: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, probes of a table): the fewest looked-up buckets by which pairs at the threshold meet with this probability."""
    rng = np.random.default_rng(SEED)
    c = min(max(threshold, 0.0), 1.0)
    query = rng.normal(size=(TRIALS, bits))
    target = c * query + math.sqrt(1 - c * c) * rng.normal(size=query.shape)
    apart = (query < 0) != (target < 0)
    near = query**2
    cost, own = near @ flips(bits).T, (near * apart).sum(axis=1)
    place = (cost < own[:, None]).sum(axis=1)  # how many buckets are looked up before the right one
    place[apart.sum(axis=1) > MOST_FLIPS] = cost.shape[1]
    best = None
    for probes in sorted({1, 2, *(int(1.5**i) for i in range(2, 40)), cost.shape[1]}):
        if probes > cost.shape[1] or not (met := float((place < probes).mean())):
            continue
        tables = 1 if met >= 1 - 1e-9 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))
        # A bucket that is looked up costs its targets, a table costs a copy of every vector.
        if best is None or tables * (probes + 4) < best[0]:
            best = tables * (probes + 4), tables, probes
    return best[1:]


@lru_cache(maxsize=4)
def planes(tables: int, dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).normal(size=(tables, MOST_BITS, dim))


def codes(vec: str, bits: str, threshold: float, recall: float, probed: bool) -> Column:
    """Array of (table, code): where a target is kept, or where a query looks. Codes of different lengths never meet in one key."""

    @F.arrow_udf("array<struct<t: int, c: long>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, lengths in batches:
            matrix, there = S._matrix(vectors, False)
            lengths = lengths.to_numpy(zero_copy_only=False)
            rows, table, code = [], [], []
            for b in np.unique(lengths[there]).tolist():
                own = np.flatnonzero((lengths == b) & there)
                tables, probes = scheme(b, threshold, recall)
                sets, powers = flips(b).astype("int64"), 1 << np.arange(b, dtype="int64")
                for t, p in enumerate(planes(tables, matrix.shape[1])[:, :b]):
                    sides = matrix[own] @ p.T
                    found = ((sides < 0) @ powers)[:, None]
                    if probed and probes > 1:
                        order = np.argsort((sides**2) @ sets.T.astype(float), axis=1, kind="stable")[:, :probes]
                        found = found ^ (sets @ powers)[order]
                    rows.append(np.repeat(own, found.shape[1]))
                    table.append(np.full(found.size, t, "int32"))
                    code.append(found.ravel())
            at, table, code = (np.concatenate([np.zeros(0, "int64"), *x]) for x in (rows, table, code))
            order = np.argsort(at, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(lengths)))])
            pairs = pa.StructArray.from_arrays([pa.array(table[order].astype("int32")), pa.array(code[order])], ["t", "c"])
            yield pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pairs)

    return run(vec, bits)


def _coded(df: DataFrame, sizes: DataFrame, ident: str, vec: str, part: Sequence[str], threshold: float, recall: float, probed: bool) -> DataFrame:
    rows = df.join(sizes, list(part)).select(*part, ident, F.col(vec).cast("array<float>").alias(vec), "_bits")
    kept = rows.withColumn("_at", F.explode(codes(vec, "_bits", threshold, recall, probed)))
    return kept.select(*part, F.col("_at.t").alias("_table"), F.col("_at.c").alias("_code"), ident, vec)


def _sizes(targets: DataFrame, part: Sequence[str], index_from: int) -> DataFrame:
    steps = [F.lit(BUCKET * 2**b) for b in range(2, MOST_BITS + 1)]
    bits = F.lit(1) + sum((F.col("_n") >= s).cast("int") for s in steps)
    return targets.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= index_from).select(*part, bits.alias("_bits"))


def comparisons(queries: DataFrame, targets: DataFrame, ident: str, vec: str, part: Sequence[str], threshold: float, index_from: int, recall: float = RECALL) -> DataFrame:
    """(part, compared): pairs that the index looks at."""
    sizes = _sizes(targets, part, index_from)
    at = [*part, "_table", "_code"]
    counted = lambda df, n, probed: _coded(df, sizes, ident, vec, part, threshold, recall, probed).groupBy(*at).agg(F.count(F.lit(1)).alias(n))
    return counted(queries, "q", True).join(counted(targets, "t", False), at).groupBy(*part).agg(F.sum(F.col("q") * F.col("t")).alias("compared"))


def search(
    queries: DataFrame, targets: DataFrame, ident: str, vec: str, part: Sequence[str], k: int, threshold: float, index_from: int = 500,
    recall: float = RECALL, block: int = S.BLOCK,
) -> DataFrame:
    """The exact search where no key has ``index_from`` targets, else that with the index."""
    if _sizes(targets, list(part), index_from).isEmpty():
        return S.topk_search(queries, targets, ident, vec, part, k, threshold, block)
    return indexed_topk(queries, targets, ident, vec, part, k, threshold, index_from, recall, block)


def indexed_topk(
    queries: DataFrame, targets: DataFrame, ident: str, vec: str, part: Sequence[str], k: int, threshold: float, index_from: int = 500,
    recall: float = RECALL, block: int = S.BLOCK,
) -> DataFrame:
    """``similarity.topk_search`` (part, src, dst, score, rank), through the index where a key has ``index_from`` targets or more."""
    on, pool = list(part), max(4 * k, k)
    sizes = _sizes(targets, on, index_from)
    slim = lambda df: df.select(*on, ident, vec)
    few = [slim(df).join(sizes.select(*on), on, "left_anti") for df in (queries, targets)]
    exact = S.topk_search(*few, ident, vec, on, k, threshold, block).select(*on, "src", "dst", "score", F.col("rank").cast("int").alias("rank"))

    looked = _coded(queries, sizes, ident, vec, on, threshold, recall, True)
    kept = _coded(targets, sizes, ident, vec, on, threshold, recall, False)
    met = S.topk_search(looked, kept, ident, vec, [*on, "_table", "_code"], pool, threshold - 1e-6, block)
    best = first_n(met.select(*on, "src", "dst", "score").dropDuplicates([*on, "src", "dst"]), [*on, "src"], [F.col("score").desc(), F.col("dst")], pool)
    ends = lambda df, end: df.select(*on, F.col(ident).alias(end), F.col(vec).alias(f"_{end}"))
    again = best.select(*on, "src", "dst").join(ends(queries, "src"), [*on, "src"]).join(ends(targets, "dst"), [*on, "dst"])
    again = again.select(*on, "src", "dst", F.round(V.cosine("_src", "_dst"), S.SCORE_DIGITS).alias("score")).where(F.col("score") >= threshold)
    ranked = first_n(again, [*on, "src"], [F.col("score").desc(), F.col("dst")], k)
    return exact.unionByName(ranked.select(*on, "src", "dst", "score", F.col("rank").cast("int").alias("rank")))
