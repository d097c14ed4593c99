"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random once per curve, shifted, laid on a grid and ordered by their Hilbert key. Each ordering
is cut into ranges of about ``SLICE_ROWS`` rows, which Spark deals out. A query goes to its own range and to the
neighbouring ones on every curve; what these windows hold is ranked by the exact distance, and the ranks of all curves
are merged. The width of the windows is measured: for at most ``PROBES`` queries the true neighbours are searched in
all rows, and the width is the one at which ``target`` of them share a window on at least one curve. Vectors that lie close
together share keys, so a range may hold any number of rows: beyond ``MOST_ROWS`` its rows are dealt to several parts by a hash of
the id, its queries go to each part, and their answers are merged like those of other ranges.

Projections, grid and range boundaries come from at most ``SAMPLE`` vectors (by hash of the id); all rows are indexed.
Only the k + 1 smallest ids of equal vectors can be among k neighbours, so other copies aren't indexed; equal queries are
searched once. Vectors that are null, zero, hold null or non-finite components or differ in length from most others
take no part, nor do rows without an id. Rows that repeat an id count once, at their smallest distance. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensfold.llm.common import few, written

CURVES, AXES, BITS = 24, 7, 9
SLICE_ROWS, SAMPLE, PROBES = 512, 20_000, 100
#: Rows of a range that one task loads at most, about: a range with more is dealt to several.
MOST_ROWS = 4 * SLICE_ROWS
#: Neighbours taken from a window by rounded distance before the exact one is computed.
SPARE = 8


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of rows of grid coordinates below 2**bits. Columns times bits must not exceed 63.

    Gray-code construction by Skilling, "Programming the Hilbert curve" (2004), for all rows at once."""
    axes = [c.astype("uint64") for c in grid.T]
    zero, one = np.uint64(0), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        here, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i, axis in enumerate(axes):
            high = (axis & here) != 0
            swap = np.where(high, zero, (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(high, below, swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(grid), "uint64")
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), zero)
    axes = [a ^ turn for a in axes]
    key = np.zeros(len(grid), "uint64")
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | ((axis >> np.uint64(level)) & one)
    return key.astype("int64")


class Curves:
    """The orderings: random orthogonal projections, a shifted grid and range boundaries for each."""

    def __init__(self, sample: np.ndarray, rows: int, curves: int, seed: int):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        axes = min(AXES, dim)
        self.mean = sample.mean(axis=0)
        slices = max(1, min(rows // SLICE_ROWS, len(sample)))
        self.turns, self.low, self.span, self.shift, self.bounds = [], [], [], [], []
        for _ in range(curves):
            self.turns.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :axes])
            flat = (sample - self.mean) @ self.turns[-1]
            self.low.append(flat.min(axis=0))
            self.span.append(np.maximum(flat.max(axis=0) - flat.min(axis=0), 1e-12))
            self.shift.append(rng.random(axes))
            keys = np.sort(self._keys(sample, len(self.turns) - 1))
            self.bounds.append(np.unique(keys[np.arange(1, slices) * len(keys) // slices]))

    def _keys(self, vectors: np.ndarray, c: int) -> np.ndarray:
        place = ((vectors - self.mean) @ self.turns[c] - self.low[c]) / self.span[c]
        grid = (np.clip(place, 0, 1) + self.shift[c]) / 2 * (1 << BITS)
        return hilbert_keys(np.minimum(grid.astype("int64"), (1 << BITS) - 1), BITS)

    def slices(self, vectors: np.ndarray) -> np.ndarray:
        """Range of each vector on each curve: vectors x curves."""
        return np.stack([np.searchsorted(b, self._keys(vectors, c), side="right") for c, b in enumerate(self.bounds)], axis=1)


def stacked(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def best_in(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact distances of its k nearest rows, ties to smaller ids."""
    rough = (rows**2).sum(axis=1)[None, :] - 2 * queries @ rows.T
    for q, near in zip(queries, rough):
        if len(rows) > k + SPARE:
            edge = np.partition(near, k + SPARE - 1)[k + SPARE - 1]
            some = np.flatnonzero(near <= edge + 1e-9 * (1 + abs(edge)))
        else:
            some = np.arange(len(rows))
        far = exact(rows[some], q)
        order = np.lexsort((ids[some], far))[:k]
        yield ids[some][order], far[order]


FOUND = "cls long, vec_id long, score double"


def found_table(cls: list, ids: list, scores: list) -> pa.RecordBatch:
    sizes = [len(x) for x in ids]
    flat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    return pa.record_batch(
        {"cls": np.repeat(np.array(cls, "int64"), sizes), "vec_id": flat(ids, "int64").astype("int64"), "score": flat(scores, "float64").astype("float64")}
    )


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query class over all windows."""
    once = found.groupBy("cls", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(W.partitionBy("cls").orderBy("score", "vec_id"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def nearest(
    df: DataFrame, is_query: str, k: int = 10, key: str = "vec_id", vec: str = "embedding", target: float = 0.96, curves: int = CURVES, seed: int = 1
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row where the SQL condition ``is_query`` on
    ``vec_id`` holds, by Euclidean distance in double precision."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(sound)
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    rows = rows.where(F.size("v") == dim).withColumn("same", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    copy = F.row_number().over(W.partitionBy("same").orderBy("vec_id"))
    indexed = written(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v"), "ann-rows")
    asked = written(rows.where(is_query).select("vec_id", "same"), "ann-asked")
    classes = asked.groupBy("same").agg(F.min("vec_id").alias("cls"))
    queries = written(rows.join(classes, "same").where("vec_id = cls").groupBy("cls").agg(F.first("v").alias("v")), "ann-queries")

    n = indexed.count()
    thin = lambda frame, name, size, count: frame.where(F.pmod(F.xxhash64(name), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, size / max(1, count)))).limit(2 * size)
    sample = thin(indexed, "vec_id", SAMPLE, n).select("v").toArrow()["v"]
    if not n or not len(sample):
        return queries.limit(0).select(F.col("cls").alias("query_id"), F.lit(1).alias("rank"), F.col("cls").alias("vec_id"), F.lit(0.0).alias("score"))
    index = Curves(stacked(sample, dim), n, curves, seed)

    probes = thin(queries, "cls", PROBES, queries.count()).toArrow().slice(0, PROBES)
    wide = window(indexed, index, probes, dim, k, target) if len(probes) else 0

    def placed(reach: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = index.slices(stacked(batch["v"], dim))
                for c in range(at.shape[1]):
                    for step in range(-reach, reach + 1):
                        there = at[:, c] + step
                        keep = pa.array((there >= 0) & (there <= len(index.bounds[c])))
                        yield pa.record_batch({"curve": np.full(len(there), c, "int32"), "slice": there.astype("int32"), "id": batch[0], "v": batch["v"]}).filter(keep)

        return run

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = index.slices(stacked(batch["v"], dim)).astype("int32")
            yield pa.record_batch({"curve": np.tile(np.arange(at.shape[1], dtype="int32"), len(at)), "slice": at.ravel()})

    schema = "curve int, slice int, id long, v array<double>"
    ranges = indexed.select("v").mapInArrow(counted, "curve int, slice int").groupBy("curve", "slice").agg(F.ceil(F.count(F.lit(1)) / MOST_ROWS).cast("int").alias("parts"))
    full = few(written(ranges.where("parts > 1"), "ann-full"))
    parts = F.coalesce("parts", F.lit(1))
    left = indexed.select("vec_id", "v").mapInArrow(placed(0), schema).join(full, ["curve", "slice"], "left")
    left = left.select("curve", "slice", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "v")
    right = queries.select("cls", "v").mapInArrow(placed(wide), schema).join(full, ["curve", "slice"], "left")
    right = right.select("curve", "slice", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "id", "v")

    def ranked(rows: pa.Table, asked: pa.Table) -> pa.Table:
        cls, ids, scores = asked["id"].to_pylist(), [], []
        if len(rows) and cls:
            for near, far in best_in(stacked(asked["v"], dim), stacked(rows["v"], dim), rows["id"].to_numpy(), k + 1):
                ids.append(near)
                scores.append(far)
        else:
            cls = []
        return pa.Table.from_batches([found_table(cls, ids, scores)])

    at = ["curve", "slice", "part"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(ranked, FOUND)
    best = written(merged(found, k + 1), "ann-best")
    pairs = asked.join(classes, "same").select(F.col("vec_id").alias("query_id"), "cls").distinct().join(best, "cls").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def brute(indexed: DataFrame, probes: pa.Table, dim: int, k: int) -> DataFrame:
    """Exact neighbours of a few queries in all rows."""
    asked, names = stacked(probes["v"], dim), probes["cls"].to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = list(best_in(asked, stacked(batch["v"], dim), batch["vec_id"].to_numpy(), k))
            yield found_table(names, [x[0] for x in near], [x[1] for x in near])

    return merged(indexed.select("vec_id", "v").mapInArrow(run, FOUND), k)


def window(indexed: DataFrame, index: Curves, probes: pa.Table, dim: int, k: int, target: float) -> int:
    """Ranges on either side that ``target`` of the probes' true neighbours need. The driver gets k + 1 ids for each probe."""
    true = brute(indexed, probes, dim, k + 1).where("cls <> vec_id").join(indexed, "vec_id").select("cls", "v").toArrow()
    if not len(true):
        return 0
    own = dict(zip(probes["cls"].to_pylist(), index.slices(stacked(probes["v"], dim))))
    apart = np.abs(index.slices(stacked(true["v"], dim)) - np.stack([own[c] for c in true["cls"].to_pylist()])).min(axis=1)
    return int(np.sort(apart)[min(len(apart) - 1, int(np.ceil(target * len(apart))) - 1)])
