"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups sorted by size, largest first, enter the bin with the least remaining capacity that still holds them; a balanced
tree orders the bins by what remains. For ``shards`` bins the capacity is the smallest for which the packing needs no
more, so sizes come out near equal; a group larger than an equal part has a shard of its own.

The packing runs in two levels so that no task and not the driver sees all groups. Groups of less than a unit (an
equal part divided by ``UNITS``) are packed inside hash buckets, in parallel, into boxes of one unit. Boxes and larger
groups are then packed into shards: of the larger groups there are at most ``shards * UNITS``; boxes fill more than
half but for one a bucket, so there are at most ``2 * shards * UNITS + buckets`` of them, at any input size.

Null texts count as empty. Repeated rows belong to one group. An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensfold.llm.common import partitions, written

#: Boxes that would fill one shard.
UNITS = 500


class Remaining:
    """Bins ordered by remaining capacity: a balanced tree of two levels, whose leaves split when they are full."""

    LEAF = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []  # the last entry of each leaf but the last one

    def add(self, entry: tuple[int, int]) -> None:
        at = bisect_left(self.tops, entry)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.tops.insert(at, leaf[half - 1])

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least capacity of at least ``size``."""
        at = bisect_left(self.tops, (size, -1))
        for leaf_at in range(at, len(self.leaves)):
            leaf = self.leaves[leaf_at]
            place = bisect_left(leaf, (size, -1))
            if place < len(leaf):
                found = leaf.pop(place)
                if not leaf and len(self.leaves) > 1:
                    del self.leaves[leaf_at]
                    del self.tops[min(leaf_at, len(self.tops) - 1)]
                return found
        return None


def best_fit(sizes: Iterable[int], capacity: int) -> Iterator[int]:
    """Bin of each size, in the order given; a size above the capacity gets a bin that holds nothing else."""
    free, bins = Remaining(), 0
    for size in sizes:
        remaining, place = free.take(size) or (capacity, bins)
        bins += place == bins
        if remaining - size > 0:
            free.add((remaining - size, place))
        yield place


def pack(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size, sizes descending: a size of at least an equal part of the rest stands alone, the others share
    the other shards at the smallest capacity that best fit needs no more shards for."""
    alone, rest = 0, sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[alone] * (shards - alone) >= rest:
        rest -= sizes[alone]
        alone += 1
    small, left = sizes[alone:], shards - alone
    if not small:
        return list(range(alone))
    low = max(math.ceil(rest / left), small[0])
    high = low + small[0]
    while max(best_fit(small, high)) >= left:
        low, high = high + 1, high + small[0]
    while low < high:
        middle = (low + high) // 2
        if max(best_fit(small, middle)) < left:
            high = middle
        else:
            low = middle + 1
    return [*range(alone), *(alone + b for b in best_fit(small, high))]


def shards_of(groups: DataFrame, shards: int, group: str = "group", size: str = "size") -> DataFrame:
    """(group, shard) for rows with unique ``group`` (binary or string) and positive whole ``size``."""
    spark = groups.sparkSession
    total = groups.agg(F.sum(size)).first()[0]
    unit = max(1, math.ceil((total or 0) / shards / UNITS))
    buckets = partitions(spark)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket_free, count = None, Remaining(), 0
        for batch in batches:
            boxes = []
            for bucket, bytes_ in zip(batch["bucket"].to_pylist(), batch["size"].to_pylist(), strict=True):
                if bucket != last:
                    last, bucket_free, count = bucket, Remaining(), 0
                remaining, box = bucket_free.take(bytes_) or (unit, count)
                count += box == count
                if remaining - bytes_ > 0:
                    bucket_free.add((remaining - bytes_, box))
                boxes.append(box)
            yield pa.record_batch({"g": batch["g"], "bucket": batch["bucket"], "box": pa.array(boxes, pa.int64()), "size": batch["size"]})

    rows = groups.select(F.col(group).alias("g"), F.col(size).cast("long").alias("size"))
    kind = dict(rows.dtypes)["g"]
    small = rows.where(F.col("size") < unit).withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    small = small.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("size"), "g")
    boxes = small.mapInArrow(boxed, f"g {kind}, bucket int, box long, size long")
    large = rows.where(F.col("size") >= unit).select("g", F.lit(-1).alias("bucket"), F.xxhash64("g").alias("box"), "size")
    placed = written(boxes.unionByName(large), "boxes")
    sums = placed.groupBy("bucket", "box").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "bucket", "box").collect()  # bounded, see above
    chosen = [(x["bucket"], x["box"], s) for x, s in zip(sums, pack([x["size"] for x in sums], shards), strict=True)]
    to = spark.createDataFrame(chosen, "bucket int, box long, shard int")
    return placed.join(to, ["bucket", "box"]).select(F.col("g").alias(group), "shard")


def slots(rows: DataFrame, within: str, order: list[Column], slot: str = "slot") -> DataFrame:
    """Number the rows of each ``within`` from 0 without gaps: slices by hash are numbered in parallel, then moved along."""
    slices = partitions(rows.sparkSession) * 2
    cut = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    sums = cut.groupBy(within, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select(
        within, "slice", F.coalesce(F.sum("n").over(W.partitionBy(within).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    own = F.row_number().over(W.partitionBy(within, "slice").orderBy(*order))
    return cut.join(before, [within, "slice"]).withColumn(slot, (F.col("before") + own - 1).cast("long")).drop("slice", "before")
