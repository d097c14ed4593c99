"""Ordered operators that do not need a whole key in one task.

A window such as ``sum() over (partition by key order by ts)`` sorts all rows of a key in one task. When a
key may hold a third of the table that task never ends. Here the rows of a key are cut into slices along the
sort order, the window runs inside (key, slice), and what earlier slices hand over is computed on one summary
row per slice. Slices come from a time column (``time_slice``) or from range partitioning (``range_slice``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensfold.session import cut_lineage

SLICE = "_slice"


def micros(ts: str | Column) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def time_slice(df: DataFrame, ts: str, seconds: float) -> DataFrame:
    """Slice number = which span of ``seconds`` the row falls in."""
    return df.withColumn(SLICE, F.floor(micros(ts) / F.lit(int(seconds * 1_000_000))))


def range_slice(df: DataFrame, part: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Slice number = range partition of (part, order); written out so that the number is stable."""
    keys = [*part, *order]
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")))


def _spans(part: Sequence[str], order: Sequence[Column | str]):
    inner = Window.partitionBy(*part, SLICE).orderBy(*order)
    across = Window.partitionBy(*part).orderBy(SLICE)
    return inner, across


def running_sum(df: DataFrame, part: Sequence[str], order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Running sum including the current row, in ``order`` within ``part``."""
    inner, across = _spans(part, order)
    local = df.withColumn("_v", value)
    carry = (
        local.groupBy(*part, SLICE)
        .agg(F.sum("_v").alias("_t"))
        .withColumn("_carry", F.sum("_t").over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .drop("_t")
    )
    return (
        local.withColumn(out, F.sum("_v").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .join(carry, [*part, SLICE])
        .withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_v", "_carry")
    )


def previous_value(
    df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``lag(value)`` in ``order`` within ``part``; null on the first row."""
    inner, across = _spans(part, order)
    last = (
        df.groupBy(*part, SLICE)
        .agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_l"))
        .withColumn("_prev", F.lag("_l").over(across))
        .drop("_l")
    )
    first = F.row_number().over(inner) == 1
    return (
        df.withColumn("_first", first)
        .withColumn(out, F.lag(value).over(inner))
        .join(last, [*part, SLICE])
        .withColumn(out, F.when(F.col("_first"), F.col("_prev.v")).otherwise(F.col(out)))
        .drop("_first", "_prev")
    )


def last_known(df: DataFrame, part: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` up to and including the current row."""
    inner, across = _spans(part, order)
    local = df.withColumn("_v", value)
    back = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy(*part, SLICE)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_l"))
        .withColumn("_carry", F.last("_l", ignorenulls=True).over(back))
        .drop("_l")
    )
    return (
        local.withColumn(out, F.last("_v", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .join(carry, [*part, SLICE])
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop("_v", "_carry")
    )


def position(df: DataFrame, part: Sequence[str], order: Sequence[str], out: str, slices: int | None = None) -> DataFrame:
    """1-based rank of every row within ``part``: ``row_number`` for whole tables with hot keys."""
    ranged = range_slice(df, part, order, slices)
    return running_sum(ranged, part, order, F.lit(1).cast("bigint"), out).drop(SLICE)


def running_max(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Largest value up to and including the current row, in ``order`` within ``part``."""
    inner, across = _spans(part, order)
    carry = df.groupBy(*part, SLICE).agg(F.max(value).alias("_t")).withColumn("_carry", F.max("_t").over(across.rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    local = df.withColumn(out, F.max(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(carry, [*part, SLICE]).withColumn(out, F.greatest(out, "_carry")).drop("_carry")


def _with_instants(df: DataFrame, part: Sequence[str], ts: str, found: DataFrame) -> DataFrame:
    us = micros(ts)
    return df.withColumn("_us", us).join(found, [*part, "_us"]).drop("_us")


def sliding_max(df: DataFrame, part: Sequence[str], ts: str, seconds: float, value: Column, out: str) -> DataFrame:
    """Largest ``value`` of the left-open time window ``(ts - seconds, ts]`` of each row; null without values.

    Time is cut into blocks as long as the window. A window is the end of one block and the beginning of the next, so it is
    the larger of a running maximum from the block's start and one from the end of the block before, backwards. Both run over slices
    of rows: work and groups don't depend on how many rows a window holds.
    """
    on, width = list(part), int(seconds * 1_000_000)
    at = cut_lineage(df.select(*on, micros(ts).alias("_us"), value.alias("_v")).groupBy(*on, "_us").agg(F.max("_v").alias("_v")))
    block = lambda us: F.floor(us / F.lit(width)).alias("_block")
    begun = range_slice(at.select(*on, block(F.col("_us")), "_us", "_v"), [*on, "_block"], ["_us"])
    begun = running_max(begun, [*on, "_block"], ["_us"], "_v", "_begun").select(*on, "_us", "_begun")
    since = F.col("_us") - width
    asked = at.select(*on, block(since), (-since).alias("_back"), F.lit(0).alias("_kind"), F.lit(None).cast(at.schema["_v"].dataType).alias("_v"))
    kept = at.select(*on, block(F.col("_us")), (-F.col("_us")).alias("_back"), F.lit(1).alias("_kind"), "_v")
    ended = range_slice(asked.unionAll(kept), [*on, "_block"], ["_back", "_kind"])
    ended = running_max(ended, [*on, "_block"], ["_back", "_kind"], "_v", "_ended").where("_kind = 0")
    ended = ended.select(*on, (width - F.col("_back")).alias("_us"), "_ended")
    return _with_instants(df, on, ts, begun.join(ended, [*on, "_us"]).select(*on, "_us", F.greatest("_begun", "_ended").alias(out)))


def sliding_first(df: DataFrame, part: Sequence[str], ts: str, tie: str, seconds: float, value: str, out: str) -> DataFrame:
    """``value`` of the first row by (ts, tie) of the left-open time window ``(ts - seconds, ts]`` of each row.

    It is what stands next behind the window's start, found by one ordered pass over rows and window starts.
    """
    on, width = list(part), int(seconds * 1_000_000)
    first = F.min_by(F.struct(F.col(value).alias("v")), F.col(tie)).alias("_v")
    at = cut_lineage(df.withColumn("_us", micros(ts)).groupBy(*on, "_us").agg(first))
    since = F.col("_us") - width
    asked = at.select(*on, (-since).alias("_back"), F.lit(0).alias("_kind"), F.lit(None).cast(at.schema["_v"].dataType).alias("_v"))
    both = range_slice(asked.unionAll(at.select(*on, (-F.col("_us")).alias("_back"), F.lit(1).alias("_kind"), "_v")), on, ["_back", "_kind"])
    found = last_known(both, on, ["_back", "_kind"], F.col("_v"), "_first").where("_kind = 0")
    return _with_instants(df, on, ts, found.select(*on, (width - F.col("_back")).alias("_us"), F.col("_first.v").alias(out)))


def sliding_count(
    df: DataFrame, part: Sequence[str], ts: str, seconds: float, distinct: bool = False, out: str = "in_window",
    slice_seconds: float | None = None,
) -> DataFrame:
    """(part, us, out): events in the left-open window ``(ts - seconds, ts]`` at every instant with events.

    A sweep: an instant enters at its time and leaves ``seconds`` later, and the running sum of both is the count.
    A sliding window frame would walk through the whole window again for every row. ``distinct`` counts events at
    the same instant once. Slices are ranges of rows unless ``slice_seconds`` cuts them by time.
    """
    width = int(seconds * 1_000_000)
    at = df.select(*part, micros(ts).alias("_us")).groupBy(*part, "_us").agg(F.count(F.lit(1)).alias("_n"))
    weight = F.lit(1).cast("bigint") if distinct else F.col("_n")
    moves = F.array(
        F.struct(F.col("_us").alias("_at"), F.lit(1).alias("_in"), weight.alias("_w")),
        F.struct((F.col("_us") + width).alias("_at"), F.lit(0).alias("_in"), (-weight).alias("_w")),
    )
    sweep = at.select(*part, F.explode(moves).alias("_m")).select(*part, "_m.*")
    if slice_seconds:
        sweep = sweep.withColumn(SLICE, F.floor(F.col("_at") / F.lit(int(slice_seconds * 1_000_000))))
    else:
        sweep = range_slice(sweep, part, ["_at", "_in"])
    counted = running_sum(sweep, part, ["_at", "_in"], F.col("_w"), out)
    return counted.where("_in = 1").select(*part, F.col("_at").alias("us"), out)
