"""Runs of a condition over time: idle timers, sustained thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.operators.sliced import SLICE, last_known, micros, previous_value, range_slice


def runs(
    samples: DataFrame, key: Sequence[str], ts: str, tie: str, condition: Column, period: float,
    max_gap: float | None = None, slices: int | None = None,
) -> DataFrame:
    """One row per unbroken run of ``condition``: start, end, samples, and when it had lasted ``period`` (or null).

    A false sample breaks a run, and so does a hole longer than ``max_gap`` (no data counts as fine).
    """
    rows = samples.select(*key, F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), condition.alias("_on"))
    rows = range_slice(rows, key, ["_ts", "_tie"], slices)
    rows = rows.withColumn("_on", F.coalesce("_on", F.lit(False))).withColumn("_at", F.struct("_ts", "_on"))
    rows = previous_value(rows, key, ["_ts", "_tie"], "_at", "_before")
    fresh = F.col("_before").isNull() | ~F.col("_before._on")
    if max_gap is not None:
        fresh = fresh | (micros("_ts") - micros(F.col("_before._ts")) > int(max_gap * 1_000_000))
    rows = last_known(rows, key, ["_ts", "_tie"], F.when(F.col("_on") & fresh, F.struct("_ts", "_tie")), "_run").drop(SLICE)
    lasted = micros("_ts") - micros(F.col("_run._ts")) >= int(period * 1_000_000)
    return (
        rows.where("_on").groupBy(*key, "_run")
        .agg(F.max("_ts").alias("ended"), F.count(F.lit(1)).alias("samples"), F.min(F.when(lasted, F.col("_ts"))).alias("fired_at"))
        .select(*key, F.col("_run._ts").alias("started"), "ended", "samples", "fired_at")
    )


def idle(ticks: DataFrame, key: Sequence[str], ts: str, tie: str, busy: Column, period: float = 600, **kw) -> DataFrame:
    """Idle runs: any busy tick clears the timer; fires at the first tick that is ``period`` into the run."""
    return runs(ticks, key, ts, tie, ~busy, period, **kw)


def sustained(samples: DataFrame, key: Sequence[str], ts: str, tie: str, condition: Column, pending: float = 600, interval: float = 60, **kw) -> DataFrame:
    """Alerts: the condition held at every evaluation for ``pending`` seconds; missing evaluations reset it."""
    return runs(samples, key, ts, tie, condition, pending, max_gap=interval, **kw).where(F.col("fired_at").isNotNull())
