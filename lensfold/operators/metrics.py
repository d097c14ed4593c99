"""Operators on labelled time series and on logs seen as series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensfold.operators.anchored import debounce as debounced
from lensfold.operators.anchored import finite_machine
from lensfold.operators.runs import sustained
from lensfold.operators.sliced import last_known, micros, previous_value, range_slice, running_sum, sliding_count, sliding_first, sliding_max
from lensfold.session import cut_lineage

# Quota bands in percent, and how far usage must fall before a band can alert again.
QUOTA_BANDS = (80.0, 95.0, 100.0)
QUOTA_HYSTERESIS = 5.0


def bucket(ts: str, seconds: int) -> Column:
    return (F.floor(micros(ts) / F.lit(seconds * 1_000_000)) * seconds).cast("bigint")


def counter_rate(samples: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, window: int, slices: int | None = None) -> DataFrame:
    """Increase per second of a counter per series and window; a drop means the counter was reset to zero.

    Plain rate between samples: nothing is extrapolated to the edges of the window.
    """
    rows = range_slice(samples.select(*series, ts, tie, value), series, [ts, tie], slices).withColumn("_now", F.struct(F.col(ts), F.col(value)))
    rows = previous_value(rows, series, [ts, tie], "_now", "_before").where(F.col("_before").isNotNull())
    old = F.col("_before").getField(value)
    grown = F.when(F.col(value) < old, F.col(value)).otherwise(F.col(value) - old)
    passed = (micros(ts) - micros(F.col("_before").getField(ts))) / 1_000_000
    per = rows.groupBy(*series, bucket(ts, window).alias("bucket")).agg(F.sum(grown).alias("_d"), F.sum(passed).alias("_s"))
    return per.select(*series, "bucket", F.when(F.col("_s") > 0, F.col("_d") / F.col("_s")).alias("rate"))


def over_series(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average, sum and number of series."""
    return df.groupBy(*by).agg(F.avg(value).alias("avg"), F.sum(value).alias("sum"), F.count(F.lit(1)).alias("series"))


def gauge_ratio(top: DataFrame, bottom: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Ratio of two gauges joined on their labels; no row where the other side has none or is 0."""
    low = bottom.select(*on, F.col(value).alias("_d"))
    return top.select(*on, F.col(value).alias("_n")).join(low, list(on)).where(F.col("_d") != 0).select(*on, (F.col("_n") / F.col("_d")).alias("ratio"))


def latest_per_series(samples: DataFrame, series: Sequence[str], ts: str, tie: str, value: str) -> DataFrame:
    """Last value per series, largest first."""
    last = samples.groupBy(*series).agg(F.max_by(value, F.struct(ts, tie)).alias(value))
    return last.orderBy(F.col(value).desc(), *series)


def quiet_while_running(state: DataFrame, load: DataFrame, key: Sequence[str], ts: str, value: str, seconds: float, below: float) -> DataFrame:
    """State samples that are on while the load of the trailing window stayed below a limit, or is absent."""
    both = state.where(F.col(value) == 1).select(*key, ts, F.lit(True).alias("_state"), F.lit(None).cast("double").alias("_load")).unionByName(
        load.select(*key, ts, F.lit(False).alias("_state"), F.col(value).cast("double").alias("_load"))
    )
    seen = sliding_max(both, key, ts, seconds, F.col("_load"), "peak").where("_state")
    return seen.where(F.col("peak").isNull() | (F.col("peak") < below)).select(*key, ts, F.col("peak").isNull().alias("absent"))


def not_draining(samples: DataFrame, key: Sequence[str], ts: str, tie: str, value: str, above: float, seconds: float, **kw) -> DataFrame:
    """Alerts: the backlog is above a limit and has not shrunk over the trailing window, for that long."""
    rows = sliding_first(samples, key, ts, tie, seconds, value, "_first")
    stuck = (F.col(value) > above) & ~(F.col(value) - F.col("_first") < 0)
    return sustained(rows, key, ts, tie, stuck, pending=seconds, **kw)


def band_of(percent: Column) -> Column:
    """Number of quota bands reached."""
    out = F.lit(0)
    for limit in QUOTA_BANDS:
        out = out + (percent >= limit).cast("int")
    return out


def quota_step(percent: float, last: int) -> tuple[int, int]:
    """(alert band or 0, next state). One alert at the highest new band; re-armed 5 points below the last one."""
    band = sum(percent >= limit for limit in QUOTA_BANDS)
    if band > last:
        return band, band
    if band == 0 and last and percent <= QUOTA_BANDS[last - 1] - QUOTA_HYSTERESIS:
        return 0, 0
    return 0, last


def _run_quota(percents: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    alerts = np.zeros(len(percents), dtype=np.int32)
    for i, percent in enumerate(percents):
        alerts[i], state = quota_step(percent, state)
    return alerts, state


def quota_alerts(usage: DataFrame, owner: Sequence[str], ts: str, tie: str, percent: str, **kw) -> DataFrame:
    """Usage rows with ``alert``: the band announced by this row, 0 for none."""
    rows = usage.select(*owner, ts, tie, F.col(percent).cast("double").alias("percent"))
    return finite_machine(rows, owner, ts, tie, len(QUOTA_BANDS) + 1, _run_quota, "percent", "alert", T.IntegerType(), **kw)


def notifications(alerts: DataFrame, group: Sequence[str], ts: str, repeat: float = 4 * 3600) -> DataFrame:
    """Alerts grouped by name: a notice is sent when none was sent in the last ``repeat`` seconds."""
    return debounced(alerts, group, ts, repeat).where("acts").select(*group, ts)


def daily_budget(points: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, budget: float, days: int = 3) -> DataFrame:
    """Per day: the latest point of each series within ``days``, summed, and whether that is over budget.

    One row per day is the once-a-day rule. The last point of a series and day is offered to every day that may still see
    it.
    """
    last = F.max_by("_v", F.struct(ts, tie)).alias("_v"), F.max(F.struct(ts, tie)).alias("_at")
    daily = points.where(F.col(value).isNotNull()).withColumns({"day": F.to_date(ts), "_v": F.col(value)}).groupBy("day", *series).agg(*last)
    return budget_totals(daily, series, budget, days)


def budget_totals(daily: DataFrame, series: Sequence[str], budget: float, days: int = 3) -> DataFrame:
    """(day, total, alert) from the latest point (_v, _at) of each series and day."""
    seen = daily.withColumn("day", F.explode(F.sequence("day", F.date_add("day", days - 1))))
    total = seen.groupBy("day", *series).agg(F.max_by("_v", "_at").alias("_v")).groupBy("day").agg(F.sum("_v").alias("total"))
    return total.withColumn("alert", F.col("total") > budget)


def latest_progress(updates: DataFrame, job: Sequence[str], ts: str, tie: str, done: str, total: str, now: Column, expiry: float = 86400) -> DataFrame:
    """Furthest progress per job, ignoring steps back; jobs silent for ``expiry`` seconds are gone."""
    out = updates.where(F.col(ts) <= now).groupBy(*job).agg(
        F.max(done).alias("done"), F.max_by(total, F.struct(ts, tie)).alias("total"), F.max(ts).alias("_last")
    )
    return out.where(micros(now) - micros("_last") < int(expiry * 1_000_000)).drop("_last")


def attempts(log: DataFrame, key: Sequence[str], ts: str, tie: str, success: str, ttl: float, most: int, slices: int | None = None) -> DataFrame:
    """Log with ``attempt`` (number since the last reset) and ``blocked``.

    Every attempt renews the time to live; a silence of ``ttl`` or an accepted success resets the count. A success
    beyond the cap is not accepted: once ``most`` attempts in a row failed, all later ones up to the next silence
    are blocked.
    """
    on, order = list(key), [ts, tie]
    rows = range_slice(log, on, order, slices).withColumn("_now", F.struct(F.col(ts), F.col(success)))
    rows = previous_value(rows, on, order, "_now", "_before")
    silent = F.col("_before").isNull() | (micros(ts) - micros(F.col("_before").getField(ts)) >= int(ttl * 1_000_000))
    rows = rows.withColumn("_silent", silent).withColumn("_reset", silent | F.col("_before").getField(success))
    rows = running_sum(rows, on, order, F.lit(1).cast("bigint"), "_ix")
    rows = last_known(rows, on, order, F.when(F.col("_reset"), F.col("_ix")), "_base")
    rows = last_known(rows, on, order, F.when(F.col("_silent"), F.col("_ix")), "_session")
    spent = (F.col("_ix") - F.col("_base") + 1 == most) & ~F.col(success)
    first = rows.where(spent).groupBy(*on, "_session").agg(F.min("_ix").alias("_spent"), F.min_by("_base", "_ix").alias("_spent_base"))
    rows = rows.join(first, [*on, "_session"], "left")
    blocked = F.coalesce(F.col("_ix") > F.col("_spent"), F.lit(False))
    number = F.col("_ix") - F.when(blocked, F.col("_spent_base")).otherwise(F.col("_base")) + 1
    return rows.withColumn("attempt", number).withColumn("blocked", blocked).select(*log.columns, "attempt", "blocked")


def sliding_limit(log: DataFrame, key: Sequence[str], ts: str, seconds: float, limit: int) -> DataFrame:
    """(key, instant): events of the window ``(ts - seconds, ts]`` and whether this one is allowed.

    Rejected events count as well; events at the same instant are one.
    """
    counted = sliding_count(log, key, ts, seconds, distinct=True)
    return counted.withColumn(ts, F.timestamp_micros("us")).withColumn("allowed", F.col("in_window") <= limit)


def watch(log: DataFrame, job: Sequence[str], ts: str, kind: str, now: Column, fresh: float = 180, stall: float = 1800) -> DataFrame:
    """Verdict per job at ``now``: healthy (fresh heartbeat), reverted (stalled) or recover.

    A start clears earlier heartbeats and is none itself. A heartbeat without a start counts as the start.
    """
    seen = log.where(F.col(ts) <= now)
    out = seen.groupBy(*job).agg(
        F.max(F.when(F.col(kind) == "start", F.col(ts))).alias("_s"), F.max(F.when(F.col(kind) == "heartbeat", F.col(ts))).alias("_h"), F.min(ts).alias("_first")
    )
    beat = F.when(F.col("_s").isNull() | (F.col("_h") >= F.col("_s")), F.col("_h"))
    out = out.withColumn("last_heartbeat", beat).withColumn("started", F.coalesce("_s", "_first"))
    age = micros(now) - micros(F.coalesce("last_heartbeat", "started"))
    is_fresh = F.col("last_heartbeat").isNotNull() & (age < int(fresh * 1_000_000))
    verdict = F.when(is_fresh, "healthy").when(age >= int(stall * 1_000_000), "reverted").otherwise("recover")
    return out.withColumn("idle_seconds", age / 1_000_000).withColumn("verdict", verdict).drop("_s", "_h", "_first")


def reconcile(
    log: DataFrame, job: Sequence[str], ts: str, kind: str, tie: str, fresh: float = 180, stall: float = 1800, debounce: float = 300
) -> DataFrame:
    """(job, ts, tie, verdict) of every ``check`` row among ``start`` and ``heartbeat`` rows, in order of (ts, tie).

    ``healthy``: a heartbeat since the last start is younger than ``fresh``. Otherwise, silent for ``stall`` (since the
    heartbeat, or the start if there is none): ``reverted`` once per attempt, then ``skipped``. Otherwise the job is to
    be recovered: ``requeued`` at most once in ``debounce`` seconds, else ``waiting``. What comes first counts as a start.
    """
    on, order = list(job), [ts, tie]
    at = F.struct(*order)
    rows = range_slice(log.select(*on, *order, F.col(kind).alias("_kind")), on, order)
    rows = last_known(rows, on, order, F.when(F.col("_kind") == "start", at), "_start")
    rows = last_known(rows, on, order, F.when(F.col("_kind") == "heartbeat", at), "_beat")
    first = log.groupBy(*on).agg(F.min(ts).alias("_first"))
    beat = F.when(F.col("_start").isNull() | (F.col("_beat") > F.col("_start")), F.col("_beat")[ts])
    checks = rows.where("_kind = 'check'").join(first, on).select(*on, *order, "_start", beat.alias("_beat"), F.coalesce(F.col("_start")[ts], "_first").alias("_from"))
    idle = micros(ts) - micros(F.coalesce("_beat", "_from"))
    healthy = F.col("_beat").isNotNull() & (idle < int(fresh * 1_000_000))
    state = F.when(healthy, "healthy").when(idle >= int(stall * 1_000_000), "stalled").otherwise("recover")
    checks = cut_lineage(checks.withColumn("_attempt", F.coalesce(micros(F.col("_start")[ts]), F.lit(-1))).select(*on, *order, "_attempt", state.alias("_state")))
    given_up = checks.where("_state = 'stalled'").groupBy(*on, "_attempt").agg(F.min(at).alias("_one"))
    recover = checks.where("_state = 'recover'")
    acts = debounced(recover, on, ts, debounce).where("acts").select(*on, ts)
    acts = recover.join(acts, [*on, ts], "left_semi").groupBy(*on, ts).agg(F.min(at).alias("_one"))
    ones = given_up.select(*on, "_one").unionByName(acts.select(*on, "_one")).select(*on, *[F.col("_one")[c].alias(c) for c in order], F.lit(True).alias("_first"))
    verdict = (
        F.when(F.col("_state") == "healthy", "healthy")
        .when(F.col("_state") == "stalled", F.when(F.col("_first"), "reverted").otherwise("skipped"))
        .otherwise(F.when(F.col("_first"), "requeued").otherwise("waiting"))
    )
    return checks.join(ones, [*on, *order], "left").select(*on, *order, verdict.alias("verdict"))


def windowed_counts(log: DataFrame, key: Sequence[str], ts: str, action: str, size: str, slide: str | None = None) -> DataFrame:
    """Views and downloads per key and window; the same plan runs on a batch and on a stream with a watermark."""
    return log.groupBy(*key, F.window(ts, size, slide)).agg(
        F.count_if(F.col(action) == "view").alias("views"), F.count_if(F.col(action) == "download").alias("downloads")
    )
