"""Row predicates and score gates. ``now`` is always an argument, never the wall clock."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.operators.sliced import micros, running_sum


@dataclass(frozen=True)
class QualityLimits:
    """Default limits of the quality gate."""

    blur: float = 0.5
    yaw: float = 45.0
    pitch: float = 35.0
    roll: float = 45.0
    min_age: int = 5
    sunglasses: float = 0.5
    failed_age: int = 200


@dataclass(frozen=True)
class LivenessLimits:
    """Default limits of the liveness gate."""

    ratio_min: float = 0.04
    ratio_max: float = 0.85
    det_score: float = 0.55
    sharpness: float = 50.0
    saturation: float = 20.0


def band_filter(df: DataFrame, angles: Sequence[str], lo: float, hi: float, mode: str = "regular") -> DataFrame:
    """Rows inside a pose band. A null angle excludes the row.

    ``regular``: every absolute angle in ``[lo, hi)``. ``restricted``: every one ``<= hi``, at least one ``>= lo``.
    """
    known = F.lit(True)
    for a in angles:
        known = known & F.col(a).isNotNull()
    size = [F.abs(F.col(a)) for a in angles]
    least, most = F.least(*size), F.greatest(*size)
    inside = (least >= lo) & (most < hi) if mode == "regular" else (most <= hi) & (most >= lo)
    return df.where(known & inside)


def quality_gate(
    df: DataFrame,
    cols: Mapping[str, str],
    limits: QualityLimits = QualityLimits(),
    skip: Sequence[str] = (),
    out: str = "quality",
) -> DataFrame:
    """Blur, then pose, then age; the first failing gate names the reason and hides later scores.

    A null score passes. Sunglasses never reject: they only set a flag on rows that pass.
    """
    blur = F.col(cols["blur"])
    pose = [F.col(cols[a]) for a in ("yaw", "pitch", "roll")]
    age = F.nullif(F.col(cols["age"]), F.lit(limits.failed_age)) if "age" not in skip else F.lit(None).cast("int")
    has_pose = pose[0].isNotNull() & pose[1].isNotNull() & pose[2].isNotNull()
    extreme = F.lit(False)
    for angle, limit in zip(pose, (limits.yaw, limits.pitch, limits.roll), strict=True):
        extreme = extreme | (F.abs(angle) > limit)
    reason = (
        F.when(blur > limits.blur, "blur").when(has_pose & extreme, "ypr").when(age < limits.min_age, "age")
    )
    glasses = F.lit(False)
    if "sunglasses" not in skip:
        glasses = F.coalesce(F.col(cols["sunglasses"]) >= limits.sunglasses, F.lit(False))
    reached_pose = F.coalesce(reason != "blur", F.lit(True)) & has_pose
    reached_age = F.coalesce(~reason.isin("blur", "ypr"), F.lit(True))
    return df.withColumn(
        out,
        F.struct(
            reason.isNull().alias("passed"),
            reason.alias("reject_reason"),
            blur.alias("blur_score"),
            *[F.when(reached_pose, p).alias(n) for n, p in zip(("yaw", "pitch", "roll"), pose, strict=True)],
            F.when(reached_age, age).alias("age"),
            (reason.isNull() & glasses).alias("has_sunglasses"),
        ),
    )


def liveness_gate(
    df: DataFrame, cols: Mapping[str, str], limits: LivenessLimits = LivenessLimits(), out: str = "failed_checks"
) -> DataFrame:
    """Names of the failed checks in fixed order; an empty list is a pass."""
    ratio = F.greatest(F.lit(0.0), F.col(cols["w"]) * F.col(cols["h"]))
    checks = {
        "face_size": ratio.between(limits.ratio_min, limits.ratio_max),
        "detection_confidence": F.col(cols["score"]) >= limits.det_score,
        "sharpness": F.col(cols["sharpness"]) >= limits.sharpness,
        "color_present": F.col(cols["saturation"]) > limits.saturation,
    }
    return df.withColumn(
        out, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))
    )


def status_filter(df: DataFrame, status: str, wanted: str, parent: str | None = None, parent_id=None) -> DataFrame:
    """Rows of one status, optionally under one parent."""
    keep = F.col(status) == wanted
    return df.where(keep & (F.col(parent) == parent_id) if parent is not None and parent_id is not None else keep)


def due(df: DataFrame, ts: str, now: Column, status: str, wanted: str = "ready") -> DataFrame:
    return df.where((F.col(ts) <= now) & (F.col(status) == wanted))


def warn(
    df: DataFrame, ts: str, now: Column, status: str, windows=((6.5, 7.5), (0.5, 1.5)), done: str = "archived"
) -> DataFrame:
    """Rows whose days left fall in one of the windows (both ends inclusive)."""
    days = (micros(ts) - micros(now)) / F.lit(86_400_000_000.0)
    hit = F.lit(False)
    for lo, hi in windows:
        hit = hit | days.between(lo, hi)
    return df.where((F.col(status) != done) & (F.col(ts) > now) & hit).withColumn("days_left", days)


def admit_within_quota(
    requests: DataFrame, owner: str, order: Sequence[str], size: str, used: str, limit: str
) -> DataFrame:
    """Bytes asked for so far by an owner, in arrival order, against what is left of the owner's limit.

    Needs a slice column (``time_slice`` or ``range_slice``), so one heavy owner is not one task.
    """
    summed = running_sum(requests, [owner], list(order), F.col(size), "asked_bytes")
    return summed.withColumn("admitted", F.col(used) + F.col("asked_bytes") <= F.col(limit))


def retention_due(listing: DataFrame, name: str, cutoff: Column) -> DataFrame:
    """Backups named ``YYYY-MM-DD.sql.gz`` dated on or before the cutoff; other names are ignored."""
    day = F.try_to_date(F.regexp_extract(F.col(name), "^([0-9]{4}-[0-9]{2}-[0-9]{2})\\.sql\\.gz$", 1), "yyyy-MM-dd")
    return listing.withColumn("backup_date", day).where(F.col("backup_date") <= cutoff)


def search(df: DataFrame, text: str, query: str, status: str | None = None, wanted: str | None = None) -> DataFrame:
    """Case-insensitive substring search, optionally within one status."""
    out = df.where(F.lower(F.col(text)).contains(query.strip().lower()))
    return out if status is None or wanted is None else out.where(F.col(status) == wanted)


def label_match(df: DataFrame, labels: str, equals: Mapping[str, str] = {}, unlike: Mapping[str, str] = {}) -> DataFrame:
    """Metric label matchers; a negated pattern is anchored at both ends and a missing label is ''."""
    keep = F.lit(True)
    for key, value in equals.items():
        keep = keep & (F.coalesce(F.col(labels)[key], F.lit("")) == value)
    for key, pattern in unlike.items():
        keep = keep & ~F.coalesce(F.col(labels)[key], F.lit("")).rlike(f"^(?:{pattern})$")
    return df.where(keep)


def size_class(df: DataFrame, size: str, max_small: int = 3, out: str = "size_class") -> DataFrame:
    return df.withColumn(out, F.when(F.col(size) <= max_small, "small").otherwise("established"))


def violations(
    df: DataFrame, key: str, checks: Mapping[str, Column], unique: Mapping[str, Sequence[str]] = {}
) -> DataFrame:
    """One row per (rule, key) that breaks a rule; ``checks`` are conditions that must hold, null holds."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))
    out = df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))
    for rule, cols in unique.items():
        dup = df.groupBy(*cols).count().where(F.col("count") > 1)
        keys = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
        out = out.unionByName(dup.select(F.lit(rule).alias("rule"), keys.alias("key")))
    return out
