"""Sorted, paged and top-n listings with a total order, so that pages never overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensfold.operators.rollups import per_key


def clamp(value: int, lo: int, hi: int | None = None) -> int:
    return max(lo, value if hi is None else min(value, hi))


def sort_order(col: str | Column, direction: str = "asc") -> Column:
    """Nulls are the largest value, as in the database the listings come from."""
    c = F.col(col) if isinstance(col, str) else col
    return c.desc_nulls_first() if direction == "desc" else c.asc_nulls_last()


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of an already ordered frame; Spark keeps only offset + limit rows per task."""
    return df.offset(clamp(offset, 0)).limit(clamp(limit, 1, 100))


def next_offset(offset: int, limit: int, total: int) -> int | None:
    return offset + limit if offset + limit < total else None


def list_sorted(
    df: DataFrame, by: str | Column, key: str, direction: str = "asc", offset: int = 0, limit: int = 50
) -> DataFrame:
    return page(df.orderBy(sort_order(by, direction), F.col(key).asc()), offset, limit)


def top_items(items: DataFrame, log: DataFrame, item: str, by: str = "views", limit: int = 10) -> DataFrame:
    """Most viewed or downloaded items; items without any action stay in the running."""
    counted = per_key(
        items, log, [item],
        views=F.count_if(F.col("action") == "view"), downloads=F.count_if(F.col("action") == "download"),
    )
    return counted.orderBy(F.col(by).desc(), F.col(item).asc()).limit(clamp(limit, 1, 50))


def leads(
    sessions: DataFrame, log: DataFrame, session: str, sort: Mapping[str, str], sort_by: str = "guest_name",
    direction: str = "asc", number: int = 1, limit: int = 10, verified: str = "verified",
) -> DataFrame:
    """A page of the verified sessions with their download counts, and how many there are in all (``total``); ``sort``
    maps the public sort name to a column."""
    known = sessions.where(F.col(verified))
    total = known.agg(F.count(F.lit(1))).scalar()
    counted = per_key(known, log.where(F.col("action") == "download"), [session], downloads=F.count(F.lit(1)))
    column = sort.get(sort_by, next(iter(sort.values())))
    return list_sorted(counted, column, session, direction, (clamp(number, 1) - 1) * limit, limit).withColumn("total", total)


def first_n(df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First n rows per group. Spark cuts each group to n rows in every map task before the shuffle
    (``WindowGroupLimit``), so a hot group moves n rows per task and not all of them."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(out) <= n)


def best_per_group(df: DataFrame, part: Sequence[str], rank: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the smallest ``rank`` tuple per group, as a partial aggregate (no sort, no window)."""
    best = F.min_by(F.struct(*keep), F.struct(*rank)).alias("_best")
    return df.groupBy(*part).agg(best).select(*part, "_best.*")


def best_target(pairs: DataFrame, part: Sequence[str], src: str, dst: str, score: str, threshold: float) -> DataFrame:
    """Best target per source at or above the threshold; equal scores go to the smallest target id."""
    good = pairs.where(F.col(score) >= threshold)
    rest = [c for c in pairs.columns if c not in (*part, src)]
    return best_per_group(good, [*part, src], [-F.col(score), F.col(dst)], rest)
