"""Writes that may be repeated: upload notices, action log rows, natural-key rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.operators.listing import best_per_group


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the earliest; decided by content, so a rerun picks the same row."""
    rest = [c for c in df.columns if c not in keys]
    return best_per_group(df, keys, [F.col(c) for c in order], rest).select(*df.columns)


def ingest_idempotent(
    incoming: DataFrame, existing: DataFrame, key: str, order: Sequence[str], valid: Column | None = None
) -> DataFrame:
    """Valid incoming rows not seen before, once each."""
    rows = incoming if valid is None else incoming.where(valid)
    return first_per_key(rows, [key], order).join(existing.select(key), key, "left_anti")


def counter_changes(new_rows: DataFrame, parent: str, size: str) -> DataFrame:
    """What an ingest adds to its parents: item count and bytes."""
    return new_rows.groupBy(parent).agg(F.count(F.lit(1)).alias("added_items"), F.sum(size).alias("added_bytes"))


def upsert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Get-or-create by natural key: existing rows stay, the first incoming row of a new key is added."""
    fresh = first_per_key(incoming, keys, order).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def append_log(rows: DataFrame, path: str, day: str = "day") -> None:
    """Append to a log laid out by day. ``rebalance`` gathers a day into few files but splits a heavy one."""
    rows.hint("rebalance", day).write.mode("append").partitionBy(day).parquet(path)
