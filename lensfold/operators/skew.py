"""Joins to a table with unique keys that stay even when one key has a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.session import cut_lineage

#: Rows from which a key is heavy, at least; and the most keys that can be.
LEAST_HEAVY, MOST_KEYS = 500, 5_000


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], size: int, how: str = "left") -> DataFrame:
    """``rows`` (written, ``size`` of them) joined to ``table`` (unique ``keys``). Rows of heavy keys stay where they are: what the table
    says of these keys, at most ``MOST_KEYS`` rows, is sent to them. The others are shuffled."""
    on = list(keys)
    heavy = max(LEAST_HEAVY, -(-size // MOST_KEYS))
    if size <= heavy:
        return rows.join(table, on, how)
    hot = cut_lineage(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select(*on))
    if hot.isEmpty():
        return rows.join(table, on, how)
    known = F.broadcast(cut_lineage(table.join(F.broadcast(hot), on, "left_semi")))
    here = rows.join(F.broadcast(hot), on, "left_semi").join(known, on, how)
    return rows.join(F.broadcast(hot), on, "left_anti").join(table, on, how).unionByName(here)
