"""Rows dealt to tasks in the order of a whole-number key, by boundaries that both sides of a hand-over know."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -(2**63)


def ordered_key(key: str) -> Column:
    """The key with null before everything else."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LEAST))


def boundaries(keys: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` approximate quantiles of a key, ascending; the driver gets no more than these."""
    if parts < 2:
        return []
    found = keys.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], F.lit(max(10_000, 20 * parts))).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket(key: str | Column, bounds: Sequence[int]) -> Column:
    """Number of boundaries at or below the key; equal keys always share a bucket."""
    edges = np.array(bounds, "int64")

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            yield pa.array(np.searchsorted(edges, keys.to_numpy(zero_copy_only=False), side="right").astype("int32"))

    return run(key)
