"""Changes by key: plain Parquet has no update, so a change gives the rows of the table as they are afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def apply_changes(base: DataFrame, changes: DataFrame, key: Sequence[str], delete: DataFrame | None = None) -> DataFrame:
    """Overwrite the columns of ``changes`` where the key matches; drop the keys of ``delete``.

    A changed value of null is a real null: the match decides, not the value.
    """
    updated = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in updated])
    out = base.join(renamed, list(key), "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in updated else F.col(c)
            for c in base.columns
        ]
    )
    return out if delete is None else out.join(delete.select(*key).distinct(), list(key), "left_anti")


def bulk_set(base: DataFrame, wanted: DataFrame, key: Sequence[str], **values) -> DataFrame:
    """Set columns on all wanted rows; fails when a wanted key does not exist."""
    keys = wanted.select(*key).distinct()
    missing = keys.join(base.select(*key), list(key), "left_anti").count()
    if missing:
        raise ValueError(f"{missing} of the requested rows do not exist")
    return apply_changes(base, keys.withColumns({c: F.lit(v) for c, v in values.items()}), key)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)
