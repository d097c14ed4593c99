"""Keyed scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(
    spark: SparkSession, path: str, where: Column | None = None, columns: Sequence[str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read with the filter and the column list on top; Catalyst pushes both into the scan."""
    df = spark.read.format(fmt).load(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File listing (path, length, modified). The content column is pruned, so no file is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
