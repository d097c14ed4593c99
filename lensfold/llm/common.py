"""What the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensfold.session import checkpoint_root

#: Rows that Arrow hands to Python at once. Documents can be long; the session's default of 10,000 would hold too many.
ARROW_ROWS = 1000

#: Rows of a few dozen bytes that are sent to every executor rather than shuffling texts to them.
MOST_BROADCAST_ROWS = 300_000

#: White space inside a text, as in the size of a document.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what a Python worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the driver and all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor costs no recomputation, and Spark knows its size."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """A written table of rows of fixed width, marked for broadcast where it has at most ``most`` of them. Beyond that Spark
    shuffles both sides as usual; the result is the same."""
    return F.broadcast(rows) if rows.count() <= most else rows


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8_bytes(values: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def chunks(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]
