"""Effects of archive, restore and purge on the catalog tables. Moving the stored objects is not done here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rendition columns that an archive clears, and the counters it resets.
RENDITION_COLUMNS = ("micro_thumb", "thumb", "preview", "proxy", "blurhash")
RESET = {"derivative_file_size_bytes": 0, "face_count": 0, "processing_status": "pending"}


def archive(items: DataFrame, archived: DataFrame, parent: str) -> DataFrame:
    """Items of archived parents lose renditions, derivative bytes and faces; proxy bytes are kept as they are."""
    flag = archived.select(parent).distinct().withColumn("_gone", F.lit(True))
    out = items.join(flag, parent, "left")
    gone = F.coalesce("_gone", F.lit(False))
    for name in items.columns:
        kind = items.schema[name].dataType
        if name in RENDITION_COLUMNS:
            out = out.withColumn(name, F.when(~gone, F.col(name)))
        elif name in RESET:
            out = out.withColumn(name, F.when(gone, F.lit(RESET[name]).cast(kind)).otherwise(F.col(name)))
    return out.drop("_gone")


def drop_children(rows: DataFrame, archived: DataFrame, parent: str) -> DataFrame:
    """Embeddings and clusters of archived parents go away."""
    return rows.join(archived.select(parent).distinct(), parent, "left_anti")


def set_status(parents: DataFrame, which: DataFrame, parent: str, status: str) -> DataFrame:
    """``archived`` on archive, ``processing`` on restore."""
    flag = which.select(parent).distinct().withColumn("_hit", F.lit(True))
    return parents.join(flag, parent, "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def purge(parents: DataFrame, items: DataFrame, which: DataFrame, parent: str) -> tuple[DataFrame, DataFrame]:
    """Parents and their items removed; recount the owners' bytes afterwards."""
    return drop_children(parents, which, parent), drop_children(items, which, parent)
