"""CSV export of guest leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The header of the export.
LEAD_HEADER = ("Name", "Phone", "First Visited", "Photos Matched", "Photos Downloaded")


def lead_rows(leads: DataFrame, name: str, phone: str, visited: str, matched: str, downloads: str, key: str) -> DataFrame:
    """Export rows, newest visitor first, missing values as empty text."""
    iso = F.date_format(F.col(visited), "yyyy-MM-dd'T'HH:mm:ss")
    cols = [F.col(name), F.col(phone), iso, F.col(matched).cast("string"), F.col(downloads).cast("string")]
    return leads.orderBy(F.col(visited).desc(), F.col(key)).select(
        *[F.coalesce(c, F.lit("")).alias(h) for c, h in zip(cols, LEAD_HEADER, strict=True)]
    )


def write_leads_csv(rows: DataFrame, path: str) -> None:
    """Sorted part files with a header each; the range sort is distributed, nothing passes the driver."""
    rows.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)
