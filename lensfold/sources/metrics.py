"""Metric samples in text exposition form, as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = "^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\\{([^}]*)\\})?\\s+(\\S+)(?:\\s+(-?[0-9]+))?\\s*$"


def parse_samples(lines: DataFrame, scraped: Column, text: str = "value") -> DataFrame:
    """``name{k="v"} number [millis]`` lines to (ts, metric, labels, value); comments are skipped."""
    part = lambda i: F.regexp_extract(text, _LINE, i)
    pairs = F.regexp_extract_all(part(2), F.lit('([a-zA-Z_][a-zA-Z0-9_]*)="([^"]*)"'), F.lit(0))
    labels = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, '="([^"]*)"$', 1).alias("value")))
    )
    stamp = F.when(part(4) != "", F.timestamp_millis(part(4).cast("bigint"))).otherwise(scraped)
    return lines.where(~F.col(text).startswith("#") & F.col(text).rlike(_LINE)).select(
        *[c for c in lines.columns if c != text],
        stamp.alias("ts"), part(1).alias("metric"), labels.alias("labels"), part(3).cast("double").alias("value"),
    )
