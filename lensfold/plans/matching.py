"""Vector match: queries against cluster centroids, agreement of two models, fan-out to items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.functions import vectors as V
from lensfold.operators.vector_index import search

HIGH, LOW = "high", "low"


def confidence(agrees: Column, tagging: Column) -> Column:
    return F.when(~tagging | agrees, HIGH).otherwise(LOW)


def match(
    queries: DataFrame, clusters: DataFrame, query: str, cluster: str, part: Sequence[str], primary: str = "primary",
    secondary: str = "secondary", centroid: str = "centroid", second_centroid: str = "secondary_centroid",
    threshold: float = 0.55, k: int = 5, dual: bool = True, index_from: int = 500,
) -> DataFrame:
    """(part, query, cluster, similarity, rank, confidence). Parts with ``index_from`` clusters or more are searched by index.

    The primary model decides which clusters match. The secondary model is only asked about those k, so it costs
    k cosines per query and no second search; a hit of the secondary model alone never appears.
    """
    on = list(part)
    src = queries.select(*on, F.col(query).cast("string").alias("k"), F.col(primary).alias("v"))
    dst = clusters.select(*on, F.col(cluster).cast("string").alias("k"), F.col(centroid).alias("v"))
    hits = search(src, dst, "k", "v", on, k, threshold, index_from)
    hits = hits.select(*on, F.col("src").alias(query), F.col("dst").alias(cluster), F.col("score").alias("similarity"), "rank")
    if not dual:
        return hits.withColumn("confidence", F.lit(HIGH))
    q = queries.select(*on, F.col(query).cast("string").alias(query), F.col(secondary).alias("_q"))
    c = clusters.select(*on, F.col(cluster).cast("string").alias(cluster), F.col(second_centroid).alias("_c"))
    agrees = F.coalesce(V.cosine("_q", "_c") >= threshold, F.lit(False))
    return (
        hits.join(q, [*on, query]).join(c, [*on, cluster])
        .withColumn("confidence", confidence(agrees, F.col("_q").isNotNull())).drop("_q", "_c")
    )


def match_status(queries: DataFrame, clusters: DataFrame, hits: DataFrame, query: str, part: Sequence[str]) -> DataFrame:
    """Per query: number of matches, best score, and no_clusters / no_match / matched."""
    on = list(part)
    per_query = hits.groupBy(*on, query).agg(F.count(F.lit(1)).alias("matches"), F.max("similarity").alias("best"))
    known = clusters.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return (
        queries.select(*on, F.col(query).cast("string").alias(query)).join(known, on, "left").join(per_query, [*on, query], "left")
        .withColumn("matches", F.coalesce("matches", F.lit(0).cast("bigint")))
        .withColumn("status", F.when(F.col("_n").isNull(), "no_clusters").when(F.col("matches") == 0, "no_match").otherwise("matched"))
        .drop("_n")
    )


def matched_photos(hits: DataFrame, members: DataFrame, query: str, cluster: str, item: str, part: Sequence[str]) -> DataFrame:
    """Distinct items of the matched clusters per query."""
    on = list(part)
    pairs = members.where(F.col(cluster).isNotNull()).select(*on, cluster, item).distinct()
    return hits.select(*on, query, cluster).join(pairs, [*on, cluster]).select(*on, query, item).distinct()
