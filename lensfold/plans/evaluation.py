"""Quality of a clustering against labels, run metrics, and product figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(num, den, digits: int = 4):
    return F.round(F.when(den > 0, num / den), digits)


def cluster_quality(assigned: DataFrame, cluster: str, label: str, part: Sequence[str] = ()) -> DataFrame:
    """Purity and completeness (shares of pure clusters and of undivided labels), pair precision and recall.

    Works on the contingency table, one row per (cluster, label): pairs are counted by n(n-1)/2, never listed.
    """
    on = list(part)
    cell = assigned.where(F.col(cluster).isNotNull()).groupBy(*on, cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    by_cluster = cell.groupBy(*on, cluster).agg(F.count(F.lit(1)).alias("_kinds"), F.sum("_n").alias("_n"))
    by_label = cell.groupBy(*on, label).agg(F.count(F.lit(1)).alias("_kinds"), F.sum("_n").alias("_n"))
    key = on or [F.lit(0).alias("_all")]
    names = on or ["_all"]
    same = cell.groupBy(*key).agg(pairs("_n").alias("_both"))
    c = by_cluster.groupBy(*key).agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("_kinds") == 1).alias("_pure"), pairs("_n").alias("_pc"), F.sum("_n").alias("members")
    )
    lab = by_label.groupBy(*key).agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("_kinds") == 1).alias("_whole"), pairs("_n").alias("_pl"))
    out = same.join(c, names).join(lab, names)
    return out.select(
        *on, "clusters", "labels", "members", _ratio(F.col("_pure"), F.col("clusters")).alias("purity"),
        _ratio(F.col("_whole"), F.col("labels")).alias("completeness"), _ratio(F.col("_both"), F.col("_pc")).alias("precision"),
        _ratio(F.col("_both"), F.col("_pl")).alias("recall"),
    )


def match_quality(hits: DataFrame, query: str, found: str, truth: str) -> DataFrame:
    """Share of queries whose best match is right, and of matched queries whose best match is wrong.

    ``hits`` has one row per query; ``found`` is null when nothing matched.
    """
    right = F.count_if(F.col(found) == F.col(truth))
    return hits.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col(found).isNotNull()).alias("matched"),
        F.round(right / F.count(F.lit(1)), 4).alias("accuracy"),
        F.round((F.count(found) - right) / F.count(F.lit(1)), 4).alias("false_match_rate"),
    )


def run_metrics(members: DataFrame, hits: DataFrame, part: Sequence[str], passed: str, cluster: str, matches: str) -> DataFrame:
    """Per partition: rejection rate, clusters, mean size, match rate, mean matches per query."""
    on = list(part)
    faces = members.groupBy(*on).agg(
        F.count(F.lit(1)).alias("faces"), F.round(F.count_if(~F.col(passed)) / F.count(F.lit(1)), 4).alias("rejection_rate"),
    )
    sizes = members.where(F.col(cluster).isNotNull()).groupBy(*on, cluster).agg(F.count(F.lit(1)).alias("_n"))
    groups = sizes.groupBy(*on).agg(F.count(F.lit(1)).alias("clusters"), F.round(F.avg("_n"), 4).alias("mean_cluster_size"))
    asked = hits.groupBy(*on).agg(
        F.round(F.count_if(F.col(matches) > 0) / F.count(F.lit(1)), 4).alias("match_rate"), F.round(F.avg(matches), 4).alias("mean_matches")
    )
    return faces.join(groups, on, "left").join(asked, on, "left")


def product_kpis(log: DataFrame, sessions: DataFrame, parents: DataFrame, items: DataFrame, month: str) -> DataFrame:
    """Views of a month, owners with items, share of visitors who download, mean matches, share of repeat owners."""
    first = F.lit(f"{month}-01").cast("timestamp")
    in_month = (F.col("ts") >= first) & (F.col("ts") < F.add_months(first, 1))
    used = parents.join(items.select("event_id").distinct(), "event_id", "left_semi").groupBy("owner_id").agg(F.count(F.lit(1)).alias("_n"))
    downloads = F.when(F.col("action") == "download", F.col("session_id"))
    visits = log.agg(
        F.count_if(in_month & (F.col("action") == "view")).cast("double").alias("monthly_views"),
        F.round(F.countDistinct(downloads) / F.countDistinct("session_id"), 4).alias("download_conversion"),
    )
    owners = used.agg(
        F.count(F.lit(1)).cast("double").alias("active_owners"), F.round(F.count_if(F.col("_n") > 1) / F.count(F.lit(1)), 4).alias("repeat_rate")
    )
    guests = sessions.agg(F.round(F.avg("matched"), 4).alias("mean_matches"))
    figures = lambda df: df.unpivot([], df.columns, "kpi", "value")
    return figures(visits).unionByName(figures(owners)).unionByName(figures(guests))
