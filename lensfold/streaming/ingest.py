"""Streams over the log and over upload notices, and incremental resolution of arriving vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensfold.operators.metrics import budget_totals, windowed_counts
from lensfold.plans.identity import CLUSTER, CLUSTER_COLUMNS, ResolveConfig, resolve
from lensfold.session import cut_lineage
from lensfold.sources import snapshots
from lensfold.sources.ingest import ingest_idempotent

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def running_counts(log: DataFrame, key: Sequence[str], ts: str, action: str, size: str, slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Views and downloads per window; the total is the sum of the tumbling windows. Update or append mode."""
    return windowed_counts(log.withWatermark(ts, watermark), key, ts, action, size, slide)


def distinct_notices(notices: DataFrame, key: str, ts: str, watermark: str = WATERMARK) -> DataFrame:
    """Repeats of an upload id within the watermark are dropped in the stream itself."""
    return notices.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def ingest_stream(notices: DataFrame, key: str, ts: str, order: Sequence[str], path: str, checkpoint: str, valid: Column | None = None, watermark: str = WATERMARK):
    """Writer of new uploads. A repeat of any age is caught by the anti-join with what is already stored.

    Each batch goes to its own folder, replaced when the batch is run again, and a batch only looks at the
    folders of earlier batches: a replay writes the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = batch.where("false").select(key)
        if snapshots.path_exists(spark, path):
            stored = spark.read.option("basePath", path).parquet(path)
            seen = stored.where(F.col("batch") < batch_id).select(key)
        ingest_idempotent(batch, seen, key, order, valid).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return distinct_notices(notices, key, ts, watermark).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def budget_stream(points: DataFrame, series: Sequence[str], ts: str, tie: str, value: str, budget: float, path: str, checkpoint: str, days: int = 3, watermark: str = WATERMARK):
    """Writer of the daily budget. The latest point of a series and day comes out once, when the watermark has passed the day; it goes to
    ``path``/daily, and the totals of the days that may see it, in ``path``/totals, are made anew from the ``days`` days that they see.

    A day's row is final once the watermark has passed it, so an alert is due once a day. Days are partitions and are replaced
    as a whole: a batch that is run again gives the same rows.
    """
    on, root = list(series), path.rstrip("/")
    known = points.where(F.col(value).isNotNull()).withWatermark(ts, watermark).withColumn("_at", F.struct(ts, tie))
    last = known.groupBy(F.window(ts, "1 day"), *on).agg(F.max_by(value, "_at").alias("_v"), F.max("_at").alias("_at"))
    daily = last.select(F.to_date("window.start").alias("day"), *on, "_v", "_at")

    def overwrite(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/{name}")

    def write(batch: DataFrame, batch_id: int) -> None:
        done = [r["day"] for r in batch.select("day").distinct().collect()]  # days that the watermark has passed since the last batch
        if not done:
            return
        spark = batch.sparkSession
        overwrite(batch, "daily")
        touched = sorted({d + timedelta(days=i) for d in done for i in range(days)})
        seen = spark.read.schema(batch.schema).parquet(f"{root}/daily").where(F.col("day").between(touched[0] - timedelta(days=days - 1), touched[-1]))
        overwrite(budget_totals(seen, on, budget, days).where(F.col("day").isin(touched)), "totals")

    return daily.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


STATE = ("member", "cluster")  # kinds of rows
#: Touched keys that are named in a filter; more are joined.
MOST_NAMED = 1000


def _pruned(table: DataFrame, touched: DataFrame, part: Sequence[str]) -> DataFrame:
    """Rows of the touched keys, which are partitions of the table: others aren't read."""
    keys = touched.limit(MOST_NAMED + 1).collect()
    if len(keys) > MOST_NAMED:
        return table.join(F.broadcast(touched), list(part), "left_semi")
    wanted = F.lit(False)
    for key in keys:
        wanted = wanted | reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(key[p])) for p in part])
    return table.where(wanted)


def resolved_tables(spark: SparkSession, root: str, members: DataFrame, config: ResolveConfig) -> tuple[DataFrame, DataFrame]:
    """(members with vectors, state) below ``root``, both partitioned by the key; empty before the first batch."""
    n = config.names
    key = [f for f in members.schema.fields if f.name in n.part]
    state = T.StructType([
        *key, T.StructField("kind", T.StringType()), T.StructField(n.ident, T.StringType()), T.StructField(CLUSTER, T.StringType()),
        *[T.StructField(c, T.LongType() if c.endswith("size") else T.ArrayType(T.FloatType())) for c in CLUSTER_COLUMNS], T.StructField("batch", T.LongType()),
    ])
    vectors = T.StructType([*[f for f in members.schema.fields if f.name != CLUSTER], T.StructField("batch", T.LongType())])
    vectors = T.StructType([T.StructField(f.name, T.StringType()) if f.name == n.ident else f for f in vectors.fields])
    folders = (f"{root.rstrip('/')}/members", vectors), (f"{root.rstrip('/')}/state", state)
    return tuple(spark.read.schema(schema).parquet(path) if snapshots.path_exists(spark, path) else spark.createDataFrame([], schema) for path, schema in folders)


def resolve_stream(members: DataFrame, root: str, checkpoint: str, config: ResolveConfig):
    """Writer that resolves arriving vectors against the clusters so far. Of two tables partitioned by the key, only the partitions that a
    batch touches are read and replaced: ``members`` gets the batch's vectors beside the others, ``state`` holds a narrow row for each member
    and one for each cluster, in the same files.

    A batch that is run again replaces its own vectors and leaves keys alone whose state it has already written; new ids come from
    content. Pending members of earlier batches take part again.
    """
    n = config.names
    on = list(n.part)

    def overwrite(df: DataFrame, name: str, keys: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root.rstrip('/')}/{name}")

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.drop(CLUSTER).withColumn(n.ident, F.col(n.ident).cast("string")).withColumn("batch", F.lit(batch_id).cast("long"))
        overwrite(fresh, "members", [*on, "batch"])
        vectors, state = resolved_tables(batch.sparkSession, root, batch, config)
        touched = cut_lineage(batch.select(*on).distinct())
        before = cut_lineage(_pruned(state, touched, on))
        written = before.where(F.col("batch") >= batch_id).select(*on).distinct()
        touched = cut_lineage(touched.join(written, on, "left_anti"))
        if touched.isEmpty():
            return
        before = before.join(written, on, "left_anti")
        assigned = before.where("kind = 'member'").select(*on, n.ident, CLUSTER)
        known = cut_lineage(_pruned(vectors.where(F.col("batch") <= batch_id).drop("batch"), touched, on).join(assigned, [*on, n.ident], "left"))
        clusters = before.where("kind = 'cluster'").select(*on, CLUSTER, *CLUSTER_COLUMNS)
        done = resolve(known, None if clusters.isEmpty() else clusters, replace(config))
        rows = [done.members.withColumn("kind", F.lit(STATE[0])), done.clusters.withColumn("kind", F.lit(STATE[1]))]
        after = rows[0].unionByName(rows[1], allowMissingColumns=True).withColumn("batch", F.lit(batch_id).cast("long"))
        overwrite(cut_lineage(after.select(*state.columns)).hint("rebalance", *on), "state", on)

    return members.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
