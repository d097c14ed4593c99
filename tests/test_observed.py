"""Counters on the writing job, and suppression called from SQL."""

import random

import pytest
from pyspark.sql import functions as F

from lensfold.operators import boxes, rollups

NAMES = ["completed", "failed"]
CORNERS = ["x1", "y1", "x2", "y2"]


def test_counters_come_with_the_job(spark, tmp_path):
    spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "failed").when(F.col("id") % 7 == 0, "other").otherwise("completed").alias("status")).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    rows, watch = rollups.observed(df, "outcomes", "status", NAMES)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    rows.write.parquet(f"{tmp_path}/out")
    want = rollups.outcome_counts(df, "status", NAMES).first().asDict()
    assert watch.get == {"total": 500, **want}
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan


def test_counters_of_a_stream(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).select("id", F.when(F.col("id") % 2 == 0, "failed").otherwise("completed").alias("status")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = rollups.observed_stream(stream, "outcomes", "status", NAMES).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    seen = [p["observedMetrics"]["outcomes"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(r["total"] for r in seen) == 30 and sum(r["failed"] for r in seen) == 15 and len(seen) == 3


@pytest.mark.parametrize("limit", [0.2, 0.5, 1.0])
@pytest.mark.parametrize("group_limit", [30, 5000])
def test_suppression_from_sql(spark, limit, group_limit):
    rng, rows = random.Random(3), []
    for image, n in (("a", 80), ("b", 12), (None, 9)):
        for i in range(n):
            x, y = rng.randint(0, 60), rng.randint(0, 60)
            rows.append((image, i, float(x), float(y), float(x + rng.choice([5, 20, 30])), float(y + rng.choice([5, 20])), float(rng.randint(1, 6))))
    df = spark.createDataFrame(rows, "image string, ord int, x1 double, y1 double, x2 double, y2 double, score double").where("image is not null or ord < 9")
    named = df.where("image is not null")
    ids = lambda out: sorted((r["image"] or "", r["ord"]) for r in out.collect())
    assert ids(boxes.suppressed_by_sql(named, ["image"], CORNERS, "score", "ord", limit, group_limit)) == ids(boxes.nms(named, ["image"], CORNERS, "score", "ord", limit))
