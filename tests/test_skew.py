"""Joins and components with a key that has most rows: same answers, even tasks."""

import pytest
from pyspark.sql import functions as F

from lensfold.operators import skew
from lensfold.operators.components import components
from lensfold.session import cut_lineage


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_a_join(spark, how):
    rows = cut_lineage(spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(F.col("id") % 40).alias("k"), "id"))
    table = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for size in (9000, 10):
        assert sorted(skew.lookup(rows, table, ["k"], size, how).collect(), key=str) == sorted(rows.join(table, ["k"], how).collect(), key=str)


def test_heavy_keys_are_not_shuffled(spark):
    rows = cut_lineage(spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 4 > 0, F.lit(5)).otherwise(F.col("id") % 900).alias("k"), "id"))
    out = skew.lookup(rows, spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("v")), ["k"], 40_000)
    assert out.count() == 40_000
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 12_000  # one task would have 30,000


def test_components_of_a_star_and_a_chain(spark):
    """A hub that meets most edges, and long chains that end in it."""
    n = 60_000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(n, n + 3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    alone = spark.range(n + 10_000, n + 10_040).select(F.col("id").alias("src"), (F.col("id") + 100).alias("dst"))
    edges = star.union(chain).union(alone)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    found = components(nodes, edges, "id", [], small=1000)
    sizes = {r["comp"]: r["n"] for r in found.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: n, n: 3001, **{n + 10_000 + i: 2 for i in range(40)}}
