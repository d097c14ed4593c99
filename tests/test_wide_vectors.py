"""Sums of vectors with many dimensions: blocks of dimensions against numpy, and how long they take."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.catalog import vector_roles as R
from lensfold.catalog.roles import Tables
from lensfold.catalog.vector_queries import TWO
from lensfold.operators import centroids as C
from lensfold.plans import identity


@pytest.mark.parametrize("dim", [64, 65, 130, 512])
def test_means_equal_numpy(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(int(k), None if k == 3 else f"n{k % 2}", v.tolist() if i % 11 else None, float(i % 4)) for i, (k, v) in enumerate(zip(rng.integers(0, 5, 300), rng.normal(size=(300, dim))))]
    df = spark.createDataFrame(rows, "k int, name string, v array<double>, w double").repartition(6)
    out = {(r["k"], r["name"]): r for r in C.weighted_unit_mean(df, ["k", "name"], "v", "w", empty="null", dim=dim).collect()}
    for k in range(5):
        own = [(np.array(v), w) for a, _, v, w in rows if a == k and v is not None and w > 0]
        mean = sum(v * w for v, w in own)
        r = out[k, None if k == 3 else f"n{k % 2}"]
        assert np.allclose(r["centroid"], mean / np.linalg.norm(mean), atol=1e-6) and r["weight"] == sum(w for _, w in own)


def test_other_lengths_fail(spark):
    df = spark.createDataFrame([("k", [1.0] * 100), ("k", [1.0] * 99)], "k string, v array<double>")
    with pytest.raises(Exception, match="must have 100 components"):
        C.weighted_unit_mean(df, ["k"], "v", dim=100).collect()


def test_wide_vectors_take_little_longer(spark, tmp_path):
    """Eight times as many numbers; the plan is not one sum a dimension."""
    seconds = {}
    for dim in (64, 512):
        path = str(tmp_path / str(dim))
        spark.range(20_000).select((F.col("id") % 50).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("v")).write.parquet(path)
        run = lambda: C.weighted_unit_mean(spark.read.parquet(path), ["k"], "v", dim=dim).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        start = time.time()
        run()
        seconds[dim] = time.time() - start
    assert seconds[512] < 4 * seconds[64] + 1, seconds


def test_resolution_by_pivots_gives_the_same_clusters(spark):
    from dataclasses import replace

    t = Tables(spark, "/root/testdata/sf0.001")
    rows = R.two_level(t).cache()
    outs = []
    for config in (TWO, replace(TWO, pivots_from=0)):
        out = identity.resolve(rows, None, config)
        outs.append({(r["part"], r["id"]): r["cluster_id"] for r in out.members.collect()})
    assert outs[0] == outs[1] and any(outs[0].values())
