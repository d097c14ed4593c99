"""Results that must not depend on how many rows there are or where they lie."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold import session
from lensfold.operators import boxes, centroids, metrics, similarity, sliced
from lensfold.operators.components import components
from lensfold.operators.linkage import average_linkage
from lensfold.operators.tree import closure, rejected_creates, rejected_moves, tree

CORNERS = ["x1", "y1", "x2", "y2"]


def _iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]) + 1)
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    area = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
    return w * h / (area(a) + area(b) - w * h)


def _boxes(seed):
    rng = random.Random(seed)
    out = [(63.0, 10.0, 63.9, 20.0), (64.0, 10.0, 64.9, 20.0)]
    for _ in range(60):
        x, y = rng.choice([0, 31, 62, 63, 63.5, 64, 127, 128]), rng.choice([0, 40, 63, 64])
        out.append((x, y, x + rng.choice([0.5, 1, 30, 64]), y + rng.choice([1, 8, 64])))
    out += out[5:15]
    return [(0, i, *map(float, b), float(rng.randint(1, 9))) for i, b in enumerate(out)]


@pytest.mark.parametrize("cell", [16, 64, 1000])
def test_grid_join_equals_all_pairs(spark, cell):
    rows = _boxes(1)
    df = spark.createDataFrame(rows, "image int, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {(r["first"], r["second"]) for r in boxes.overlapping(df, ["image"], "ord", CORNERS, 0.2, cell).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and _iou(a[2:6], b[2:6]) > 0.2}


@pytest.mark.parametrize("limit", [0.2, 0.5, 1.0])
@pytest.mark.parametrize("group_limit", [3, 5000])
def test_suppression_on_both_paths(spark, limit, group_limit):
    rows = _boxes(2)
    df = spark.createDataFrame(rows, "image int, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(_iou(k[2:6], r[2:6]) <= limit for k in kept):
            kept.append(r)
    got = {r.ord for r in boxes.nms(df, ["image"], CORNERS, "score", "ord", limit, group_limit=group_limit, cell=64).collect()}
    assert got == {r[1] for r in kept}


def test_suppression_step_does_not_matter():
    box = np.array([r[2:6] for r in sorted(_boxes(3), key=lambda r: (-r[6], r[1]))])
    whole = boxes._suppressed(box, 0.3)
    assert all((boxes._suppressed(box, 0.3, step=n) == whole).all() for n in (1, 7, 64))


@pytest.mark.parametrize("seed", range(4))
def test_linkage_of_ties_in_one_block_and_in_many(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-1, 2, size=(24, 4)).astype(float)
    v[(v == 0).all(axis=1)] = 1
    df = spark.createDataFrame([(0, f"p{i:03d}", r.tolist()) for i, r in enumerate(v)], "part int, id string, v array<double>")
    one, many = ({r.id: r.group for r in average_linkage(df, "id", "v", ["part"], 0.45, block=b).collect()} for b in (2000, 6))
    assert one == many


def test_deep_trees(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 201)] + [(500 + i, 500 + (i + 1) % 40) for i in range(40)] + [(600, 510)]
    paths = tree(spark.createDataFrame(chain, "id long, up long"), "id", "up").cache()
    rows = {r.id: r for r in paths.collect()}
    assert rows[200].root == 1 and rows[200].path == list(range(1, 201)) and rows[200].depth == 10
    assert all(rows[i].cycle and rows[i].root is None for i in [*range(500, 540), 600])
    assert closure(paths, "id").where("ancestor = 1").count() == 200
    moves = spark.createDataFrame([(1, 200), (150, 3), (3, 150), (600, 9), (5, 9)], "id long, target long")
    assert {(r.id, r.target) for r in rejected_moves(moves, paths, "id", "target").collect()} == {(1, 200), (3, 150), (5, 9)}


def test_depth_rule(spark):
    paths = tree(spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 11)] + [(20, None), (21, 20), (22, 21)], "id long, up long"), "id", "up")
    moves = spark.createDataFrame([(20, 7), (20, 8), (20, 9), (20, 10), (22, 9)], "id long, target long")
    rule = lambda **k: {(r.id, r.target) for r in rejected_moves(moves, paths, "id", "target", max_depth=10, **k).collect()}
    assert rule() == {(20, 10)}
    assert rule(whole_subtree=True) == {(20, 8), (20, 9), (20, 10)}
    new = spark.createDataFrame([("a", 9), ("b", 10), ("c", None)], "name string, up long")
    assert [r.name for r in rejected_creates(new, paths, "id", "up").collect()] == ["b"]


def test_mixed_lengths_fail(spark):
    df = spark.createDataFrame([("k", 1, [1.0, 0.0]), ("k", 2, [0.0, 1.0, 5.0])], "k string, id int, v array<double>")
    with pytest.raises(Exception, match="must have 2 components"):
        centroids.weighted_unit_mean(df, ["k"], "v", dim=2).collect()
    with pytest.raises(ValueError, match="different lengths"):
        centroids.vector_dim(df, "v")
    with pytest.raises(Exception, match="different lengths"):
        similarity.self_pairs(df, "id", "v", ["k"], 0.1).collect()
    with pytest.raises(Exception, match="different lengths"):
        similarity.similarity_join(df.where("id = 1"), df.where("id = 2"), "id", "v", ["k"], 0.1).collect()


def test_channels_with_missing_vectors(spark):
    left = spark.createDataFrame([("k", 1, [1.0, 0.0], [0.6, 0.8]), ("k", 2, [1.0, 0.0], None)], "k string, id int, m array<double>, a array<double>")
    right = spark.createDataFrame([("k", 7, [0.8, 0.6], [0.6, 0.8]), ("k", 8, [1.0, 0.0], None)], "k string, id int, m array<double>, a array<double>")
    got = {(r.src, r.dst): (round(r.score, 6), r.channel) for r in similarity.max_channel_similarity(left, right, "id", "m", "a", ["k"], 0.0).collect()}
    assert got == {(1, 7): (1.0, "pyr_centroid"), (1, 8): (1.0, "centroid"), (2, 7): (0.8, "centroid"), (2, 8): (1.0, "centroid")}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_sliced_operators_read_their_input_twice_at_most(spark, tmp_path):
    """Once for the range boundaries, once for the rows; everything after runs on the written slices."""
    path = str(tmp_path / "log")
    spark.range(500).selectExpr("id % 3 as key", "timestamp_seconds(1700000000 + id * 60) as ts", "id", "id % 5 = 0 as ok").write.parquet(path)
    log = spark.read.parquet(path)
    plan = metrics.attempts(log, ["key"], "ts", "id", "ok", 300, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # both scans ran before, eagerly


def test_a_burst_is_split(spark):
    """All rows of a key within one second still fall into several slices."""
    rows = spark.range(4000).selectExpr("0 as key", "timestamp_micros(1700000000000000 + id * 100) as ts", "id", "id % 7 = 0 as ok").repartition(4)
    sliced_rows = sliced.range_slice(rows, ["key"], ["ts", "id"], 6)
    sizes = [r["count"] for r in sliced_rows.groupBy(sliced.SLICE).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2000


@pytest.mark.parametrize("small", [0, 5, 10_000])
def test_components_in_rounds_and_in_one_task(spark, small):
    rng = random.Random(small)
    edges = [(i % 2, f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for i in range(110)]
    nodes = sorted({(p, v) for p, a, b in edges for v in (a, b)} | {(0, "alone")})
    label = {n: n[1] for n in nodes}
    for _ in nodes:
        for p, a, b in edges:
            label[p, a] = label[p, b] = min(label[p, a], label[p, b])
    found = components(spark.createDataFrame(nodes, "part int, id string"), spark.createDataFrame(edges, "part int, src string, dst string"), "id", ["part"], small)
    assert {(r.part, r.id): r.comp for r in found.collect()} == label
