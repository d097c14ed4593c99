"""Vector kernel against brute force, with blocks small enough that every key spans several."""

import numpy as np
import pytest

from lensfold.operators import similarity as S
from lensfold.operators.centroids import weighted_unit_mean
from lensfold.operators.components import components, dbscan
from lensfold.operators.linkage import average_linkage

DIM = 6


def _points(seed, n, spread=0.5, centres=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, DIM))
    return base[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, DIM))


def _frame(spark, points, parts=2):
    rows = [(i % parts, f"v{i:03d}", [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "part int, id string, v array<double>"), rows


def _unit(x):
    x = np.asarray(x)
    n = np.linalg.norm(x)
    return x / n if n else x


def _cos(a, b):
    return float(_unit(a) @ _unit(b))


def test_pairs_match_brute_force(spark):
    df, rows = _frame(spark, _points(1, 60))
    got = {(r.src, r.dst): r.score for r in S.self_pairs(df, "id", "v", ["part"], 0.6, block=7).collect()}
    want = {(a[1], b[1]): _cos(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and _cos(a[2], b[2]) >= 0.6}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    cross = S.similarity_join(df, df, "id", "v", ["part"], 0.6, block=9).where("src < dst").collect()
    assert {(r.src, r.dst) for r in cross} == want.keys()


def test_zero_vector_scores_zero(spark):
    df = spark.createDataFrame([(0, "a", [0.0, 0.0]), (0, "b", [1.0, 0.0])], "part int, id string, v array<double>")
    assert {(r.src, r.dst): r.score for r in S.self_pairs(df, "id", "v", ["part"], -1.0).collect()} == {("a", "b"): 0.0}


def test_topk_ties_go_to_smallest_id(spark):
    q = spark.createDataFrame([(0, "q", [1.0, 0.0])], "part int, id string, v array<double>")
    t = spark.createDataFrame(
        [(0, f"t{i}", [2.0, 0.0]) for i in range(9)] + [(0, "x", [0.0, 1.0]), (1, "far", [1.0, 0.0])],
        "part int, id string, v array<double>",
    )
    for block in (3, 100):
        hits = S.topk_search(q, t, "id", "v", ["part"], 3, 0.5, block).orderBy("rank").collect()
        assert [r.dst for r in hits] == ["t0", "t1", "t2"]
        assert [r.dst for r in S.topk_search(q, t, "id", "v", ["part"], 1, 0.5, block).collect()] == ["t0"]


def test_channels(spark):
    schema = "part int, id string, m array<double>, a array<double>"
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    left = spark.createDataFrame([(0, "main", x, None), (0, "cross", y, None), (0, "pose", z, y)], schema)
    right = spark.createDataFrame([(0, "t", x, y)], schema)
    got = {r.src: r.channel for r in S.max_channel_similarity(left, right, "id", "m", "a", ["part"], 0.9).collect()}
    assert got == {"main": "centroid", "cross": "centroid_vs_pyr", "pose": "pyr_centroid"}
    # the pose vector of the source is never compared with the main vector of the target
    left = spark.createDataFrame([(0, "s", z, x)], schema)
    right = spark.createDataFrame([(0, "t", x, None)], schema)
    assert S.max_channel_similarity(left, right, "id", "m", "a", ["part"], 0.5).count() == 0


def _brute_components(rows, near):
    label = {r[1]: r[1] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[0] == b[0] and _cos(a[2], b[2]) >= near and label[b[1]] < label[a[1]]:
                    label[a[1]] = label[b[1]]
                    changed = True
    return label


@pytest.mark.parametrize("block", [5, 1000])
def test_density_components(spark, block):
    points = _points(3, 50, spread=0.35, centres=6)
    points[10:16] = points[10]  # exact copies
    df, rows = _frame(spark, points)
    got = {r.id: r.label for r in dbscan(df, "id", "v", ["part"], 0.12, block=block).collect()}
    assert got == _brute_components(rows, 0.88)


def test_density_with_noise_and_border(spark):
    df, rows = _frame(spark, _points(5, 50, spread=0.4, centres=5))
    near, m = 0.9, 4
    got = {r.id: r.label for r in dbscan(df, "id", "v", ["part"], 1 - near, min_samples=m, block=11).collect()}
    reach = {a[1]: [b for b in rows if a[0] == b[0] and _cos(a[2], b[2]) >= near] for a in rows}
    core = [r for r in rows if len(reach[r[1]]) >= m]
    want = _brute_components(core, near)
    for r in rows:
        if r[1] not in want or r not in core:
            want[r[1]] = min((want[c[1]] for c in core if c in reach[r[1]]), default=None)
    assert got == want and None in got.values()


def test_long_chain_of_edges(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n)
    nodes = spark.createDataFrame([(0, int(i)) for i in range(n)], "part int, id int")
    edges = spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(order, order[1:])], "part int, src int, dst int")
    assert components(nodes, edges, "id", ["part"]).where("comp <> 0").count() == 0


def _greedy_linkage(rows, limit):
    groups = [[r] for r in sorted(rows, key=lambda r: r[1])]
    while True:
        best = None
        for i, a in enumerate(groups):
            for j in range(i + 1, len(groups)):
                b = groups[j]
                d = np.mean([1 - _cos(x[2], y[2]) for x in a for y in b])
                if d < limit and (best is None or d < best[0] - 1e-12):
                    best = (d, i, j)
        if best is None:
            return {r[1]: min(x[1] for x in g) for g in groups for r in g}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize(("seed", "block"), [(7, 9), (8, 1000), (9, 1000)])
def test_average_linkage_equals_greedy(spark, seed, block):
    df, rows = _frame(spark, _points(seed, 40, spread=0.7, centres=5))
    got = {r.id: r.group for r in average_linkage(df, "id", "v", ["part"], 0.45, block=block).collect()}
    want = {}
    for part in (0, 1):
        want |= _greedy_linkage([r for r in rows if r[0] == part], 0.45)
    assert got == want


def test_weighted_mean_rules(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 0.0], 3), ("a", [0.0, 1.0], 1), ("z", [1.0, 0.0], 1), ("z", [-1.0, 0.0], 1)], "k string, v array<double>, w int"
    )
    got = {r.k: r.centroid for r in weighted_unit_mean(df, ["k"], "v", "w", dim=2).collect()}
    assert np.allclose(got["a"], _unit([3, 1]), atol=1e-6) and got["z"] == [0.0, 0.0]
    assert {r.k: r.centroid for r in weighted_unit_mean(df, ["k"], "v", "w", empty="null", dim=2).collect()}["z"] is None
    with pytest.raises(Exception, match="positive"):
        weighted_unit_mean(df.selectExpr("k", "v", "0 as w"), ["k"], "v", "w", dim=2).collect()
