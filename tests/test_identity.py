"""Scenarios of the identity plan on small hand-made vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.plans import identity, matching
from lensfold.plans.identity import ResolveConfig, apply_result, merge_small, recover_points, resolve, run_pass

DIM = 8
CONFIG = ResolveConfig(dim=DIM)
MEMBERS = "part int, id string, embedding array<double>, yaw double, pitch double, roll double, quality_passed boolean, cluster_id string, secondary_embedding array<double>"
CLUSTERS = "part int, cluster_id string, centroid array<float>, pyr_centroid array<float>, secondary_centroid array<float>, cluster_size bigint, pyr_size bigint"


def axis(i, *more):
    v = np.zeros(DIM)
    v[i] = 1.0
    for j, w in more:
        v[j] += w
    return [float(x) for x in v / np.linalg.norm(v)]


def near(v, seed):
    out = np.asarray(v) + 1e-3 * np.random.default_rng(seed).normal(size=DIM)
    return [float(x) for x in out / np.linalg.norm(out)]


def members(spark, rows, **common):
    base = {"yaw": 0.0, "pitch": 0.0, "roll": 0.0, "passed": True, "cluster": None, "second": None, **common}
    out = []
    for ident, vec, *extra in rows:
        r = {**base, **(extra[0] if extra else {})}
        out.append((0, ident, vec, r["yaw"], r["pitch"], r["roll"], r["passed"], r["cluster"], r["second"]))
    return spark.createDataFrame(out, MEMBERS)


def clusters(spark, *rows):
    return spark.createDataFrame([(0, c, cent, pose, None, size, pose_size) for c, cent, pose, size, pose_size in rows], CLUSTERS)


def table(df, *cols):
    return {r[0]: r[1:] if len(cols) > 2 else r[1] for r in df.select(*cols).collect()}


def test_three_groups_of_five(spark):
    rows = [(f"m{c}{i}", near(axis(c), 10 * c + i)) for c in range(3) for i in range(5)]
    result = run_pass(members(spark, rows), identity.empty_clusters(members(spark, rows), CONFIG.names), CONFIG, CONFIG.regular)
    changes = result.changes.collect()
    assert [c.kind for c in changes] == ["new"] * 3 and [c.cluster_size for c in changes] == [5] * 3
    assert result.assigned.count() == 15
    assert all(abs(np.linalg.norm(c.centroid) - 1) < 1e-5 for c in changes)


@pytest.mark.parametrize(("sizes", "survivor", "total"), [((10, 3), "a", 14), ((5, 5), "a", 11), ((3, 10), "b", 14)])
def test_bridge_merges_into_the_larger(spark, sizes, survivor, total):
    existing = clusters(spark, ("a", axis(0, (1, 0.3)), None, sizes[0], 0), ("b", axis(0, (2, 0.3)), None, sizes[1], 0))
    pending = members(spark, [("bridge", axis(0))])
    result = run_pass(pending, existing, CONFIG, CONFIG.regular)
    (change,) = result.changes.collect()
    assert (change.kind, change.cluster_id, change.cluster_size) == ("merged", survivor, total)
    old = members(spark, [("x", axis(0), {"cluster": "a"}), ("y", axis(0), {"cluster": "b"}), ("bridge", axis(0))])
    after, current = apply_result(existing, old.select("part", "id", "cluster_id"), result, CONFIG)
    assert {r.cluster_id for r in after.collect()} == {survivor}
    assert table(current, "id", "cluster_id") == {"x": survivor, "y": survivor, "bridge": survivor}


def test_clusters_of_other_keys_stay_out(spark):
    """Clusters merge among themselves only where new members arrive."""
    existing = clusters(spark, ("a", axis(0), None, 4, 0), ("b", axis(0), None, 4, 0)).withColumn("part", F.lit(9))
    result = run_pass(members(spark, [("m", axis(0))]), existing, CONFIG, CONFIG.regular)
    assert [(c.part, c.kind) for c in result.changes.collect()] == [(0, "new")]


def test_restricted_pass_only_grows_the_pose_centroid(spark):
    existing = clusters(spark, ("a", axis(0), None, 7, 0), ("b", axis(1), axis(1), 7, 0))
    pending = members(spark, [("m1", near(axis(0), 1)), ("m2", near(axis(1), 2)), ("alone", axis(5))])
    result = run_pass(pending, existing, CONFIG, CONFIG.restricted)
    after, current = apply_result(existing, pending.select("part", "id", "cluster_id"), result, CONFIG)
    assert table(current, "id", "cluster_id") == {"m1": "a", "m2": "b", "alone": None}
    assert table(after, "cluster_id", "cluster_size", "pyr_size") == {"a": (7, 1), "b": (7, 2)}
    assert np.allclose(table(after, "cluster_id", "centroid")["a"], axis(0))


def test_recovered_point_grows_size_and_pose(spark):
    existing = clusters(spark, ("a", axis(0), axis(3), 8, 3), ("none", axis(4), None, 5, 0))
    pending = members(spark, [("m", near(axis(3), 3)), ("far", axis(4))])
    result = recover_points(pending, existing, CONFIG)
    after, current = apply_result(existing, pending.select("part", "id", "cluster_id"), result, CONFIG)
    assert table(after, "cluster_id", "cluster_size", "pyr_size")["a"] == (9, 4)
    assert table(current, "id", "cluster_id") == {"m": "a", "far": None}
    assert np.allclose(table(after, "cluster_id", "centroid")["a"], axis(0))


def test_small_cluster_merges_by_pose(spark):
    existing = clusters(spark, ("big", axis(0), axis(3), 50, 4), ("tiny", axis(5), axis(3), 2, 2), ("other", axis(6), None, 3, 0))
    found = identity.small_matches(existing, CONFIG).collect()
    assert [(r.src, r.dst, r.channel) for r in found] == [("tiny", "big", "pyr_centroid")]
    after, _ = apply_result(existing, members(spark, []).select("part", "id", "cluster_id"), merge_small(existing, CONFIG), CONFIG)
    assert table(after, "cluster_id", "cluster_size", "pyr_size") == {"big": (52, 6), "other": (3, 0)}


def _everyone(spark):
    rows = [(f"m{c}{i}", near(axis(c), 10 * c + i), {"second": axis(7)}) for c in range(3) for i in range(4)]
    rows += [("side", near(axis(1), 77), {"yaw": 80.0}), ("back", axis(6), {"yaw": 100.0}), ("blurred", axis(0), {"passed": False}),
             ("unposed", axis(0), {"yaw": None}), ("turned", axis(0), {"yaw": 130.0})]
    return members(spark, rows)


def test_whole_plan(spark):
    out = resolve(_everyone(spark), None, CONFIG)
    owner = table(out.members, "id", "cluster_id")
    assert len({owner[f"m{c}{i}"] for c in range(3) for i in range(4)}) == 3
    assert owner["side"] == owner["m10"]
    assert [owner[k] for k in ("back", "blurred", "unposed", "turned")] == [None] * 4
    sizes = table(out.clusters, "cluster_id", "cluster_size", "pyr_size")
    assert sizes[owner["side"]] == (4, 1)
    assert all(np.allclose(v, axis(7)) for v in table(out.clusters, "cluster_id", "secondary_centroid").values())
    again = resolve(_everyone(spark), None, CONFIG)
    assert table(again.members, "id", "cluster_id") == owner


def test_batches_and_recount(spark):
    config = ResolveConfig(dim=DIM, batch_size=5, recount_sizes=True)
    out = resolve(_everyone(spark), None, config)
    assert sorted(r.cluster_size for r in out.clusters.collect()) == [4, 4, 5]


def test_match_rules(spark):
    q = spark.createDataFrame(
        [(0, "same", axis(0), axis(1)), (0, "far", axis(7), axis(1)), (0, "second_only", axis(7), axis(3)), (0, "untagged", axis(0), None), (5, "nowhere", axis(0), None)],
        "part int, query_id string, primary array<double>, secondary array<double>",
    )
    c = spark.createDataFrame(
        [(0, "agree", axis(0), axis(1)), (0, "primary", axis(0, (2, 0.5)), axis(4)), (0, "other", axis(5), axis(3))],
        "part int, cluster_id string, centroid array<double>, secondary_centroid array<double>",
    )
    hits = matching.match(q, c, "query_id", "cluster_id", ["part"])
    got = {(r.query_id, r.cluster_id): (r.rank, r.confidence) for r in hits.collect()}
    assert got == {("same", "agree"): (1, "high"), ("same", "primary"): (2, "low"), ("untagged", "agree"): (1, "high"), ("untagged", "primary"): (2, "high")}
    status = table(matching.match_status(q, c, hits, "query_id", ["part"]), "query_id", "status")
    assert status == {"same": "matched", "untagged": "matched", "far": "no_match", "second_only": "no_match", "nowhere": "no_clusters"}
    capped = matching.match(q, c, "query_id", "cluster_id", ["part"], k=1, dual=False)
    assert {r.cluster_id for r in capped.collect()} == {"agree"}
