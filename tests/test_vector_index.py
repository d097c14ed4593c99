"""Index search and pivots against the exact block path, and how many pairs they look at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.operators import pivots, vector_index
from lensfold.operators import similarity as S
from lensfold.operators.components import dbscan

SCHEMA = "part int, id string, v array<double>"


def planted(groups, size, dim, spread, seed=1):
    """Unit vectors around ``groups`` centres: cosine about 1 / (1 + spread^2) inside a group."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.repeat(centres, size, axis=0) + spread * rng.normal(size=(groups * size, dim)) / np.sqrt(dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frame(spark, rows, part=0):
    return spark.createDataFrame([(part, f"v{i:06d}", r.tolist()) for i, r in enumerate(rows)], SCHEMA).repartition(8).cache()


def recall_of(spark, targets, queries, k, threshold, **options):
    found = vector_index.indexed_topk(queries, targets, "id", "v", ["part"], k, threshold, **options).collect()
    want = S.topk_search(queries, targets, "id", "v", ["part"], k, threshold).collect()
    got = {(r.part, r.src, r.dst): r.score for r in found}
    both = [(r.score, got[r.part, r.src, r.dst]) for r in want if (r.part, r.src, r.dst) in got]
    assert all(abs(a - b) < 1e-11 for a, b in both) and all(r.score >= threshold for r in found)
    return len(both) / len(want), found, want


def test_recall_beside_the_exact_search(spark):
    """Also where the best targets are hardly above the threshold."""
    for spread, threshold in ((0.5, 0.55), (0.85, 0.55)):
        targets = frame(spark, planted(400, 10, 64, spread))
        queries = targets.where("id like '%7'")
        recall, *_ = recall_of(spark, targets, queries, 5, threshold)
        assert recall >= 0.95, (spread, recall)


def test_few_targets_are_searched_exactly(spark):
    few, many = frame(spark, planted(40, 12, 16, 0.9)), frame(spark, planted(60, 10, 16, 0.9), 1)
    _, found, want = recall_of(spark, few, few, 4, 0.3)
    assert sorted(found) == sorted(want)
    both = few.unionAll(many)
    recall, found, want = recall_of(spark, both, both, 4, 0.6)
    assert recall >= 0.95 and sorted(r for r in found if r.part == 0) == sorted(r for r in want if r.part == 0)


def test_equal_targets_go_to_the_smallest_id_and_dense_buckets_are_cut(spark):
    rows = np.concatenate([np.tile(planted(1, 1, 16, 0)[0], (700, 1)), planted(30, 10, 16, 0.4, 5)])
    targets = frame(spark, rows)
    found = vector_index.indexed_topk(targets.where("id = 'v000003'"), targets, "id", "v", ["part"], 3, 0.9, block=50).orderBy("rank").collect()
    assert [r.dst for r in found] == ["v000000", "v000001", "v000002"]


def test_work_grows_slower_than_targets(spark):
    compared = []
    for groups in (250, 2500):
        targets = frame(spark, planted(groups, 8, 32, 0.4))
        queries = targets.where("id < 'v000200'")
        compared.append(vector_index.comparisons(queries, targets, "id", "v", ["part"], 0.8, 500).first().compared)
    assert compared[1] < 6 * compared[0] and compared[1] < 0.3 * 200 * 20_000


@pytest.mark.parametrize(("threshold", "bits"), [(0.55, 8), (0.8, 11), (0.95, 16)])
def test_scheme_keeps_its_promise(threshold, bits):
    """Fresh pairs at the threshold, in 48 dimensions, meet as often as promised."""
    tables, probes = vector_index.scheme(bits, threshold)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1500, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    met = np.zeros(len(a), bool)
    sets = vector_index.flips(bits)
    for plane in vector_index.planes(tables, 48)[:, :bits]:
        x, y = a @ plane.T, b @ plane.T
        apart = ((x < 0) != (y < 0)).astype(float)
        order = np.argsort((x**2) @ sets.T, axis=1, kind="stable")[:, :probes]
        met |= (sets[order] == apart[:, None, :]).all(axis=2).any(axis=1)
    assert met.mean() >= vector_index.RECALL - 0.02


@pytest.mark.parametrize(("near", "m"), [(0.55, 1), (0.8, 1), (0.8, 4)])
def test_pivots_give_the_labels_of_the_blocks(spark, near, m):
    """Tight groups, loose rows, zero vectors and copies; a second key that stays whole."""
    rows = np.concatenate([planted(30, 20, 24, 0.45), planted(200, 1, 24, 0, 7), np.zeros((3, 24)), planted(1, 1, 24, 0, 8).repeat(9, axis=0)])
    df = frame(spark, rows).unionAll(frame(spark, rows[::7], 1))
    labels = [{(r.part, r.id): r.label for r in dbscan(df, "id", "v", ["part"], 1 - near, m, block=b, pivots_from=p).collect()} for b, p in ((2000, 10**9), (64, 500))]
    assert labels[0] == labels[1] and len(set(labels[0].values())) > 30


def test_pieces_hold_every_pair_once(spark):
    rows = np.concatenate([planted(25, 16, 16, 0.7), planted(150, 1, 16, 0, 3)])
    df = frame(spark, rows)
    cut = pivots.pieces(df, "id", "v", ["part"], 0.7, 16, pivots_from=0)
    near = {(f"v{i:06d}", f"v{j:06d}") for i, j in zip(*np.nonzero(np.triu(rows @ rows.T >= 0.7, 1)))}
    home, visitors, far = ({} for _ in range(3))
    for r in cut.home.collect():
        home.setdefault(r._cell, {False: [], True: []})[r._outer].append(r.id)
    for r in cut.visitors.collect():
        visitors.setdefault((r._cell, r._outer), []).append(r.id)
    cells = [c[False] + c[True] for c in home.values()]
    pairs = [(a, b) for c in cells for a in c for b in c if a < b] + [tuple(sorted((a, b))) for (c, ring), v in visitors.items() for a in home[c][ring] for b in v]
    far = [r.id for r in cut.far.collect()]
    pairs += [(a, b) for a in far for b in far if a < b]
    assert len(pairs) == len(set(pairs)) == pivots.compared(cut, ["part"]).first().compared
    assert near <= set(pairs) and near


def test_planted_groups_cost_under_a_tenth(spark):
    groups, size = 100, 120
    n = groups * size
    df = frame(spark, planted(groups, size, 64, 0.3))
    cut = pivots.pieces(df, "id", "v", ["part"], 0.55, 64)
    pivots_drawn = 2 * np.sqrt(n)
    pivot_pairs = 1.2 * pivots_drawn * (n + 10 * pivots_drawn)  # rows and drawn rows beside pivots, with room for the draw
    assert pivots.compared(cut, ["part"]).first().compared + pivot_pairs < 0.1 * n * (n - 1) / 2
    found = dbscan(df, "id", "v", ["part"], 0.45)
    assert found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(f"n = {size}").count() == groups
