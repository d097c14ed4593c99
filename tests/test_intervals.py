"""Interval labels against paths, on forests, chains, hubs and cycles, walked at once and by contraction."""

import random

import pytest
from pyspark.sql import functions as F

from lensfold.operators import intervals
from lensfold.operators.tree import closure, rejected_moves, subtree_rollup, tree

SCHEMA = "part int, id long, up long"


def forest(seed, n):
    rng = random.Random(seed)
    rows = []
    for part in (0, 1):
        ids = rng.sample(range(10 * n), n)
        for i, v in enumerate(ids):
            up = rng.choice([None, -5, ids[rng.randrange(i)], ids[0], ids[i - 1]]) if i else None
            rows.append((part, v, up))
    rows += [(0, 10 * n + i, 10 * n + (i + 1) % 5) for i in range(5)] + [(0, 11 * n, 10 * n)]  # a cycle and what hangs on it
    return rows


def walked(rows):
    kids, known, out = {}, {(p, v) for p, v, _ in rows}, {}
    for p, v, up in rows:
        kids.setdefault((p, up if (p, up) in known else None), []).append(v)
    for (p, up), own in list(kids.items()):
        if up is not None:
            continue
        for root in own:
            n, stack = 0, [(root, 1, False)]
            while stack:
                v, depth, done = stack.pop()
                if done:
                    out[p, v] = (*out[p, v], n - 1)
                    continue
                out[p, v] = (root, depth, n)
                n += 1
                stack.append((v, depth, True))
                stack += [(c, depth + 1, False) for c in sorted(kids.get((p, v), []), reverse=True)]
    return out


@pytest.mark.parametrize("small", [100, 10**6])
def test_labels_equal_a_walk(spark, small):
    rows = forest(small, 60)
    out = intervals.labels(spark.createDataFrame(rows, SCHEMA), "id", "up", ["part"], small).collect()
    want = walked(rows)
    assert len(out) == len(rows)
    assert {(r.part, r.id): (r.root, r.depth, r.enter, r.leave) for r in out if not r.cycle} == want
    assert {r.id for r in out if r.cycle} == {600, 601, 602, 603, 604, 660}


def test_descendants_sums_and_moves_equal_those_of_paths(spark):
    rows = forest(3, 120)
    nodes = spark.createDataFrame(rows, SCHEMA)
    labelled, paths = intervals.labels(nodes, "id", "up", ["part"]), tree(nodes, "id", "up", ["part"]).cache()
    pairs = lambda df: sorted(map(tuple, df.select("part", "ancestor", "id").collect()))
    assert pairs(intervals.descendants(labelled, "id", ["part"])) == pairs(closure(paths, "id", ["part"]))
    some = nodes.where("id % 7 = 0")
    assert pairs(intervals.descendants(labelled, "id", ["part"], some)) == pairs(closure(paths, "id", ["part"]).join(some.select("part", F.col("id").alias("ancestor")), ["part", "ancestor"]))

    per = nodes.where("id % 3 = 0").select("part", "id", (F.col("id") * 7 % 1000).alias("bytes"), F.lit(1).cast("long").alias("n"))
    sums = lambda df: sorted(map(tuple, df.select("part", "id", "bytes", "n").collect()))
    assert sums(intervals.subtree_sums(labelled, "id", per, ["bytes", "n"], ["part"])) == sums(subtree_rollup(paths, "id", per, ["bytes", "n"], ["part"]))

    rng, ids = random.Random(4), {p: [v for q, v, _ in rows if q == p and v < 1200] for p in (0, 1)}
    moves = spark.createDataFrame([(p, rng.choice(ids[p]), rng.choice(ids[p])) for p in (0, 1) for _ in range(300)], "part int, id long, target long").distinct()
    for options in ({}, {"max_depth": 12}, {"max_depth": 12, "whole_subtree": True}):
        got, want = (sorted(map(tuple, f(moves, x, "id", "target", ["part"], **options).collect())) for f, x in ((intervals.moves_below, labelled), (rejected_moves, paths)))
        assert got == want and want


def test_a_chain_of_many_nodes(spark):
    """Memory follows the nodes, not their ancestors: paths of this chain would hold five thousand million ids."""
    n = 100_000
    chain = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    labelled = intervals.labels(chain, "id", "up", small=20_000)
    wrong = labelled.where(f"enter <> id or leave <> {n - 1} or depth <> id + 1 or root <> 0 or cycle")
    assert wrong.count() == 0 and labelled.count() == n
    total = intervals.subtree_sums(labelled, "id", chain.select("id", F.lit(1).cast("long").alias("c")), ["c"])
    assert total.where(f"c <> {n} - id").count() == 0 and total.count() == n


def test_a_hub_is_not_one_task(spark):
    """All nodes but one under one parent: its children are numbered over slices."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") > 0, F.lit(0)).alias("up"))
    labelled = intervals.labels(rows, "id", "up", small=5_000)
    assert labelled.where("enter <> id or (id > 0 and leave <> id)").count() == 0
