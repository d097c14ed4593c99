"""One small test for each finding of round 4 that held."""

from dataclasses import replace

from lensfold.operators import access, components, linkage
from lensfold.plans import identity
from lensfold.session import cut_lineage


def test_pairs_of_a_cluster_lie_together(spark):
    members = [(i, (i * 7 + j * 13) % 20) for i in range(300) for j in range(3)]
    matches = [(c, c * 100 + s) for c in range(20) for s in range(5)]  # a session tells its cluster
    items = spark.createDataFrame([(i,) for i in range(300)], "item long")
    got = access.matched_items(
        items, spark.createDataFrame(members, "item long, cluster long"), spark.createDataFrame(matches, "cluster long, session long"), "item", "cluster", []
    )
    tasks = got.rdd.glom().collect()
    clusters = [[r.session // 100 for r in task] for task in tasks]
    assert any(clusters) and all(c == sorted(c) for c in clusters)
    rows = [(r.item, r.session) for task in tasks for r in task]
    assert len(rows) == 4500 and set(rows) == {(i, c * 100 + s) for i, c in members for s in range(5)}


def test_rounds_of_batches_write_what_they_use_again(spark, monkeypatch):
    """Jobs of a round are driver memory: what is used once or is empty isn't written, and what a round leaves goes before the next."""
    rows = [(p, f"{p}{i:02d}", [float(i % 2), float(1 - i % 2), 0.1 * (i % 3)], 0.0, 0.0, 0.0, True, None) for p in (0, 1) for i in range(8)]
    members = spark.createDataFrame(rows, "part int, id string, embedding array<double>, yaw double, pitch double, roll double, quality_passed boolean, cluster_id string")
    written, collected = [], []
    for module in (identity, linkage, components):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, plain=plain, name=module.__name__: written.append(name) or plain(df))
    monkeypatch.setattr(identity, "collect_garbage", lambda _: collected.append(1), raising=False)
    config = identity.ResolveConfig(dim=3, eps=0.08)
    sizes = []
    for size in (4, 8):
        out = identity.resolve(members, None, replace(config, batch_size=size))
        sizes.append((len(written), len(collected)))
        assert sorted((r.part, r.id[1:], r.n) for r in out.members.join(out.members.groupBy("part", "cluster_id").count().withColumnRenamed("count", "n"), ["part", "cluster_id"]).collect()) == [
            (p, f"{i:02d}", 4) for p in (0, 1) for i in range(8)
        ]
    two, one = sizes[0], (sizes[1][0] - sizes[0][0], sizes[1][1] - sizes[0][1])
    assert two[0] - one[0] <= 12 and (two[1], one[1]) == (4, 2)


def test_estimates_of_written_rows_stay_small(spark):
    rows = cut_lineage(spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, v long"))
    for _ in range(6):
        rows = cut_lineage(rows.join(rows.select("id", "v"), ["id", "v"], "left"))
        assert rows._jdf.queryExecution().analyzed().stats().sizeInBytes() < 1 << 63
    assert sorted(map(tuple, rows.collect())) == [(i, i % 3) for i in range(30)]
