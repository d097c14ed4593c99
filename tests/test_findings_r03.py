"""One small test for each finding of round 3 that held."""

import numpy as np
from pyspark.sql import functions as F

from lensfold.catalog import QUERIES
from lensfold.operators import access, boxes, intervals, rollups
from lensfold.operators import similarity as S
from lensfold.operators.components import components


def test_matched_items_are_made_once(spark):
    rng = np.random.default_rng(1)
    draw = lambda n, *tops: sorted({tuple(int(rng.integers(0, t)) for t in tops) for _ in range(n)})
    members = [(p, c if c else None, i) for p, c, i in draw(300, 2, 8, 40)]
    matches = [(p, c, s, s * 2) for p, c, s in draw(60, 2, 8, 12)]
    items = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "item long")
    got = access.matched_items(
        items, spark.createDataFrame(members * 2, "part long, cluster long, item long"),
        spark.createDataFrame(matches * 2, "part long, cluster long, session long, twice long"), "item", "cluster", ["part"],
    )
    want = {(p, i, s, t) for p, c, i in members for q, d, s, t in matches if p == q and c == d and c is not None and i % 3 == 0}
    rows = [(r.part, r.item, r.session, r.twice) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in joined[: joined.index("Join Inner")], "pairs are made distinct once more"


def test_depth_of_a_deep_folder_is_whole(spark, tmp_path):
    keys = [0, *(4**i for i in range(12))]
    spark.createDataFrame([(k, "p", 1) for k in keys], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.folder_id: (r.root, r.depth, r.path) for r in QUERIES["h9_tree"](spark, str(tmp_path)).collect()}
    assert got == {k: (0, i + 1, "/".join(map(str, keys[: i + 1]))) for i, k in enumerate(keys)}


def test_spellings_move_no_words(spark):
    rows = [(1, "b,B, a,,A ,c"), (2, None), (3, " , "), (None, "x,X"), (4, "q,r"), (4, "R,Q,s"), (5, "É,é")]
    df = spark.createDataFrame(rows, "k int, text string")
    out = rollups.distinct_ignoring_case(df, ["k"], "text")
    got = sorted((str(r.k), r.pos, r.entry) for r in out.collect())
    want = [("1", 0, "b"), ("1", 2, "a"), ("1", 5, "c"), ("4", 0, "R"), ("4", 0, "q"), ("4", 2, "s"), ("5", 0, "É"), ("None", 0, "x")]
    assert got == sorted(want)
    one = rollups.spellings(df.where("k = 1"), ["k"], "text")._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("Generate posexplode") == 1 and "Join LeftAnti" in one, "the words of keys with one row are taken apart"


def test_images_of_few_boxes_are_suppressed_together(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 400)
    sizes[7] = 100
    starts = np.cumsum(sizes) - sizes
    low = rng.integers(0, 30, (sizes.sum(), 2)).astype(float)
    box = np.concatenate([low, low + rng.integers(5, 25, low.shape)], axis=1)
    want = np.concatenate([boxes._suppressed(box[a : a + n], 0.4) for a, n in zip(starts, sizes, strict=True)])
    calls, plain = [], boxes._suppressed
    monkeypatch.setattr(boxes, "_suppressed", lambda *a: calls.append(1) or plain(*a))
    got = boxes._suppressed_each(box, starts, sizes, 0.4, step=500)
    assert (got == want).all() and 0 < want.sum() < len(want) and len(calls) == 1


def test_table_function_takes_packs_of_images(spark):
    rows = [(i, o, float(o * 3), 0.0, float(o * 3 + 10), 10.0, float(o % 3)) for i in range(500) for o in range(4)]
    df = spark.createDataFrame(rows, "image long, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    out = boxes.suppressed_by_sql(df, ["image"], ["x1", "y1", "x2", "y2"], "score", "ord", 0.3)
    packs = [r.n for r in boxes._packed(df, ["image"], boxes._packs(df, ["image"], 5000)[2]).groupBy("_pack").agg(F.count("*").alias("n")).collect()]
    assert packs == [2000] and "ArrowEvalPythonUDTF" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.image, r.ord) for r in out.collect()} == {(i, o) for i in range(500) for o in (0, 2)}


def test_block_pairs_are_dealt_by_themselves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.repeat(rng.standard_normal((40, 8)), 3, axis=0) + rng.normal(0, 0.05, (120, 8))
    df = spark.createDataFrame([(0, f"p{i:03d}", x.tolist()) for i, x in enumerate(v)], "part int, id string, v array<double>")
    found = {}
    for span in (1, 3, 50):
        monkeypatch.setattr(S, "SPAN", span)
        edges = S.spanning_edges(df, "id", "v", ["part"], 0.9, 6)
        assert "RepartitionByExpression [part" in edges._jdf.queryExecution().optimizedPlan().toString()
        found[span] = {(r.id, r.comp) for r in components(df, edges, "id", ["part"]).collect()}
    assert found[1] == found[3] == found[50] and 30 <= len({c for _, c in found[1]}) <= 40


def test_table_function_of_one_image_stays(spark):
    rows = [(i, o, float(o * 3), 0.0, float(o * 3 + 10), 10.0, float(o % 3)) for i in range(3) for o in range(4)]
    df = spark.createDataFrame(rows, "image long, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    boxes.register_suppression(spark, "one_image", df, ["x1", "y1", "x2", "y2"], 0.3)
    out = spark.sql("SELECT * FROM one_image(TABLE({b}) PARTITION BY image ORDER BY (score DESC, ord))", b=df)
    assert {(r.image, r.ord) for r in out.collect()} == {(i, o) for i in range(3) for o in (0, 2)}


def _unranked(*_):
    raise AssertionError("the tour is ranked by rounds")


def test_chains_that_fit_a_pack_are_not_ranked(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_ranked", _unranked)
    chains = spark.range(3_000).select("id", F.when(F.col("id") % 15 > 0, F.col("id") - 1).alias("up"))
    labelled = intervals.labels(chains, "id", "up", small=1_000)
    place = "id % 15"
    wrong = labelled.where(f"cycle or root <> id - {place} or depth <> {place} + 1 or enter <> {place} or leave <> 14")
    assert labelled.count() == 3_000 and wrong.isEmpty()


def test_bushy_trees_leave_in_layers(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_ranked", _unranked)
    n = 3_000
    rows = spark.range(n).select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 4)).alias("up"))
    got = {r.id: (r.root, r.depth, r.enter, r.leave) for r in intervals.labels(rows, "id", "up", small=1_000).collect()}
    size = [1] * n
    for i in range(n - 1, 0, -1):
        size[i // 4] += size[i]
    want, free = {0: (0, 1, 0, n - 1)}, {0: 1}
    for i in range(1, n):
        enter = free[i // 4]
        want[i] = (0, want[i // 4][1] + 1, enter, enter + size[i] - 1)
        free[i // 4] += size[i]
        free[i] = enter + 1
    assert got == want
