"""Relational operators on the documented fixtures, and the paths that only heavy keys take."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.functions import scalars as X
from lensfold.operators import boxes, gates, listing, metrics, rollups, runs, sliced
from lensfold.operators.tree import rejected_moves, subtree_rollup, tree
from lensfold.plans import lifecycle
from lensfold.sources import export, ingest, metrics as samples, snapshots
from lensfold.sources.tables import inventory, scan

T0 = dt.datetime(2024, 1, 1)


def _log(spark):
    rows = [("p0", "s0", "view")] * 3 + [("p0", "s0", "download"), ("p1", "s1", "view"), ("p1", "s1", "download"), ("p1", "s1", "download")]
    return spark.createDataFrame([("e", *r) for r in rows], "event_id string, photo_id string, session_id string, action string")


def _sessions(spark):
    return spark.createDataFrame(
        [("e", "s0", "Ann", "1", True, T0, 5), ("e", "s1", "Bob", "2", True, T0 + dt.timedelta(days=1), 7), ("e", "s2", "Eve", "3", False, T0, 0)],
        "event_id string, session_id string, name string, phone string, verified boolean, created_at timestamp, matched int",
    )


def test_summary_top_and_leads(spark, tmp_path):
    (s,) = rollups.event_summary(_log(spark), _sessions(spark), "event_id").collect()
    assert (s.guests, s.views, s.downloads, s.engagement) == (2, 4, 3, 2.0)
    photos = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "photo_id string")
    assert [(r.photo_id, r.views) for r in listing.top_items(photos, _log(spark), "photo_id").collect()] == [("p0", 3), ("p1", 1), ("p2", 0)]
    assert [r.photo_id for r in listing.top_items(photos, _log(spark), "photo_id", "downloads").collect()][:2] == ["p1", "p0"]
    leads = listing.leads(_sessions(spark), _log(spark), "session_id", {"guest_name": "name", "downloads": "downloads"}, "downloads", "desc")
    assert [(r.name, r.downloads) for r in leads.collect()] == [("Bob", 2), ("Ann", 1)]
    rows = export.lead_rows(leads, "name", "phone", "created_at", "matched", "downloads", "session_id")
    export.write_leads_csv(rows.coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_text().splitlines() == [
        "Name,Phone,First Visited,Photos Matched,Photos Downloaded", "Bob,2,2024-01-02T00:00:00,7,2", "Ann,1,2024-01-01T00:00:00,5,1",
    ]


def test_half_even_and_zero(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (4, 0)], "n int, d int")
    assert [r.s for r in df.select(rollups.share(F.col("n"), F.col("d")).alias("s")).collect()] == [0.12, 0.38, 0.0]


def test_storage_and_due(spark):
    owners = spark.createDataFrame([("o", 10_000_000), ("idle", 5)], "owner string, limit_bytes long")
    parents = spark.createDataFrame([("a", "o", "ready"), ("b", "o", "archived")], "event string, owner string, status string")
    items = spark.createDataFrame([("a", 1_000_000), ("b", 2_000_000)], "event string, size long")
    got = {r.owner: (r.active_bytes, r.archived_bytes, r.used_bytes, r.percent) for r in rollups.storage_breakdown(owners, parents, items, "owner", "event", "size").collect()}
    assert got == {"o": (1_000_000, 2_000_000, 3_000_000, 30.0), "idle": (0, 0, 0, 0.0)}
    events = spark.createDataFrame([("x", T0, "ready"), ("y", T0, "processing"), ("z", T0 + dt.timedelta(days=9), "ready")], "id string, at timestamp, status string")
    assert [r.id for r in gates.due(events, "at", F.lit(T0 + dt.timedelta(days=1)), "status").collect()] == ["x"]


def test_status_rules(spark):
    counts = spark.createDataFrame([("done", 2, 2, 0), ("faces", 2, 2, 1), ("arch", 2, 2, 0), ("run", 2, 1, 0)], "e string, total long, terminal long, pending long")
    old = spark.createDataFrame([("done", "uploading"), ("faces", "uploading"), ("arch", "archived"), ("run", "processing"), ("none", "ready")], "e string, status string")
    got = {r.e: (r.new_status, r.became_ready) for r in rollups.derive_status(counts, old, "e").collect()}
    assert got == {"done": ("ready", True), "faces": ("uploading", False), "arch": ("archived", False), "run": ("processing", False), "none": ("draft", False)}


def test_bands(spark):
    regular = [(1, 10.0, -20.0, 30.0), (2, 47.0, 10.0, 10.0), (3, 60.0, 10.0, 10.0), (4, None, 10.0, 10.0)]
    restricted = [(1, 47.0, 10.0, 10.0), (2, 10.0, 90.0, 10.0), (3, 10.0, 10.0, 10.0), (4, 130.0, 10.0, 10.0)]
    schema, angles = "id int, y double, p double, r double", ["y", "p", "r"]
    assert [r.id for r in gates.band_filter(spark.createDataFrame(regular, schema), angles, 0, 47).collect()] == [1]
    assert [r.id for r in gates.band_filter(spark.createDataFrame(restricted, schema), angles, 47, 120, "restricted").collect()] == [1, 2]


def test_quality_gate_order(spark):
    rows = [(1, 0.9, 90.0, 1, 0.0), (2, 0.1, 50.0, 1, 0.0), (3, 0.1, 0.0, 4, 0.9), (4, 0.5, 45.0, 5, 0.9), (5, None, None, 200, None), (6, 0.1, None, 30, 0.5)]
    df = spark.createDataFrame(rows, "id int, blur double, yaw double, age int, sun double").withColumns({"pitch": F.lit(0.0), "roll": F.lit(0.0)})
    cols = {"blur": "blur", "yaw": "yaw", "pitch": "pitch", "roll": "roll", "age": "age", "sunglasses": "sun"}
    got = {r.id: r.quality for r in gates.quality_gate(df, cols).collect()}
    assert [got[i].reject_reason for i in range(1, 7)] == ["blur", "ypr", "age", None, None, None]
    assert got[1].yaw is None and got[1].age is None and got[2].age is None and got[3].age == 4 and got[5].age is None
    assert not got[3].has_sunglasses and got[4].has_sunglasses and got[6].has_sunglasses
    relaxed = gates.quality_gate(df, cols, gates.QualityLimits(yaw=95.0), skip=["age"])
    assert {r.id: r.quality.reject_reason for r in relaxed.collect()}[3] is None


def test_tree_rules(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (10, 11), (11, 10), (12, 10)], "id int, parent int")
    paths = tree(nodes, "id", "parent")
    got = {r.id: (r.root, r.depth, r.cycle) for r in paths.collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [(1, 1, False), (1, 2, False), (1, 3, False), (4, 1, False)]
    assert all(got[i][2] for i in (10, 11, 12))
    counts = spark.createDataFrame([(2, 5), (3, 1)], "id int, photos long")
    assert {r.id: r.photos for r in subtree_rollup(paths, "id", counts, ["photos"]).collect()} == {1: 6, 2: 6, 3: 1}
    moves = spark.createDataFrame([(2, 3), (3, 1), (1, 1)], "id int, target int")
    assert {(r.id, r.target) for r in rejected_moves(moves, paths, "id", "target").collect()} == {(2, 3), (1, 1)}
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(14)], "id int, parent int")
    assert max(r.depth for r in tree(deep, "id", "parent").collect()) == 10


def test_sliced_windows_equal_plain_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), T0 + dt.timedelta(seconds=int(s)), i, float(v) if v > 3 else None) for i, (k, s, v) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 90_000, 200), rng.integers(0, 10, 200)))]
    df = spark.createDataFrame(rows, "k int, ts timestamp, id int, v double")
    s = sliced.time_slice(df, "ts", 3600)
    order = ["ts", "id"]
    out = sliced.running_sum(s, ["k"], order, F.lit(1), "n")
    out = sliced.previous_value(out, ["k"], order, "v", "prev")
    out = sliced.last_known(out, ["k"], order, F.col("v"), "seen")
    plain = df.selectExpr(
        "id", "count(*) over (partition by k order by ts, id) n", "lag(v) over (partition by k order by ts, id) prev",
        "last(v, true) over (partition by k order by ts, id rows between unbounded preceding and current row) seen",
    )
    assert set(map(tuple, out.select("id", "n", "prev", "seen").collect())) == set(map(tuple, plain.collect()))
    ranked = sliced.position(df, ["k"], order, "rank", slices=7)
    want = df.selectExpr("id", "row_number() over (partition by k order by ts, id) r")
    assert set(map(tuple, ranked.select("id", "rank").collect())) == set(map(tuple, want.collect()))


@pytest.mark.parametrize("limit", [5000, 10])
def test_nms_heavy_image(spark, limit):
    rng = np.random.default_rng(6)
    xy = rng.integers(0, 120, (60, 2))
    rows = [(i % 2, i, float(x), float(y), float(x + 30), float(y + 40), float(rng.integers(1, 20)) / 20) for i, (x, y) in enumerate(xy)]
    rows += [(0, 100 + i, *rows[0][2:6], 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, "image int, ord int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {(r.image, r.ord) for r in boxes.nms(df, ["image"], ["x1", "y1", "x2", "y2"], "score", "ord", 0.3, group_limit=limit, cell=25).collect()}
    want = set()
    for image in (0, 1):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[6], r[1])):
            def overlap(a, b):
                w, h = (max(0, min(a[i + 2], b[i + 2]) - max(a[i], b[i]) + 1) for i in (2, 3))
                return w * h / (2 * 31 * 41 - w * h)
            if all(overlap(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(image, r[1]) for r in kept}
    assert got == want


def test_rate_limit_fixture(spark):
    at = [0.0, 0.1, 0.2, 0.3, 1.35]
    df = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s)) for s in at], "key string, ts timestamp")
    got = metrics.sliding_limit(df, ["key"], "ts", 1, 3).orderBy("ts").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True]


def test_sliding_count_with_ties(spark):
    at = [0, 1, 1, 1, 4, 5, 9, 9]
    df = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s)) for s in at], "key string, ts timestamp")
    got = {int(r.us - 1704067200_000_000) // 1_000_000: r.in_window for r in sliced.sliding_count(df, ["key"], "ts", 4, slice_seconds=2).collect()}
    assert got == {t: sum(t - 4 < x <= t for x in at) for t in set(at)}


def test_watch_fixture(spark):
    df = spark.createDataFrame([("a", "start", T0), ("b", "start", T0), ("b", "heartbeat", T0 + dt.timedelta(hours=3)), ("c", "heartbeat", T0), ("c", "start", T0 + dt.timedelta(minutes=170))], "job string, kind string, ts timestamp")
    at = lambda m: {r.job: r.verdict for r in metrics.watch(df, ["job"], "ts", "kind", F.lit(T0 + dt.timedelta(minutes=m))).collect()}
    assert at(0)["a"] == "recover" and at(29)["a"] == "recover" and at(30)["a"] == "reverted"
    assert at(180) == {"a": "reverted", "b": "healthy", "c": "recover"}


def test_idle_and_alert_edges(spark):
    busy = [True, False, False, False, False, True, False]
    df = spark.createDataFrame([("r", T0 + dt.timedelta(minutes=5 * i), i, b) for i, b in enumerate(busy)], "resource string, ts timestamp, id int, busy boolean")
    (first, last) = runs.idle(df, ["resource"], "ts", "id", F.col("busy"), 600).orderBy("started").collect()
    assert first.fired_at == T0 + dt.timedelta(minutes=15) and last.fired_at is None
    minutes = [*range(0, 8), *range(9, 22)]
    cpu = spark.createDataFrame([("h", T0 + dt.timedelta(minutes=m), m, 81.0 if m != 20 else 80.0) for m in minutes], "host string, ts timestamp, id int, v double")
    (alert,) = runs.sustained(cpu, ["host"], "ts", "id", F.col("v") > 80).collect()
    assert (alert.started, alert.fired_at) == (T0 + dt.timedelta(minutes=9), T0 + dt.timedelta(minutes=19))


def test_scalar_edges(spark):
    df = spark.createDataFrame([("Élan Café  2024!", "+919876543210", "ab@x.io"), ("---", "+91987654321", "someone@mail.org"), ("x", "9876543210", "short")], "t string, p string, c string")
    r = df.select(X.slug("t").alias("s"), X.national_number("p").alias("n"), X.mask_contact("c").alias("m"), X.initials("t").alias("i")).collect()
    assert [x.s for x in r] == ["elan-cafe-2024", "event", "x"]
    assert [x.n for x in r] == ["9876543210", None, None]
    assert [x.m for x in r] == ["ab@x.io", "so***@mail.org", "short"]
    ts = spark.sql("select timestamp'2023-12-31 10:00:00' t").select(X.add_months("t", 2).alias("t")).first().t
    assert ts == dt.datetime(2024, 2, 29, 10)
    text = '{"user":{"Api-Key":"k","Access-Token":"t","list":[{"otp":"1","n":2}]}}'
    got = spark.createDataFrame([(text,), ("not json",)], "j string").select(X.redact_json("j").alias("j")).collect()
    assert got[0].j == '{"user":{"Api-Key":"k","Access-Token":"***REDACTED***","list":[{"otp":"***REDACTED***","n":2}]}}' and got[1].j == "not json"
    box = spark.range(1).select(boxes.padded_pixels(F.lit(0.0), F.lit(0.9), F.lit(0.2), F.lit(0.2), F.lit(100), F.lit(50), 0.25).alias("b")).first().b
    assert tuple(box) == (0, 42, 25, 50)


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("# HELP x",), ('m{name="a",k="v"} 1.5',), ("up 1 1700000000000",), ("broken line here !",)], "value string")
    got = {r.metric: (r.labels, r.value, r.ts) for r in samples.parse_samples(lines, F.lit(T0)).collect()}
    assert got["m"] == ({"name": "a", "k": "v"}, 1.5, T0) and got["up"][0] == {} and got["up"][2].year == 2023 and len(got) == 2
    base = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", 6)], "id int, n string, f int")
    assert {(r.id, r.f) for r in snapshots.bulk_set(base, base.where("id > 1").select("id"), ["id"], f=9).collect()} == {(1, None), (2, 9), (3, 9)}
    with pytest.raises(ValueError, match="1 of the requested"):
        snapshots.bulk_set(base, spark.createDataFrame([(7,)], "id int"), ["id"], f=1)
    root = str(tmp_path / "snap")
    assert not snapshots.path_exists(spark, root)
    for v in (1, 2):
        base.limit(v).repartition(2, "id").write.parquet(f"{root}/base/version={v}")
    assert snapshots.path_exists(spark, root)
    files = inventory(spark, root, "part-*.parquet")
    assert files.count() >= 2 and files.where("length > 0").count() == files.count()
    plan = scan(spark, f"{root}/base/version=2", F.col("id") == 1, ["n"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in plan
    log = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, day string")
    for _ in range(2):
        ingest.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_archive_effects(spark):
    items = spark.createDataFrame([(1, "e1", "p", 10, 20, 3, "completed"), (2, "e2", "p", 10, 20, 3, "completed")], "id int, e string, proxy string, proxy_file_size_bytes long, derivative_file_size_bytes long, face_count int, processing_status string")
    gone = spark.createDataFrame([("e1",)], "e string")
    got = {r.id: (r.proxy, r.proxy_file_size_bytes, r.derivative_file_size_bytes, r.face_count, r.processing_status) for r in lifecycle.archive(items, gone, "e").collect()}
    assert got == {1: (None, 10, 0, 0, "pending"), 2: ("p", 10, 20, 3, "completed")}
    parents = spark.createDataFrame([("e1", "archived"), ("e2", "ready")], "e string, status string")
    assert {r.e: r.status for r in lifecycle.set_status(parents, gone, "e", "processing").collect()} == {"e1": "processing", "e2": "ready"}
