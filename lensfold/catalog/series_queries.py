"""Boxes, metric series, limits, watches and alerts: the batch twins of the stream operators."""

from pyspark.sql import functions as F

from lensfold.catalog.registry import query
from lensfold.catalog.roles import with_roles
from lensfold.operators import anchored, boxes, metrics, runs
from lensfold.functions import scalars as X

NOW = "2024-01-30 12:00:00"
DET = """det AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) AS ord, l_partkey % 60 AS x1, l_suppkey * 7 % 60 AS y1, l_partkey % 60 + 30 + l_quantity AS x2, l_suppkey * 7 % 60 + 30 + l_quantity AS y2,
  l_extendedprice AS score FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))"""
CORNERS = ["x1", "y1", "x2", "y2"]


def _detections(t):
    from lensfold.sources.ingest import first_per_key

    one = first_per_key(
        t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
        ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
    )
    return one.selectExpr(
        "l_orderkey AS image", "bigint(l_linenumber) AS ord", "double(l_partkey % 60) AS x1", "double(l_suppkey * 7 % 60) AS y1",
        "l_partkey % 60 + 30 + l_quantity AS x2", "l_suppkey * 7 % 60 + 30 + l_quantity AS y2", "l_extendedprice AS score",
    )


def _sql_iou(a, b):
    w = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + 1)"
    h = f"greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + 1)"
    area = lambda t: f"(({t}.x2 - {t}.x1 + 1) * ({t}.y2 - {t}.y1 + 1))"
    return f"({w} * {h} / ({area(a)} + {area(b)} - {w} * {h}))"


@query("c15_box_overlap", f"WITH {DET} SELECT a.image, a.ord AS first, b.ord AS second, round({_sql_iou('a', 'b')}, 6) AS iou FROM det a JOIN det b ON a.image = b.image AND a.ord < b.ord AND {_sql_iou('a', 'b')} > 0.2")
def c15(t):
    return boxes.overlapping(_detections(t), ["image"], "ord", CORNERS, 0.2, 64).withColumn("iou", F.round("iou", 6))


@query("e5_primary_detection", f"""WITH {DET}, d AS (SELECT *, sqrt(power(CASE WHEN ord % 3 = 0 THEN (x1 + x2) / 2 ELSE x1 + 20 END - 60, 2) + power(CASE WHEN ord % 3 = 0 THEN (y1 + y2) / 2 ELSE y1 + 25 END - 50, 2)) AS dist FROM det)
SELECT image, ord, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(dist, 9), ord) AS rn FROM d) WHERE rn = 1""")
def e5(t):
    no_nose = F.pmod("ord", F.lit(3)) == 0
    x = F.when(no_nose, (F.col("x1") + F.col("x2")) / 2).otherwise(F.col("x1") + 20)
    y = F.when(no_nose, (F.col("y1") + F.col("y2")) / 2).otherwise(F.col("y1") + 25)
    rows = _detections(t).withColumn("dist", boxes.centre_distance(x, y, F.lit(120), F.lit(100)))
    best = boxes.primary_detection(rows.select("image", "ord", "dist"), ["image"], F.round("dist", 9), "ord")
    return best.withColumn("dist", F.round("dist", 6))


@query("e6_top_boxes", f"""WITH {DET}, v AS (SELECT *, (x2 - x1) * (y2 - y1) - 2 * (power((x1 + x2) / 2 - 60, 2) + power((y1 + y2) / 2 - 50, 2)) AS value FROM det)
SELECT image, ord, round(value, 4) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY value DESC, ord) AS rank FROM v) WHERE rank <= 2""")
def e6(t):
    top = boxes.top_boxes(_detections(t), ["image"], CORNERS, "ord", 2, F.lit(120), F.lit(100))
    return top.select("image", "ord", F.round("value", 4).alias("value"), "rank")


@query("e7_nms", f"""WITH RECURSIVE {DET}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, ord) AS rn FROM det),
k(image, rn, kept) AS (SELECT image, 1, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'ord': ord}}] FROM r WHERE rn = 1
UNION ALL SELECT k.image, k.rn + 1, CASE WHEN len(list_filter(k.kept, lambda b: {_sql_iou('r', 'b')} > 0.4)) > 0 THEN k.kept ELSE list_append(k.kept, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'ord': r.ord}}) END
  FROM k JOIN r ON r.image = k.image AND r.rn = k.rn + 1)
SELECT image, b.ord AS ord FROM (SELECT image, unnest(kept) AS b FROM (SELECT image, arg_max(kept, rn) AS kept FROM k GROUP BY 1))""")
def e7(t):
    return boxes.nms(_detections(t), ["image"], CORNERS, "score", "ord", 0.4).select("image", "ord")


@query("k3_box_table_function", f"WITH {DET} SELECT image, count(*) AS boxes, round(max(score), 6) AS best FROM det GROUP BY 1")
def k3(t):
    """Every image keeps its best box: suppression at IoU 1 only removes exact copies, so per image the best score stays. Called from
    SQL as a table function over the boxes of packs of images."""
    kept = boxes.suppressed_by_sql(_detections(t), ["image"], CORNERS, "score", "ord", 1.0)
    return kept.groupBy("image").agg(F.count(F.lit(1)).alias("boxes"), F.round(F.max("score"), 6).alias("best"))


@query("e9_counter_rate", """WITH p AS (SELECT user_id, ts, value, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400 AS bucket, sum(CASE WHEN value < pv THEN value ELSE value - pv END) / (sum(epoch_us(ts) - epoch_us(pt)) / 1000000) AS rate FROM p WHERE pt IS NOT NULL GROUP BY 1, 2)
SELECT bucket, round(avg(rate), 6) AS avg, round(sum(rate), 6) AS sum, count(*) AS series FROM r GROUP BY 1""")
def e9(t):
    rate = metrics.counter_rate(t.events, ["user_id"], "ts", "event_id", "value", 86400)
    out = metrics.over_series(rate, ["bucket"], "rate")
    return out.select("bucket", F.round("avg", 6).alias("avg"), F.round("sum", 6).alias("sum"), "series")


@query("d16_gauge_ratio", """WITH g AS (SELECT epoch_us(ts) // 86400000000 * 86400 AS day, user_id, event_type, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.day, a.user_id, round(a.v / b.v, 6) AS ratio FROM g a JOIN g b ON a.day = b.day AND a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.v <> 0""")
def d16(t):
    daily = t.events.groupBy(metrics.bucket("ts", 86400).alias("day"), "user_id", "event_type").agg(F.avg("value").alias("v"))
    top, low = (daily.where(F.col("event_type") == e) for e in ("view", "click"))
    return metrics.gauge_ratio(top, low, ["day", "user_id"], "v").withColumn("ratio", F.round("ratio", 6))


@query("d16_over_series", """SELECT epoch_us(ts) // 3600000000 * 3600 AS hour, event_type, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum, count(*) AS series FROM events GROUP BY 1, 2""")
def d16_series(t):
    rows = t.events.withColumn("hour", metrics.bucket("ts", 3600))
    out = metrics.over_series(rows, ["hour", "event_type"], "value")
    return out.select("hour", "event_type", F.round("avg", 6).alias("avg"), F.round("sum", 4).alias("sum"), "series")


@query("f5_latest_sorted", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def f5(t):
    return metrics.latest_per_series(t.events, ["user_id", "event_type"], "ts", "event_id", "value")


@query("j1_sliding_limit", """WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events)
SELECT user_id, us, n AS in_window, CAST(n <= 3 AS INTEGER) AS allowed FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM d)""")
def j1(t):
    out = metrics.sliding_limit(t.events, ["user_id"], "ts", 86400, 3)
    return out.select("user_id", F.unix_micros("ts").alias("us"), "in_window", F.col("allowed").cast("int").alias("allowed"))


ANCHOR = """d AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events),
a(user_id, us) AS (SELECT user_id, min(us) FROM d GROUP BY 1 UNION ALL SELECT a.user_id, n.us FROM a JOIN LATERAL (SELECT min(d.us) AS us FROM d WHERE d.user_id = a.user_id AND d.us >= a.us + 86400000000) n ON n.us IS NOT NULL)"""


@query("j2_throttle", f"""WITH RECURSIVE {ANCHOR}, w AS (SELECT e.event_id, e.user_id, row_number() OVER (PARTITION BY e.user_id, a.us ORDER BY e.ts, e.event_id) AS place FROM events e ASOF JOIN a ON e.user_id = a.user_id AND epoch_us(e.ts) >= a.us)
SELECT event_id, user_id, place, CAST(place <= 2 AS INTEGER) AS allowed FROM w""")
def j2(t):
    out = anchored.throttle(t.events, ["user_id"], "ts", "event_id", 86400, 2)
    return out.select("event_id", "user_id", "place", F.col("allowed").cast("int").alias("allowed"))


@query("j8_debounce", f"WITH RECURSIVE {ANCHOR} SELECT d.user_id, d.us, CAST(a.us IS NOT NULL AS INTEGER) AS acts FROM d LEFT JOIN a USING (user_id, us)")
def j8(t):
    out = anchored.debounce(t.events, ["user_id"], "ts", 86400)
    return out.select("user_id", F.unix_micros("ts").alias("us"), F.col("acts").cast("int").alias("acts"))


@query("j7_notifications", """WITH RECURSIVE d AS (SELECT DISTINCT event_type, epoch_us(ts) AS us FROM events WHERE value > 60),
a(event_type, us) AS (SELECT event_type, min(us) FROM d GROUP BY 1 UNION ALL SELECT a.event_type, n.us FROM a JOIN LATERAL (SELECT min(d.us) AS us FROM d WHERE d.event_type = a.event_type AND d.us >= a.us + 14400000000) n ON n.us IS NOT NULL)
SELECT event_type, us FROM a""")
def j7(t):
    sent = metrics.notifications(t.events.where("value > 60"), ["event_type"], "ts")
    return sent.select("event_type", F.unix_micros("ts").alias("us"))


@query("j3_attempts", """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type = 'view' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s(event_id, user_id, rn, us, attempt, nxt) AS (SELECT event_id, user_id, rn, us, 1, CASE WHEN ok THEN 0 ELSE 1 END FROM o WHERE rn = 1
UNION ALL SELECT o.event_id, o.user_id, o.rn, o.us, CASE WHEN o.us - s.us >= 172800000000 THEN 1 ELSE s.nxt + 1 END,
  CASE WHEN o.ok AND (CASE WHEN o.us - s.us >= 172800000000 THEN 1 ELSE s.nxt + 1 END) <= 3 THEN 0 ELSE CASE WHEN o.us - s.us >= 172800000000 THEN 1 ELSE s.nxt + 1 END END
  FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1)
SELECT event_id, user_id, CAST(attempt AS BIGINT) AS attempt, CAST(attempt > 3 AS INTEGER) AS blocked FROM s""")
def j3(t):
    log = t.events.select("event_id", "user_id", "ts", (F.col("event_type") == "view").alias("ok"))
    out = metrics.attempts(log, ["user_id"], "ts", "event_id", "ok", 172800, 3)
    return out.select("event_id", "user_id", "attempt", F.col("blocked").cast("int").alias("blocked"))


@query("j4_watch", f"""WITH a AS (SELECT user_id, max(epoch_us(ts)) FILTER (WHERE event_type = 'signup') AS s, max(epoch_us(ts)) FILTER (WHERE event_type IN ('view', 'click')) AS h, min(epoch_us(ts)) AS f
  FROM events WHERE ts <= TIMESTAMP '{NOW}' AND event_type IN ('signup', 'view', 'click') GROUP BY 1),
b AS (SELECT user_id, CASE WHEN s IS NULL OR h >= s THEN h END AS h, coalesce(s, f) AS s FROM a), c AS (SELECT *, epoch_us(TIMESTAMP '{NOW}') - coalesce(h, s) AS age FROM b)
SELECT user_id, round(age / 1000000.0, 3) AS idle_seconds, CASE WHEN h IS NOT NULL AND age < 21600000000 THEN 'healthy' WHEN age >= 86400000000 THEN 'reverted' ELSE 'recover' END AS verdict FROM c""")
def j4(t):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("view", "click"), "heartbeat")
    log = t.events.withColumn("kind", kind).where("kind IS NOT NULL")
    out = metrics.watch(log, ["user_id"], "ts", "kind", F.lit(NOW).cast("timestamp"), 21600, 86400)
    return out.select("user_id", F.round("idle_seconds", 3).alias("idle_seconds"), "verdict")


@query("j4_reconcile", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type IN ('view', 'click') THEN 'heartbeat' ELSE 'check' END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM e),
w AS (SELECT *, max(CASE WHEN kind = 'start' THEN rn END) OVER o AS s_rn, max(CASE WHEN kind = 'start' THEN us END) OVER o AS s_us, max(CASE WHEN kind = 'heartbeat' THEN rn END) OVER o AS h_rn,
  max(CASE WHEN kind = 'heartbeat' THEN us END) OVER o AS h_us, min(us) OVER o AS first_us FROM n WINDOW o AS (PARTITION BY user_id ORDER BY rn)),
c AS (SELECT *, CASE WHEN s_rn IS NULL OR h_rn > s_rn THEN h_us END AS beat FROM w WHERE kind = 'check'),
d AS (SELECT *, us - coalesce(beat, s_us, first_us) AS idle FROM c),
v AS (SELECT *, CASE WHEN beat IS NOT NULL AND idle < 21600000000 THEN 'healthy' WHEN idle >= 86400000000 THEN 'stalled' ELSE 'recover' END AS state FROM d),
r AS (SELECT user_id, us, min(event_id) AS event_id FROM v WHERE state = 'recover' GROUP BY 1, 2),
x AS (SELECT a.user_id, a.us, min(b.us) AS next_us FROM r a JOIN r b ON a.user_id = b.user_id AND b.us >= a.us + 43200000000 GROUP BY 1, 2),
acts AS (SELECT user_id, min(us) AS us FROM r GROUP BY 1 UNION ALL SELECT x.user_id, x.next_us FROM acts JOIN x ON x.user_id = acts.user_id AND x.us = acts.us)
SELECT v.user_id, v.event_id, CASE state WHEN 'healthy' THEN state WHEN 'stalled' THEN CASE WHEN row_number() OVER (PARTITION BY v.user_id, s_rn, state ORDER BY v.us, v.event_id) = 1 THEN 'reverted' ELSE 'skipped' END
  ELSE CASE WHEN acts.us IS NOT NULL AND r.event_id = v.event_id THEN 'requeued' ELSE 'waiting' END END AS verdict
FROM v LEFT JOIN acts ON acts.user_id = v.user_id AND acts.us = v.us LEFT JOIN r ON r.user_id = v.user_id AND r.us = v.us""")
def j4_reconcile(t):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("view", "click"), "heartbeat").otherwise("check")
    out = metrics.reconcile(t.events.withColumn("kind", kind), ["user_id"], "ts", "kind", "event_id", 21600, 86400, 43200)
    return out.select("user_id", "event_id", "verdict")


def _sql_runs(condition, period, gap=None, source="events", key="user_id % 5"):
    hole = "" if gap is None else f" OR us - pu > {gap * 1000000}"
    return f"""x AS (SELECT {key} AS series, epoch_us(ts) AS us, event_id, {condition} AS good FROM {source}),
p AS (SELECT *, lag(us) OVER w AS pu, lag(good) OVER w AS pg FROM x WINDOW w AS (PARTITION BY series ORDER BY us, event_id)),
q AS (SELECT *, sum(CASE WHEN good AND (pu IS NULL OR NOT pg{hole}) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY us, event_id) AS run FROM p),
s AS (SELECT *, min(us) OVER (PARTITION BY series, run) AS started FROM q WHERE good),
runs AS (SELECT series, started, max(us) AS ended, count(*) AS samples, min(us) FILTER (WHERE us - started >= {period * 1000000}) AS fired FROM s GROUP BY series, run, started)"""


def _run_rows(df):
    us = lambda c: F.unix_micros(c)
    return df.select("series", us("started").alias("started"), us("ended").alias("ended"), "samples", F.coalesce(us("fired_at"), F.lit(-1)).alias("fired"))


def _series(t):
    return t.events.withColumn("series", F.pmod("user_id", F.lit(5)))


@query("j5_idle", f"WITH {_sql_runs(chr(39).join(['event_type <> ', 'error', '']), 7200)} SELECT series, started, ended, samples, coalesce(fired, -1) AS fired FROM runs")
def j5(t):
    return _run_rows(runs.idle(_series(t), ["series"], "ts", "event_id", F.col("event_type") == "error", 7200))


@query("j6_sustained", f"WITH {_sql_runs('value > 8', 3600, 3600)} SELECT series, started, ended, samples, fired FROM runs WHERE fired IS NOT NULL")
def j6(t):
    return _run_rows(runs.sustained(_series(t), ["series"], "ts", "event_id", F.col("value") > 8, 3600, 3600))


@query("j9_windowed_counts", with_roles("log", body=""", w AS (SELECT event_id, action, unnest([epoch_us(ts) // 21600000000 * 21600 - 21600 * i FOR i IN range(4)]) AS start FROM log)
SELECT event_id, start, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'download') AS downloads FROM w GROUP BY 1, 2"""))
def j9(t):
    out = metrics.windowed_counts(t.log, ["event_id"], "ts", "action", "1 day", "6 hours")
    return out.select("event_id", F.unix_seconds("window.start").alias("start"), "views", "downloads")


@query("j10_ingest_twin", with_roles("log", body="SELECT session_id, photo_id, min(id) AS id, CAST(epoch_us(min(ts)) AS BIGINT) AS us FROM log GROUP BY 1, 2"))
def j10(t):
    from lensfold.sources.ingest import ingest_idempotent

    notices = t.log.withColumn("upload_id", F.concat_ws("-", "session_id", "photo_id"))
    fresh = ingest_idempotent(notices, notices.where("false"), "upload_id", ["ts", "id"])
    return fresh.select("session_id", "photo_id", "id", F.unix_micros("ts").alias("us"))


@query("j12_latest_progress", f"""SELECT user_id, CAST(max(floor(value)) AS BIGINT) AS done, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS total
  FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1 HAVING epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) < 43200000000""")
def j12(t):
    rows = t.events.withColumns({"done": F.floor("value"), "total": F.get_json_object("props", "$.k").cast("bigint")})
    return metrics.latest_progress(rows, ["user_id"], "ts", "event_id", "done", "total", F.lit(NOW).cast("timestamp"), 43200)


@query("j13_quiet_while_running", """WITH s AS (SELECT event_id, user_id % 5 AS series, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'),
l AS (SELECT user_id % 5 AS series, epoch_us(ts) AS us, value FROM events WHERE event_type = 'view'),
m AS (SELECT s.event_id, s.series, s.us, max(l.value) AS peak FROM s LEFT JOIN l ON l.series = s.series AND l.us <= s.us AND l.us > s.us - 3600000000 GROUP BY ALL)
SELECT series, us, CAST(peak IS NULL AS INTEGER) AS absent FROM m WHERE peak IS NULL OR peak < 10""")
def j13(t):
    rows = _series(t)
    state = rows.where("event_type = 'signup'").withColumn("value", F.lit(1.0))
    out = metrics.quiet_while_running(state, rows.where("event_type = 'view'"), ["series"], "ts", "value", 3600, 10.0)
    return out.select("series", F.unix_micros("ts").alias("us"), F.col("absent").cast("int").alias("absent"))


J14 = _sql_runs("value > 5 AND NOT (value - first_value < 0)", 1800, 7200, source="y", key="series")


@query("j14_not_draining", f"""WITH y AS (SELECT user_id % 5 AS series, ts, event_id, value, arg_min(value, (ts, event_id)) OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW) AS first_value FROM events),
{J14} SELECT series, started, ended, samples, fired FROM runs WHERE fired IS NOT NULL""")
def j14(t):
    return _run_rows(metrics.not_draining(_series(t), ["series"], "ts", "event_id", "value", 5, 1800, interval=7200))


@query("j15_quota_bands", """WITH RECURSIVE o AS (SELECT event_id, user_id, value / 2.0 + 60 AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
b AS (SELECT *, CAST(p >= 80 AS INTEGER) + CAST(p >= 95 AS INTEGER) + CAST(p >= 100 AS INTEGER) AS band FROM o),
s(event_id, user_id, rn, alert, last) AS (SELECT event_id, user_id, rn, band, band FROM b WHERE rn = 1
UNION ALL SELECT b.event_id, b.user_id, b.rn, CASE WHEN b.band > s.last THEN b.band ELSE 0 END,
  CASE WHEN b.band > s.last THEN b.band WHEN b.band = 0 AND s.last > 0 AND b.p <= [80, 95, 100][s.last] - 5 THEN 0 ELSE s.last END FROM s JOIN b ON b.user_id = s.user_id AND b.rn = s.rn + 1)
SELECT event_id, user_id, alert FROM s""")
def j15(t):
    usage = t.events.withColumn("percent", F.col("value") / 2 + 60)
    return metrics.quota_alerts(usage, ["user_id"], "ts", "event_id", "percent").select("event_id", "user_id", "alert")


@query("j16_daily_budget", """WITH p AS (SELECT *, unnest([CAST(ts AS DATE) + CAST(i AS INTEGER) FOR i IN range(3)]) AS day FROM events), l AS (SELECT day, user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM p GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, round(sum(v), 4) AS total, CAST(sum(v) > 900 AS INTEGER) AS alert FROM l GROUP BY 1""")
def j16(t):
    out = metrics.daily_budget(t.events, ["user_id", "event_type"], "ts", "event_id", "value", 900)
    return out.select(F.col("day").cast("string").alias("day"), F.round("total", 4).alias("total"), F.col("alert").cast("int").alias("alert"))


@query("i11_hourly_buckets", "SELECT epoch_us(ts) // 3600000000 * 3600 AS hour, count(*) AS n FROM events GROUP BY 1")
def i11_hours(t):
    return t.events.groupBy(F.unix_seconds(X.floor_to("ts", 3600)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
