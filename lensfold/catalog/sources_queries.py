"""Sources, sinks and ingest."""

from pyspark.sql import functions as F

from lensfold.catalog.registry import query
from lensfold.catalog.roles import with_roles
from lensfold.functions import scalars as X
from lensfold.operators import access, rollups
from lensfold.sources import export, ingest, metrics, snapshots
from lensfold.sources.tables import scan


@query("a1_keyed_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def a1(t):
    where = (F.col("o_custkey") == 7) & (F.col("o_orderstatus") == "F")
    return scan(t.spark, f"{t.dir}/orders.parquet", where, ["o_orderkey", "o_totalprice"])


# notices: line items as uploads; upload id = order * 4 + line % 4, so many ids arrive twice
def _notices(t):
    line = t.raw("lineitem")
    return line.select(
        (F.col("l_orderkey") * 4 + F.pmod("l_linenumber", F.lit(4))).alias("upload_id"),
        F.pmod("l_orderkey", F.lit(1500)).alias("event_id"), F.col("l_linenumber").cast("bigint").alias("seq"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_returnflag") == "A", "text/plain").when(F.col("l_returnflag") == "N", "image/png").otherwise("image/jpeg").alias("filetype"),
        F.col("l_suppkey").alias("supp"),
    )


NOTICES = """notices AS (SELECT l_orderkey * 4 + l_linenumber % 4 AS upload_id, l_orderkey % 1500 AS event_id,
  CAST(l_linenumber AS BIGINT) AS seq, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_shipdate AS ts,
  CASE l_returnflag WHEN 'A' THEN 'text/plain' WHEN 'N' THEN 'image/png' ELSE 'image/jpeg' END AS filetype,
  l_suppkey AS supp FROM lineitem),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY ts, seq, size, supp) AS rn FROM notices
  WHERE filetype IN ('image/png', 'image/jpeg')) WHERE rn = 1 AND upload_id NOT IN (SELECT o_orderkey * 3 FROM orders))"""


def _ingested(t):
    seen = t.raw("orders").select((F.col("o_orderkey") * 3).alias("upload_id"))
    valid = F.col("filetype").isin(*X.UPLOAD_TYPES)
    return ingest.ingest_idempotent(_notices(t), seen, "upload_id", ["ts", "seq", "size", "supp"], valid)


@query("a2_ingest_once", f"WITH {NOTICES} SELECT upload_id, event_id, seq, size, filetype FROM fresh")
def a2(t):
    return _ingested(t).select("upload_id", "event_id", "seq", "size", "filetype")


@query("a2_ingest_counters", f"""WITH {NOTICES} SELECT event_id, count(*) AS added_items, CAST(sum(size) AS BIGINT) AS added_bytes
  FROM fresh GROUP BY event_id""")
def a2_counters(t):
    return ingest.counter_changes(_ingested(t), "event_id", "size")


@query("a3_leads_export", with_roles("log", "sessions", body="""SELECT name AS "Name", phone AS "Phone",
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS "First Visited", CAST(matched AS VARCHAR) AS "Photos Matched",
  CAST(coalesce(n, 0) AS VARCHAR) AS "Photos Downloaded" FROM sessions
  LEFT JOIN (SELECT session_id, count(*) AS n FROM log WHERE action = 'download' GROUP BY 1) USING (session_id)
  WHERE verified"""))
def a3(t):
    counted = rollups.per_key(
        t.sessions.where("verified"), t.log.where("action = 'download'"), ["session_id"], downloads=F.count(F.lit(1))
    )
    return export.lead_rows(counted, "name", "phone", "created_at", "matched", "downloads", "session_id")


@query("a4_append_allowed_actions", with_roles("log", "gallery", body="""
, member AS (SELECT DISTINCT p_partkey AS photo_id, p_size % 10 AS slot FROM part),
allowed AS (SELECT l.id, l.session_id, l.photo_id, l.action, CAST(l.ts AS DATE) AS d FROM log l
  WHERE l.photo_id IN (SELECT photo_id FROM gallery WHERE shared)
     OR EXISTS (SELECT 1 FROM member m WHERE m.photo_id = l.photo_id AND m.slot = l.session_id % 10))
SELECT id, session_id, photo_id, action, CAST(d AS VARCHAR) AS day FROM allowed"""))
def a4(t):
    members = t.raw("part").select(F.col("p_partkey").alias("photo_id"), F.pmod("p_size", F.lit(10)).cast("bigint").alias("slot"))
    matches = t.log.select("session_id", F.pmod("session_id", F.lit(10)).alias("slot")).distinct()
    ok = access.readable_requests(t.log, t.gallery.where("shared"), matches, members, ["id"], "session_id", "photo_id", "slot")
    return ok.select("id", "session_id", "photo_id", "action", F.to_date("ts").cast("string").alias("day"))


@query("a6_parse_samples", """SELECT series, metric, name, count(*) AS samples, round(sum(value), 4) AS total FROM
  (SELECT user_id % 10 AS series, 'gauge_' || event_type AS metric, 's' || (user_id % 3) AS name, value FROM events)
  GROUP BY 1, 2, 3""")
def a6(t):
    text = F.concat(
        F.lit("gauge_"), F.col("event_type"), F.lit('{name="s'), F.pmod("user_id", F.lit(3)), F.lit('",series="'),
        F.pmod("user_id", F.lit(10)), F.lit('"} '), F.col("value").cast("string"),
    )
    lines = t.events.select(F.col("ts").alias("scraped"), text.alias("value"))
    long = metrics.parse_samples(lines, F.col("scraped"))
    return long.groupBy(F.col("labels")["series"].cast("bigint").alias("series"), "metric", F.col("labels")["name"].alias("name")).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 4).alias("total")
    )


@query("a7_get_or_create", """WITH e AS (SELECT c_nationkey AS event_id, c_custkey AS phone, c_name AS name FROM customer WHERE c_acctbal > 0),
i AS (SELECT c_nationkey AS event_id, o_custkey AS phone, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS name
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT * FROM e UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.event_id = i.event_id AND e.phone = i.phone)""")
def a7(t):
    c = t.raw("customer")
    existing = c.where("c_acctbal > 0").selectExpr("c_nationkey AS event_id", "c_custkey AS phone", "c_name AS name")
    incoming = t.raw("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "c_nationkey AS event_id", "o_custkey AS phone", "o_orderstatus AS name", "o_orderdate", "o_orderkey"
    )
    return ingest.upsert_missing(existing, incoming, ["event_id", "phone"], ["o_orderdate", "o_orderkey"]).select("event_id", "phone", "name")


@query("a8_apply_changes", """WITH chg AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS photo_id, o_custkey AS event_id, coalesce(n, o_custkey) AS cluster_id FROM orders LEFT JOIN chg ON k = o_orderkey
WHERE o_orderkey NOT IN (SELECT c_custkey * 4 FROM customer)""")
def a8(t):
    base = t.raw("orders").selectExpr("o_orderkey AS photo_id", "o_custkey AS event_id", "o_custkey AS cluster_id")
    changes = t.raw("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("photo_id")).agg(F.count(F.lit(1)).alias("cluster_id"))
    gone = t.raw("customer").selectExpr("c_custkey * 4 AS photo_id")
    return snapshots.apply_changes(base, changes, ["photo_id"], gone)


@query("a8_bulk_move", with_roles("photos", body="""SELECT photo_id, CASE WHEN shared THEN 42 ELSE coalesce(folder_id, -1) END AS folder_id FROM photos"""))
def a8_move(t):
    base = t.photos.select("photo_id", "folder_id", "shared")
    moved = snapshots.bulk_set(base, base.where("shared").select("photo_id"), ["photo_id"], folder_id=42)
    return moved.select("photo_id", F.coalesce("folder_id", F.lit(-1)).cast("bigint").alias("folder_id"))
