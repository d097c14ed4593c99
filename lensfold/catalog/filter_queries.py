"""Projections, filters, gates and scalar functions."""

import datetime

from pyspark.sql import functions as F

from lensfold.catalog.registry import query
from lensfold.catalog.roles import with_roles
from lensfold.functions import scalars as X
from lensfold.operators import gates
from lensfold.operators.boxes import area_ratio, clip_box, padded_pixels, centre_distance
from lensfold.operators.sliced import range_slice

NOW = "2024-06-01 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


@query("b1_listing_projection", with_roles("photos", body="SELECT photo_id, event_id, processing_status, file_size_bytes FROM photos"))
def b1(t):
    return t.photos.select("photo_id", "event_id", "processing_status", "file_size_bytes")


@query("b2_completed_in_folder", with_roles("photos", body="SELECT photo_id, folder_id FROM photos WHERE processing_status = 'completed' AND folder_id = 21"))
def b2(t):
    return gates.status_filter(t.photos, "processing_status", "completed", "folder_id", 21).select("photo_id", "folder_id")


@query("b3_highlights", with_roles("photos", body="SELECT photo_id, event_id FROM photos WHERE processing_status = 'completed' AND shared"))
def b3(t):
    return gates.status_filter(t.photos, "processing_status", "completed").where("shared").select("photo_id", "event_id")


@query("b4_faces_pending", with_roles("photos", body="""SELECT photo_id, event_id, epoch_us(uploaded_at) AS uploaded_us FROM photos
  WHERE NOT faces_processed AND proxy IS NOT NULL"""))
def b4(t):
    rows = t.photos.where(~F.col("faces_processed") & F.col("proxy").isNotNull()).orderBy("uploaded_at", "photo_id")
    return rows.select("photo_id", "event_id", F.unix_micros("uploaded_at").alias("uploaded_us"))


@query("b4_thumb_backfill_batch", with_roles("photos", body="SELECT photo_id FROM photos WHERE thumb IS NULL AND proxy IS NOT NULL ORDER BY photo_id LIMIT 200"))
def b4_backfill(t):
    return t.photos.where("thumb IS NULL AND proxy IS NOT NULL").orderBy("photo_id").limit(200).select("photo_id")


def _poses(t):
    k = F.col("vec_id")
    return t.raw("embeddings").select(
        "vec_id", (F.pmod(k * 37, F.lit(260)) - 130).cast("double").alias("yaw"), (F.pmod(k * 11, F.lit(100)) - 50).cast("double").alias("pitch"),
        F.when(F.pmod(k, F.lit(9)) != 0, (F.pmod(k * 7, F.lit(110)) - 55).cast("double")).alias("roll"),
    )


POSES = """poses AS (SELECT vec_id, CAST(vec_id * 37 % 260 - 130 AS DOUBLE) AS yaw, CAST(vec_id * 11 % 100 - 50 AS DOUBLE) AS pitch,
  CASE WHEN vec_id % 9 <> 0 THEN CAST(vec_id * 7 % 110 - 55 AS DOUBLE) END AS roll FROM embeddings)"""


@query("b5_regular_band", f"""WITH {POSES} SELECT vec_id FROM poses WHERE abs(yaw) < 47 AND abs(pitch) < 47 AND abs(roll) < 47""")
def b5(t):
    return gates.band_filter(_poses(t), ["yaw", "pitch", "roll"], 0, 47).select("vec_id")


@query("b5_restricted_band", f"""WITH {POSES} SELECT vec_id FROM poses WHERE abs(yaw) <= 120 AND abs(pitch) <= 120 AND abs(roll) <= 120
  AND (abs(yaw) >= 47 OR abs(pitch) >= 47 OR abs(roll) >= 47)""")
def b5_restricted(t):
    return gates.band_filter(_poses(t), ["yaw", "pitch", "roll"], 47, 120, "restricted").select("vec_id")


def _scores(t):
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    null_every = lambda n, c: F.when(F.pmod(k, F.lit(n)) != 0, c)
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", null_every(13, F.col("l_discount") * 6).alias("blur"),
        null_every(17, F.pmod(k * 3, F.lit(120)) - 60.0).alias("yaw"), null_every(17, F.pmod(k * 5, F.lit(90)) - 45.0).alias("pitch"),
        null_every(17, F.pmod(k * 11, F.lit(110)) - 55.0).alias("roll"),
        F.when(F.pmod(k, F.lit(19)) == 0, 200).otherwise(F.col("l_quantity").cast("int")).alias("age"),
        null_every(7, F.col("l_tax") * 12).alias("glasses"),
    )


SCORES = """scores AS (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem), s AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN k % 13 <> 0 THEN l_discount * 6 END AS blur, CASE WHEN k % 17 <> 0 THEN k * 3 % 120 - 60 END AS yaw,
  CASE WHEN k % 17 <> 0 THEN k * 5 % 90 - 45 END AS pitch, CASE WHEN k % 17 <> 0 THEN k * 11 % 110 - 55 END AS roll,
  CASE WHEN k % 19 = 0 THEN 200 ELSE CAST(l_quantity AS INTEGER) END AS age, CASE WHEN k % 7 <> 0 THEN l_tax * 12 END AS glasses FROM scores),
g AS (SELECT *, CASE WHEN blur > 0.5 THEN 'blur' WHEN abs(yaw) > 45 OR abs(pitch) > 35 OR abs(roll) > 45 THEN 'ypr'
  WHEN age <> 200 AND age < 5 THEN 'age' END AS reason FROM s)"""


@query("b6_quality_gate", f"""WITH {SCORES} SELECT l_orderkey, l_linenumber, coalesce(reason, '') AS reason,
  CAST(reason IS NULL AS INTEGER) AS passed, CAST(coalesce(CASE WHEN reason IS NULL OR reason = 'age' THEN nullif(age, 200) END, -1) AS INTEGER) AS age,
  CAST(reason IS NULL AND coalesce(glasses >= 0.5, false) AS INTEGER) AS glasses FROM g""")
def b6(t):
    cols = {"blur": "blur", "yaw": "yaw", "pitch": "pitch", "roll": "roll", "age": "age", "sunglasses": "glasses"}
    q = gates.quality_gate(_scores(t), cols)
    return q.select(
        "l_orderkey", "l_linenumber", F.coalesce("quality.reject_reason", F.lit("")).alias("reason"), F.col("quality.passed").cast("int").alias("passed"),
        F.coalesce("quality.age", F.lit(-1)).alias("age"), F.col("quality.has_sunglasses").cast("int").alias("glasses"),
    )


@query("b7_liveness_gate", """WITH s AS (SELECT l_orderkey, l_linenumber, l_tax * 10 AS w, l_discount * 10 AS h, l_quantity / 50 AS det,
  l_extendedprice / 500 AS sharp, l_tax * 400 AS sat FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT (w * h BETWEEN 0.04 AND 0.85) THEN 'face_size' END,
  CASE WHEN NOT det >= 0.55 THEN 'detection_confidence' END, CASE WHEN NOT sharp >= 50 THEN 'sharpness' END,
  CASE WHEN NOT sat > 20 THEN 'color_present' END) AS failed FROM s""")
def b7(t):
    rows = t.raw("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_tax * 10 AS w", "l_discount * 10 AS h", "l_quantity / 50 AS det", "l_extendedprice / 500 AS sharp", "l_tax * 400 AS sat"
    )
    out = gates.liveness_gate(rows, {"w": "w", "h": "h", "score": "det", "sharpness": "sharp", "saturation": "sat"})
    return out.select("l_orderkey", "l_linenumber", F.concat_ws(",", "failed_checks").alias("failed"))


@query("b8_due_for_archive", with_roles("parents", body=f"SELECT event_id FROM parents WHERE archive_at <= TIMESTAMP '{NOW}' AND status = 'ready'"))
def b8(t):
    return gates.due(t.parents, "archive_at", _now(), "status").select("event_id")


@query("b9_archive_warnings", with_roles("parents", body=f"""
, d AS (SELECT *, (epoch_us(archive_at) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000.0 AS d FROM parents)
SELECT event_id, round(d, 4) AS days_left FROM d
WHERE status <> 'archived' AND archive_at > TIMESTAMP '{NOW}' AND (d BETWEEN 6.5 AND 7.5 OR d BETWEEN 0.5 AND 1.5)"""))
def b9(t):
    return gates.warn(t.parents, "archive_at", _now(), "status").select("event_id", F.round("days_left", 4).alias("days_left"))


@query("b10_quota_admission", with_roles("photos", "parents", body=""", r AS (SELECT p.photo_id, e.owner_id, p.uploaded_at, p.file_size_bytes AS size
  FROM photos p JOIN parents e USING (event_id)), s AS (SELECT *, sum(size) OVER (PARTITION BY owner_id ORDER BY uploaded_at, photo_id) AS asked FROM r)
SELECT photo_id, owner_id, CAST(asked AS BIGINT) AS asked_bytes, CAST(1000000 + asked <= 2000000000 AS INTEGER) AS admitted FROM s"""))
def b10(t):
    r = t.photos.join(t.parents, "event_id").select(
        "photo_id", "owner_id", "uploaded_at", F.col("file_size_bytes").alias("size"), F.lit(1_000_000).alias("used"), F.lit(2_000_000_000).alias("cap")
    )
    out = gates.admit_within_quota(range_slice(r, ["owner_id"], ["uploaded_at", "photo_id"]), "owner_id", ["uploaded_at", "photo_id"], "size", "used", "cap")
    return out.select("photo_id", "owner_id", F.col("asked_bytes").cast("bigint").alias("asked_bytes"), F.col("admitted").cast("int").alias("admitted"))


@query("b11_upload_type", """WITH f AS (SELECT p_partkey, p_name || CASE p_size % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.heif' WHEN 2 THEN '.tif' WHEN 3 THEN '.txt' ELSE '' END AS filename,
  CASE p_partkey % 4 WHEN 0 THEN ' Image/PNG ; q=1' WHEN 1 THEN 'application/x-foo' WHEN 2 THEN '' END AS declared FROM part),
g AS (SELECT *, lower(trim(split_part(coalesce(declared, ''), ';', 1))) AS bare, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS ext FROM f)
SELECT p_partkey, CASE WHEN bare IN ('image/png') THEN bare WHEN ext = 'jpg' THEN 'image/jpeg' WHEN ext = 'heif' THEN 'image/heic'
  WHEN ext = 'tif' THEN 'image/tiff' WHEN bare <> '' THEN bare ELSE 'application/octet-stream' END AS mime FROM g""")
def b11(t):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".JPG", ".heif", ".tif", ".txt", "")]), F.pmod("p_size", F.lit(5)).cast("int") + 1)
    kind = F.pmod("p_partkey", F.lit(4))
    declared = F.when(kind == 0, " Image/PNG ; q=1").when(kind == 1, "application/x-foo").when(kind == 2, "")
    return t.raw("part").select("p_partkey", X.resolve_type(F.concat("p_name", ext), declared).alias("mime"))


@query("b12_retention_prune", """WITH f AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'notes-' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN '.sql' ELSE '.sql.gz' END END AS name FROM orders)
SELECT name FROM f WHERE regexp_matches(name, '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\.sql\\.gz$') AND CAST(substr(name, 1, 10) AS DATE) <= DATE '1997-06-30'""")
def b12(t):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("notes-"), k)).otherwise(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 3 == 0, ".sql").otherwise(".sql.gz"))
    )
    listing = t.raw("orders").select(name.alias("name")).distinct()
    return gates.retention_due(listing, "name", F.lit(datetime.date(1997, 6, 30))).select("name")


@query("b13_search", with_roles("parents", body="SELECT event_id, name FROM parents WHERE lower(name) LIKE '%er#0000001%' AND status = 'ready'"))
def b13(t):
    return gates.search(t.parents, "name", " ER#0000001 ", "status", "ready").select("event_id", "name")


@query("b14_label_match", """SELECT event_id, value FROM events WHERE event_type = 'view' AND NOT regexp_full_match('dev' || CAST(user_id % 7 AS VARCHAR), 'dev1|dev[3-5]')""")
def b14(t):
    labels = F.create_map(F.lit("mode"), F.col("event_type"), F.lit("device"), F.concat(F.lit("dev"), F.pmod("user_id", F.lit(7))))
    rows = t.events.withColumn("labels", labels)
    return gates.label_match(rows, "labels", {"mode": "view"}, {"device": "dev1|dev[3-5]"}).select("event_id", "value")


@query("b15_size_class", with_roles("face_members", body="""SELECT cluster_id, count(*) AS size, CASE WHEN count(*) <= 110 THEN 'small' ELSE 'established' END AS size_class
  FROM face_members WHERE cluster_id IS NOT NULL GROUP BY 1"""))
def b15(t):
    sizes = t.face_members.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return gates.size_class(sizes, "size", 110)


@query("b16_violations", with_roles("parents", "folders", body="""SELECT 'date_order' AS rule, CAST(event_id AS VARCHAR) AS key FROM parents WHERE date_end < date_start
UNION ALL SELECT 'vector_length', CAST(vec_id AS VARCHAR) FROM embeddings WHERE len(embedding) <> 64
UNION ALL SELECT 'sibling_name', coalesce(CAST(parent_id AS VARCHAR), '') || '|' || name FROM folders GROUP BY parent_id, name HAVING count(*) > 1"""))
def b16(t):
    dates = gates.violations(t.parents, "event_id", {"date_order": F.coalesce(F.col("date_end") >= F.col("date_start"), F.lit(True))})
    lengths = gates.violations(t.raw("embeddings"), "vec_id", {"vector_length": F.size("embedding") == 64})
    names = gates.violations(t.folders, "folder_id", {"none": F.lit(True)}, {"sibling_name": ["parent_id", "name"]})
    return dates.unionByName(lengths).unionByName(names)


@query("i3_stored_bytes", with_roles("photos", body="SELECT photo_id, file_size_bytes + proxy_file_size_bytes + derivative_file_size_bytes AS stored FROM photos"))
def i3(t):
    return t.photos.select("photo_id", X.stored_bytes("file_size_bytes", "proxy_file_size_bytes", "derivative_file_size_bytes").alias("stored"))


@query("i4_rendition_keys", with_roles("photos", body="""SELECT photo_id, coalesce(nullif(thumb, ''), nullif(preview, ''), nullif(proxy, ''), '-') AS thumb_key,
  coalesce(nullif(preview, ''), nullif(proxy, ''), nullif(thumb, ''), '-') AS preview_key,
  coalesce(nullif(proxy, ''), nullif(preview, ''), nullif(thumb, ''), '-') AS full_key FROM photos"""))
def i4(t):
    keys = {k: k for k in ("thumb", "preview", "proxy")}
    return t.photos.select(
        "photo_id", *[F.coalesce(X.rendition_key(v, keys), F.lit("-")).alias(f"{v}_key") for v in ("thumb", "preview", "full")]
    )


@query("i5_slug", """WITH a AS (SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')) AS s FROM documents)
SELECT doc_id, md5(coalesce(nullif(regexp_replace(regexp_replace(s, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'event')) AS slug_hash FROM a""")
def i5(t):
    return t.raw("documents").select("doc_id", F.md5(X.slug("text")).alias("slug_hash"))


@query("i6_add_months", "SELECT o_orderkey, CAST(epoch(o_orderdate + INTERVAL 2 MONTH) AS BIGINT) AS later FROM orders")
def i6(t):
    return t.raw("orders").select("o_orderkey", F.unix_seconds(X.add_months(F.col("o_orderdate").cast("timestamp"), 2)).alias("later"))


# boxes from line items: coordinates in a 1000 x 800 image, some outside
BOXES = """boxes AS (SELECT l_orderkey, l_linenumber, l_partkey % 1100 - 50 AS x1, l_suppkey * 7 % 900 - 50 AS y1,
  l_partkey % 1100 - 50 + l_quantity * 5 AS x2, l_suppkey * 7 % 900 - 50 + l_quantity * 4 AS y2 FROM lineitem)"""


def _boxes(t):
    return t.raw("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey % 1100 - 50 AS x1", "l_suppkey * 7 % 900 - 50 AS y1",
        "l_partkey % 1100 - 50 + l_quantity * 5 AS x2", "l_suppkey * 7 % 900 - 50 + l_quantity * 4 AS y2",
    )


@query("i7_clip_box", f"""WITH {BOXES}, c AS (SELECT *, greatest(0, least(1000, x1)) AS a, greatest(0, least(800, y1)) AS b,
  greatest(0, least(1000, x2)) AS c, greatest(0, least(800, y2)) AS d FROM boxes)
SELECT l_orderkey, l_linenumber, round(a / 1000, 6) AS x, round(b / 800, 6) AS y, round(greatest(c - a, 0) / 1000, 6) AS w, round(greatest(d - b, 0) / 800, 6) AS h FROM c""")
def i7(t):
    box = clip_box("x1", "y1", "x2", "y2", F.lit(1000), F.lit(800))
    rows = _boxes(t).withColumn("b", box)
    return rows.select("l_orderkey", "l_linenumber", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("x", "y", "w", "h")])


@query("i7_padded_pixels", """WITH n AS (SELECT l_orderkey, l_linenumber, l_discount * 8 AS x, l_tax * 10 AS y, l_quantity / 100 AS w, l_quantity / 200 AS h FROM lineitem),
p AS (SELECT *, CAST(round_even((x - w * 0.25) * 1000, 0) AS BIGINT) AS a, CAST(round_even((y - h * 0.25) * 800, 0) AS BIGINT) AS b,
  CAST(round_even((x + w + w * 0.25) * 1000, 0) AS BIGINT) AS c, CAST(round_even((y + h + h * 0.25) * 800, 0) AS BIGINT) AS d FROM n),
q AS (SELECT *, greatest(0, least(a, 999)) AS px1, greatest(0, least(b, 799)) AS py1 FROM p)
SELECT l_orderkey, l_linenumber, px1, py1, greatest(px1 + 1, least(c, 1000)) AS px2, greatest(py1 + 1, least(d, 800)) AS py2 FROM q""")
def i7_pixels(t):
    rows = t.raw("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount * 8 AS x", "l_tax * 10 AS y", "l_quantity / 100 AS w", "l_quantity / 200 AS h")
    p = rows.withColumn("p", padded_pixels("x", "y", "w", "h", F.lit(1000), F.lit(800), 0.25))
    return p.select("l_orderkey", "l_linenumber", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])


@query("i8_area_and_centre", f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, round(greatest(0, (x2 - x1) * (y2 - y1)) / 800000, 6) AS area_ratio,
  round(sqrt(power((x1 + x2) / 2 - 500, 2) + power((y1 + y2) / 2 - 400, 2)), 6) AS centre_distance FROM boxes""")
def i8(t):
    return _boxes(t).select(
        "l_orderkey", "l_linenumber",
        F.round(area_ratio((F.col("x2") - F.col("x1")) / 1000, (F.col("y2") - F.col("y1")) / 800), 6).alias("area_ratio"),
        F.round(centre_distance((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, F.lit(1000), F.lit(800)), 6).alias("centre_distance"),
    )


@query("i9_expected_age", """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 0.6 END AS top, vec_id % 9 AS b FROM embeddings),
q AS (SELECT vec_id, top, [CASE WHEN i = b THEN top ELSE (1 - top) / 8 END FOR i IN range(9)] AS probs FROM p)
SELECT vec_id, CASE WHEN top > 0.5 THEN CAST(floor(list_dot_product(probs, [2, 9, 19, 29, 39, 49, 59, 69, 79]::DOUBLE[])) AS INTEGER) ELSE -1 END AS age FROM q""")
def i9(t):
    top = F.when(F.pmod("vec_id", F.lit(3)) == 0, F.lit(0.5)).otherwise(F.lit(0.6))
    probs = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when(i == F.pmod("vec_id", F.lit(9)), top).otherwise((1 - top) / 8))
    return t.raw("embeddings").select("vec_id", F.coalesce(X.expected_age(probs), F.lit(-1)).alias("age"))


@query("i10_national_number", """WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '9') WHEN 1 THEN '+91' || c_custkey
  WHEN 2 THEN '+1' || lpad(CAST(c_custkey AS VARCHAR), 11, '9') ELSE '+91' || lpad(CAST(c_custkey AS VARCHAR), 9, '9') || 'x' END AS phone FROM customer)
SELECT c_custkey, coalesce(nullif(regexp_extract(phone, '^\\+91([0-9]{10})$', 1), ''), 'invalid') AS national FROM p""")
def i10(t):
    key = F.col("c_custkey").cast("string")
    kind = F.pmod("c_custkey", F.lit(4))
    phone = (
        F.when(kind == 0, F.concat(F.lit("+91"), F.lpad(key, 10, "9"))).when(kind == 1, F.concat(F.lit("+91"), key))
        .when(kind == 2, F.concat(F.lit("+1"), F.lpad(key, 11, "9"))).otherwise(F.concat(F.lit("+91"), F.lpad(key, 9, "9"), F.lit("x")))
    )
    return t.raw("customer").select("c_custkey", F.coalesce(X.national_number(phone), F.lit("invalid")).alias("national"))


@query("i11_floor_bucket", "SELECT event_id, epoch_us(ts) // 900000000 * 900 AS bucket FROM events")
def i11(t):
    return t.events.select("event_id", F.unix_seconds(X.floor_to("ts", 900)).alias("bucket"))


@query("i12_redact_fields", """SELECT event_id, '***REDACTED***' AS masked, json_extract_string(props, '$.k') AS kept FROM events""")
def i12(t):
    fields = F.create_map(F.lit("Api-Token"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    out = t.events.select("event_id", X.redact_map(fields).alias("m"))
    return out.select("event_id", F.col("m")["Api-Token"].alias("masked"), F.col("m")["k"].alias("kept"))


@query("i12_redact_json", """SELECT event_id, '{"props":' || replace(props, ': ', ':') || ',"auth":[{"otp_code":"***REDACTED***","n":' || user_id || '}]}' AS body FROM events""")
def i12_json(t):
    body = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"auth":[{"otp_code":"'), F.col("event_type"), F.lit('","n":'), F.col("user_id"), F.lit("}]}"))
    return t.events.select("event_id", X.redact_json(body).alias("body"))


@query("i13_valid_ids", """WITH u AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders), v AS (SELECT o_orderkey,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '-' END || substr(h, 21) AS id FROM u)
SELECT o_orderkey, CAST(regexp_full_match(id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') AS INTEGER) AS ok FROM v""")
def i13(t):
    h = F.md5(F.col("o_orderkey").cast("string"))
    dash = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, "").otherwise("-")
    text = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), dash, F.substring(h, 21, 12))
    return t.raw("orders").select("o_orderkey", X.valid_uuid(text).cast("int").alias("ok"))


@query("i14_status_ordinal", with_roles("parents", body="""SELECT event_id, CAST(list_position(['draft','uploading','processing','ready','archived'], status) - 1 AS INTEGER) AS ordinal FROM parents"""))
def i14(t):
    return t.parents.select("event_id", X.ordinal("status").alias("ordinal"))


@query("i16_mask_contact", with_roles("sessions", body="""SELECT session_id, CASE WHEN session_id % 3 = 0 THEN substr(name, 1, 2) || '***@example.org' WHEN session_id % 3 = 1 THEN '+91 ******' || right(phone, 4)
  ELSE 'short' END AS masked, upper(substr(name, 1, 1)) AS initials FROM sessions"""))
def i16(t):
    kind = F.pmod("session_id", F.lit(3))
    contact = F.when(kind == 0, F.concat("name", F.lit("@example.org"))).when(kind == 1, F.col("phone")).otherwise("short")
    return t.sessions.select("session_id", X.mask_contact(contact).alias("masked"), X.initials("name").alias("initials"))
