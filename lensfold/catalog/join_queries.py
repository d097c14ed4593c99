"""Joins, roll-ups, listings, sets and trees."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lensfold.catalog.registry import query
from lensfold.catalog.roles import with_roles
from lensfold.functions import scalars as X
from lensfold.operators import access, intervals, listing, rollups
from lensfold.operators.sliced import position, sliding_count
from lensfold.operators.tree import tree


@query("c1_favorites", with_roles("photos", "favorites", body="SELECT photo_id, event_id, epoch_us(marked_at) AS marked_us FROM favorites JOIN photos USING (photo_id)"))
def c1(t):
    return access.newest_of(t.photos, t.favorites, "photo_id", "marked_at").select("photo_id", "event_id", F.unix_micros("marked_at").alias("marked_us"))


@query("c2_storage_by_status", with_roles("photos", "parents", body="""SELECT status, count(DISTINCT event_id) AS events, CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS bytes
  FROM parents LEFT JOIN photos USING (event_id) GROUP BY 1"""))
def c2(t):
    per_event = t.photos.groupBy("event_id").agg(F.sum("file_size_bytes").alias("b"))
    return t.parents.join(per_event, "event_id", "left").groupBy("status").agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bytes")
    )


def _stored(t):
    size = X.stored_bytes("file_size_bytes", "proxy_file_size_bytes", "derivative_file_size_bytes")
    return t.photos.withColumn("stored", size)


@query("c3_bytes_per_owner", with_roles("photos", "parents", body="""SELECT owner_id, CAST(coalesce(sum(file_size_bytes + proxy_file_size_bytes + derivative_file_size_bytes), 0) AS BIGINT) AS used_bytes
  FROM parents LEFT JOIN photos USING (event_id) GROUP BY 1"""))
def c3(t):
    return rollups.owner_bytes(_stored(t), t.parents, "event_id", "owner_id", "stored")


@query("c3_line_bytes_per_owner", """SELECT CAST(c_nationkey AS BIGINT) AS owner_id, CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0) AS BIGINT) AS used_bytes
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def c3_lines(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    per_order = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents).alias("b"))
    orders = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("event_id")).join(per_order, "o_orderkey")
    return rollups.owner_bytes(orders, t.parents, "event_id", "owner_id", "b")


MATCHED = """, pairs AS (SELECT DISTINCT m.session_id, f.photo_id FROM matches m JOIN face_members f USING (cluster_id) WHERE f.photo_id IN (SELECT photo_id FROM photos))"""


def _matched(t):
    return access.matched_items(t.photos, t.face_members, t.matches, "photo_id", "cluster_id", [])


@query("c4_matched_photos", with_roles("photos", "face_members", "matches", body=MATCHED + "SELECT session_id, photo_id FROM pairs"))
def c4(t):
    return _matched(t).select("session_id", "photo_id")


ASKED = """, asked AS (SELECT l_suppkey AS session_id, l_orderkey AS photo_id, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def _asked(t):
    return t.raw("lineitem").groupBy(F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("photo_id")).agg(F.count(F.lit(1)).alias("n"))


@query("c5_shared_or_matched", with_roles("photos", "face_members", "matches", body=MATCHED + ASKED + """
SELECT session_id, photo_id, n FROM asked WHERE photo_id IN (SELECT photo_id FROM photos WHERE shared) OR (session_id, photo_id) IN (SELECT session_id, photo_id FROM pairs)"""))
def c5(t):
    key = ["session_id", "photo_id"]
    return access.readable_requests(_asked(t), t.photos.where("shared"), t.matches, t.face_members, key, *key, "cluster_id").select(*key, "n")


@query("c6_matched_views", with_roles("photos", "face_members", "matches", body=MATCHED + ASKED + "SELECT session_id, photo_id FROM asked WHERE (session_id, photo_id) IN (SELECT session_id, photo_id FROM pairs)"))
def c6(t):
    key = ["session_id", "photo_id"]
    return access.matched_requests(_asked(t), t.matches, t.face_members, key, *key, "cluster_id")


@query("c7_action_counts", with_roles("gallery", "log", body="""SELECT photo_id, (SELECT count(*) FROM log WHERE log.photo_id = gallery.photo_id AND action = 'view') AS views,
  (SELECT count(*) FROM log WHERE log.photo_id = gallery.photo_id AND action = 'download') AS downloads FROM gallery"""))
def c7(t):
    return rollups.per_key(
        t.gallery.select("photo_id"), t.log, ["photo_id"], views=F.count_if(F.col("action") == "view"), downloads=F.count_if(F.col("action") == "download")
    )


@query("c8_in_list_order", """WITH l AS (SELECT s_suppkey, unnest([s_suppkey * 31 % 5000, s_suppkey + 7, 999999999, s_suppkey * 3]) AS photo_id, unnest([0, 1, 2, 3]) AS pos FROM supplier)
SELECT s_suppkey, CAST(pos AS INTEGER) AS pos, photo_id, o_custkey AS event_id FROM l JOIN orders ON o_orderkey = photo_id""")
def c8(t):
    s = F.col("s_suppkey")
    lists = t.raw("supplier").select(s, F.array(F.pmod(s * 31, F.lit(5000)), s + 7, F.lit(999999999).cast("bigint"), s * 3).alias("ids"))
    items = t.raw("orders").selectExpr("o_orderkey AS photo_id", "o_custkey AS event_id")
    return access.in_list_order(lists, items, ["s_suppkey"], "ids", "photo_id").orderBy("s_suppkey", "pos").select("s_suppkey", "pos", "photo_id", "event_id")


@query("c11_not_attempted", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def c11(t):
    tried = t.raw("lineitem").where("l_returnflag = 'A'").selectExpr("l_orderkey AS o_orderkey")
    return access.not_attempted(t.raw("orders").select("o_orderkey"), tried, ["o_orderkey"])


@query("c13_owner_lookup", with_roles("parents", "owners", body="SELECT event_id, name, owner_name FROM parents JOIN owners USING (owner_id)"))
def c13(t):
    return access.lookup(t.parents, t.owners, "owner_id").select("event_id", "name", "owner_name")


@query("c14_resolved_parents", with_roles("folders", body=""", f AS (SELECT folder_id, CASE WHEN folder_id = 7 THEN -5 ELSE parent_id END AS parent_id FROM folders)
SELECT a.folder_id, coalesce(b.folder_id, -1) AS parent_id, CAST(b.folder_id IS NULL AS INTEGER) AS is_root FROM f a LEFT JOIN folders b ON b.folder_id = a.parent_id"""))
def c14(t):
    nodes = t.folders.withColumn("parent_id", F.when(F.col("folder_id") == 7, F.lit(-5)).otherwise(F.col("parent_id")))
    return access.with_parent(nodes, "folder_id", "parent_id").select(
        "folder_id", F.coalesce("resolved_parent", F.lit(-1)).cast("bigint").alias("parent_id"), F.col("is_root").cast("int").alias("is_root")
    )


@query("c16_cluster_gallery", with_roles("face_members", "photos", body=""", s AS (SELECT cluster_id, count(*) AS size FROM face_members WHERE cluster_id IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, photo_id, line, supp, quantity) AS rank FROM face_members)
SELECT coalesce(r.cluster_id, -1) AS cluster_id, coalesce(size, -1) AS size, CAST(rank AS INTEGER) AS rank, r.photo_id, p.event_id FROM r JOIN photos p USING (photo_id) LEFT JOIN s USING (cluster_id) WHERE rank <= 36"""))
def c16(t):
    faces = t.face_members
    sizes = faces.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    order = [F.col(c) for c in ("created_at", "photo_id", "line", "supp", "quantity")]
    first = listing.first_n(faces, ["cluster_id"], order, 36)
    out = first.join(t.photos.select("photo_id", "event_id"), "photo_id").join(sizes, "cluster_id", "left")
    return out.select(
        F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"), F.coalesce("size", F.lit(-1)).cast("bigint").alias("size"), "rank", "photo_id", "event_id"
    )


@query("d1_event_summary", with_roles("log", "sessions", body=""", g AS (SELECT event_id, count(*) FILTER (WHERE verified) AS guests FROM sessions GROUP BY 1),
a AS (SELECT event_id, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'download') AS downloads FROM log GROUP BY 1)
SELECT event_id, coalesce(guests, 0) AS guests, coalesce(views, 0) AS views, coalesce(downloads, 0) AS downloads,
  CASE WHEN coalesce(guests, 0) > 0 THEN CAST(round_even(CAST(coalesce(views, 0) AS DOUBLE) / guests, 2) AS DOUBLE) ELSE 0.0::DOUBLE END AS engagement FROM g FULL JOIN a USING (event_id)"""))
def d1(t):
    return rollups.event_summary(t.log, t.sessions, "event_id")


COUNTS = """, c AS (SELECT event_id, count(*) AS total, count(*) FILTER (WHERE processing_status IN ('completed', 'failed')) AS terminal,
  count(*) FILTER (WHERE NOT faces_processed) AS pending FROM photos GROUP BY 1)"""


@query("d2_status_counts", with_roles("photos", body=COUNTS + "SELECT * FROM c"))
def d2(t):
    return rollups.status_counts(t.photos, "event_id")


@query("d3_direct_folder_counts", with_roles("photos", body="SELECT folder_id, count(*) AS photos FROM photos WHERE folder_id IS NOT NULL GROUP BY 1"))
def d3(t):
    return t.photos.where("folder_id IS NOT NULL").groupBy("folder_id").agg(F.count(F.lit(1)).alias("photos"))


@query("d4_deletion_rollup", with_roles("photos", body="""SELECT count(*) AS photos, CAST(coalesce(sum(face_count), 0) AS BIGINT) AS faces,
  CAST(coalesce(sum(file_size_bytes + proxy_file_size_bytes + derivative_file_size_bytes), 0) AS BIGINT) AS bytes FROM photos WHERE shared"""))
def d4(t):
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return _stored(t).where("shared").agg(F.count(F.lit(1)).alias("photos"), total("face_count").alias("faces"), total("stored").alias("bytes"))


@query("d5_faces_per_event", with_roles("photos", body="SELECT event_id, CAST(sum(face_count) AS BIGINT) AS faces FROM photos GROUP BY 1"))
def d5(t):
    return t.photos.groupBy("event_id").agg(F.sum("face_count").alias("faces"))


@query("d6_storage_breakdown", with_roles("photos", "parents", "owners", body=""", b AS (SELECT owner_id, CAST(coalesce(sum(CASE WHEN status <> 'archived' THEN file_size_bytes END), 0) AS BIGINT) AS active_bytes,
  CAST(coalesce(sum(CASE WHEN status = 'archived' THEN file_size_bytes END), 0) AS BIGINT) AS archived_bytes FROM parents LEFT JOIN photos USING (event_id) GROUP BY 1)
SELECT owner_id, coalesce(active_bytes, 0) AS active_bytes, coalesce(archived_bytes, 0) AS archived_bytes, coalesce(active_bytes + archived_bytes, 0) AS used_bytes,
  CAST(coalesce(round_even(CAST(100.0 * (active_bytes + archived_bytes) / limit_bytes AS DOUBLE), 2), 0) AS DOUBLE) AS percent FROM owners LEFT JOIN b USING (owner_id)"""))
def d6(t):
    out = rollups.storage_breakdown(t.owners, t.parents, t.photos, "owner_id", "event_id", "file_size_bytes")
    return out.select("owner_id", "active_bytes", "archived_bytes", "used_bytes", "percent")


@query("d7_child_counts", with_roles("parents", "photos", "log", body="""SELECT event_id, (SELECT count(*) FROM photos p WHERE p.event_id = e.event_id) AS photos,
  (SELECT count(*) FROM photos p WHERE p.event_id = e.event_id AND NOT faces_processed) AS pending, (SELECT count(*) FROM log l WHERE l.session_id = e.event_id) AS actions FROM parents e"""))
def d7(t):
    photos = t.photos
    children = {
        "photos": (photos, None), "pending": (photos, ~F.col("faces_processed")),
        "actions": (t.log.select(F.col("session_id").alias("event_id")), None),
    }
    return rollups.child_counts(t.parents.select("event_id"), "event_id", children)


@query("d13_outcomes", with_roles("photos", body="""SELECT event_id, count(*) FILTER (WHERE processing_status = 'completed') AS completed, count(*) FILTER (WHERE processing_status = 'failed') AS failed,
  count(*) FILTER (WHERE processing_status = 'pending') AS pending FROM photos GROUP BY 1"""))
def d13(t):
    return rollups.outcome_counts(t.photos, "processing_status", ["completed", "failed", "pending"], ["event_id"])


@query("d13_observed", with_roles("photos", body="""SELECT count(*) AS total, count(*) FILTER (WHERE processing_status = 'completed') AS completed,
  count(*) FILTER (WHERE processing_status = 'failed') AS failed, count(*) FILTER (WHERE processing_status = 'pending') AS pending FROM photos"""))
def d13_observed(t):
    """Counters of a job that goes over the photos for its own purpose."""
    names = ["completed", "failed", "pending"]
    rows, watch = rollups.observed(t.photos, "outcomes", "processing_status", names)
    rows.write.format("noop").mode("overwrite").save()
    found = watch.get
    return t.spark.createDataFrame([tuple(found[n] for n in ("total", *names))], "total long, completed long, failed long, pending long")


@query("d14_eta", with_roles("photos", body=COUNTS + """SELECT event_id, total, terminal, CASE WHEN terminal <= 0 THEN -1 WHEN total - terminal <= 0 THEN 0
  ELSE CAST(floor((total - terminal) / (terminal / (event_id % 600 + 1))) AS BIGINT) END AS eta FROM c"""))
def d14(t):
    c = rollups.status_counts(t.photos, "event_id").withColumn("elapsed", F.pmod("event_id", F.lit(600)) + 1)
    return c.select("event_id", "total", "terminal", F.coalesce(rollups.eta_seconds("total", "terminal", "elapsed"), F.lit(-1)).alias("eta"))


@query("d15_upload_sessions", """WITH p AS (SELECT user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS file_id, ts, event_id,
  CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'uploading' END AS status, CAST(round(value * 100) AS BIGINT) AS sent FROM events),
f AS (SELECT session_id, file_id, arg_max(status, (ts, event_id)) AS s, max(sent) AS b FROM p GROUP BY 1, 2),
g AS (SELECT session_id, count(*) AS files, count(*) FILTER (WHERE s = 'complete') AS completed, count(*) FILTER (WHERE s = 'failed') AS failed,
  count(*) FILTER (WHERE s = 'uploading') AS active, CAST(sum(b) AS BIGINT) AS uploaded_bytes FROM f GROUP BY 1)
SELECT *, CASE WHEN completed + failed < files THEN 'uploading' WHEN failed = files THEN 'error' ELSE 'complete' END AS batch_status FROM g""")
def d15(t):
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("uploading")
    p = t.events.select(
        F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("bigint").alias("file_id"), "ts", "event_id",
        status.alias("status"), F.round(F.col("value") * 100).cast("bigint").alias("sent"),
    )
    return rollups.upload_sessions(p, "session_id", "file_id", "ts", "status", "sent", "event_id")


@query("d18_distinct_ignoring_case", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS entry, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
x AS (SELECT doc_id, trim(entry) AS entry, pos FROM w WHERE trim(entry) <> '')
SELECT doc_id, count(*) AS entries, CAST(sum(pos) AS BIGINT) AS places, md5(string_agg(entry, ' ' ORDER BY pos)) AS spelled FROM
 (SELECT doc_id, arg_min(entry, pos) AS entry, min(pos) AS pos FROM x GROUP BY doc_id, lower(entry)) GROUP BY 1""")
def d18(t):
    kept = rollups.spellings(t.raw("documents"), ["doc_id"], "text", " ")
    places = F.aggregate("spelled", F.lit(0).cast("bigint"), lambda n, x: n + x["pos"])
    spelled = F.md5(F.concat_ws(" ", F.transform("spelled", lambda x: x["entry"])))
    return kept.select("doc_id", F.size("spelled").cast("bigint").alias("entries"), places.alias("places"), spelled.alias("spelled"))


@query("d22_kpis", with_roles("log", "sessions", "parents", "photos", body="""SELECT 'monthly_views' AS kpi, CAST(count(*) FILTER (WHERE action = 'view') AS DOUBLE) AS value FROM log WHERE date_trunc('month', ts) = TIMESTAMP '2024-01-01'
UNION ALL SELECT 'active_owners', CAST(count(DISTINCT owner_id) AS DOUBLE) FROM parents JOIN photos USING (event_id)
UNION ALL SELECT 'download_conversion', round(CAST(count(DISTINCT session_id) FILTER (WHERE action = 'download') AS DOUBLE) / count(DISTINCT session_id), 4) FROM log
UNION ALL SELECT 'mean_matches', round(avg(matched), 4) FROM sessions
UNION ALL SELECT 'repeat_rate', round(CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*), 4) FROM (SELECT owner_id, count(DISTINCT event_id) AS n FROM parents JOIN photos USING (event_id) GROUP BY 1)"""))
def d22(t):
    from lensfold.plans.evaluation import product_kpis

    return product_kpis(t.log, t.sessions, t.parents, t.photos, "2024-01")


@query("e2_first_members", with_roles("face_members", body=""", r AS (SELECT *, coalesce(CAST(cluster_id AS VARCHAR), 'unclustered') AS bucket,
  row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, photo_id, line, supp, quantity) AS rank FROM face_members)
SELECT bucket, CAST(rank AS INTEGER) AS rank, photo_id, line FROM r WHERE rank <= 36"""))
def e2(t):
    faces = t.face_members.withColumn("bucket", F.coalesce(F.col("cluster_id").cast("string"), F.lit("unclustered")))
    order = [F.col(c) for c in ("created_at", "photo_id", "line", "supp", "quantity")]
    return listing.first_n(faces, ["bucket"], order, 36).select("bucket", "rank", "photo_id", "line")


@query("e3_survivors", """WITH c AS (SELECT p_brand AS grp, p_partkey AS cluster_id, p_size AS size FROM part)
SELECT grp, cluster_id, size FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY size DESC, cluster_id) AS rn FROM c) WHERE rn = 1""")
def e3(t):
    c = t.raw("part").selectExpr("p_brand AS grp", "p_partkey AS cluster_id", "p_size AS size")
    return listing.best_per_group(c, ["grp"], [-F.col("size"), F.col("cluster_id")], ["cluster_id", "size"])


@query("e8_sliding_count", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def e8(t):
    counted = sliding_count(t.events, ["user_id"], "ts", 86400)
    return t.events.select("event_id", "user_id", F.unix_micros("ts").alias("us")).join(counted, ["user_id", "us"]).select("event_id", "in_window")


@query("e10_batches", """SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 5000 AS batch FROM orders""")
def e10(t):
    at = position(t.raw("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"], "at")
    return at.select("o_orderkey", "o_orderstatus", F.floor((F.col("at") - 1) / 5000).alias("batch"))


@query("f1_top_photos", with_roles("gallery", "log", body="""SELECT photo_id, filename, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'download') AS downloads
  FROM gallery LEFT JOIN log USING (photo_id) GROUP BY 1, 2 ORDER BY views DESC, photo_id LIMIT 50"""))
def f1(t):
    return listing.top_items(t.gallery.select("photo_id", "filename"), t.log, "photo_id", "views", 50)


SORTS = {"guest_name": "name", "first_visit": "created_at", "photos_matched_count": "matched", "photos_downloaded_count": "downloads"}


@query("f2_leads_page", with_roles("log", "sessions", body="""SELECT session_id, name, matched, coalesce(n, 0) AS downloads, (SELECT count(*) FROM sessions WHERE verified) AS total FROM sessions
  LEFT JOIN (SELECT session_id, count(*) AS n FROM log WHERE action = 'download' GROUP BY 1) USING (session_id) WHERE verified ORDER BY downloads DESC, session_id LIMIT 20 OFFSET 20"""))
def f2(t):
    return listing.leads(t.sessions, t.log, "session_id", SORTS, "photos_downloaded_count", "desc", 2, 20).select("session_id", "name", "matched", "downloads", "total")


@query("f3_list_by_date", with_roles("parents", body="SELECT event_id, coalesce(CAST(date_start AS VARCHAR), '') AS date_start FROM parents ORDER BY parents.date_start DESC NULLS FIRST, event_id LIMIT 100 OFFSET 10"))
def f3(t):
    page = listing.list_sorted(t.parents, "date_start", "event_id", "desc", 10, 500)
    return page.select("event_id", F.coalesce(F.col("date_start").cast("string"), F.lit("")).alias("date_start"))


@query("f3_list_by_status", with_roles("parents", body="SELECT event_id, status FROM parents ORDER BY list_position(['draft','uploading','processing','ready','archived'], status), event_id LIMIT 50 OFFSET 25"))
def f3_status(t):
    return listing.list_sorted(t.parents, X.ordinal("status"), "event_id", "asc", 25, 50).select("event_id", "status")


@query("f4_page_with_total", with_roles("photos", body="""SELECT photo_id, (SELECT count(*) FROM photos WHERE processing_status = 'completed') AS total FROM photos WHERE processing_status = 'completed'
  ORDER BY uploaded_at DESC, photo_id LIMIT 50 OFFSET 100"""))
def f4(t):
    rows = t.photos.where("processing_status = 'completed'")
    page = listing.page(rows.orderBy(F.col("uploaded_at").desc(), "photo_id"), 100, 50)
    return page.select("photo_id", rows.agg(F.count(F.lit(1)).alias("total")).scalar().alias("total"))


@query("g2_append_results", "SELECT o_orderkey AS id, 'a' AS src FROM orders UNION ALL SELECT c_custkey, 'b' FROM customer")
def g2(t):
    a = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.lit("a").alias("src"))
    return a.unionByName(t.raw("customer").select(F.lit("b").alias("src"), F.col("c_custkey").alias("id")))


@query("g5_toggles", with_roles("log", body="SELECT session_id, photo_id, count(*) AS toggles FROM log GROUP BY 1, 2 HAVING count(*) % 2 = 1"))
def g5(t):
    return rollups.toggled_on(t.log, ["session_id", "photo_id"])


TREE = """, up(folder_id, anc, depth) AS (SELECT folder_id, folder_id, 1 FROM folders UNION ALL SELECT u.folder_id, f.parent_id, u.depth + 1 FROM up u JOIN folders f ON f.folder_id = u.anc WHERE f.parent_id IS NOT NULL)"""


def _tree(t):
    return tree(t.folders, "folder_id", "parent_id", max_depth=None)


def _labels(t):
    return intervals.labels(t.folders, "folder_id", "parent_id")


@query("h9_tree", with_roles("folders", body=TREE + """SELECT folder_id, min(anc) AS root, CAST(max(depth) AS INTEGER) AS depth, string_agg(CAST(anc AS VARCHAR), '/' ORDER BY depth DESC) AS path FROM up GROUP BY 1""", recursive=True))
def h9(t):
    return _tree(t).select("folder_id", "root", "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


@query("g3_descendants", with_roles("folders", body=TREE + "SELECT anc AS ancestor, folder_id FROM up", recursive=True))
def g3(t):
    return intervals.descendants(_labels(t), "folder_id").select("ancestor", "folder_id")


@query("h9_cascade_rollup", with_roles("folders", "photos", body=TREE + """, n AS (SELECT folder_id, count(*) AS photos, sum(file_size_bytes) AS bytes FROM photos WHERE folder_id IS NOT NULL GROUP BY 1)
SELECT anc AS folder_id, CAST(sum(photos) AS BIGINT) AS photos, CAST(sum(bytes) AS BIGINT) AS bytes FROM up JOIN n USING (folder_id) GROUP BY 1""", recursive=True))
def h9_rollup(t):
    per = t.photos.where("folder_id IS NOT NULL").groupBy("folder_id").agg(F.count(F.lit(1)).alias("photos"), F.sum("file_size_bytes").alias("bytes"))
    return intervals.subtree_sums(_labels(t), "folder_id", per, ["photos", "bytes"])


@query("g3_order_chains", """WITH o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n,
  min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders) SELECT o_orderkey, root, CAST(least(rn, 10) AS INTEGER) AS depth, n - rn + 1 AS below FROM o""")
def g3_chains(t):
    """Every order hangs under the customer's order before it: trees far deeper than the depth limit."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    labelled = intervals.labels(t.raw("orders").select("o_orderkey", before.alias("parent")), "o_orderkey", "parent")
    return labelled.select("o_orderkey", "root", F.least("depth", F.lit(10)).alias("depth"), (F.col("leave") - F.col("enter") + 1).alias("below"))


@query("h9_rejected_moves", with_roles("folders", body=TREE + """, m AS (SELECT folder_id, (folder_id * 4 + 1) % (SELECT count(*) FROM folders) AS target FROM folders)
SELECT m.folder_id, m.target FROM m JOIN up ON up.folder_id = m.target AND up.anc = m.folder_id""", recursive=True))
def h9_moves(t):
    n = t.folders.agg(F.count(F.lit(1)).alias("n")).scalar()
    moves = t.folders.select("folder_id", F.pmod(F.col("folder_id") * 4 + 1, n).alias("target"))
    return intervals.moves_below(moves, _labels(t), "folder_id", "target")


@query("f6_sibling_order", with_roles("folders", body="""SELECT parent_id, folder_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, name, folder_id) AS place
  FROM folders WHERE parent_id IS NOT NULL"""))
def f6(t):
    nested = t.folders.where("parent_id IS NOT NULL")
    return position(nested, ["parent_id"], ["sort_order", "name", "folder_id"], "place").select("parent_id", "folder_id", "place")


@query("h10_derived_status", with_roles("photos", "parents", body=COUNTS + """, j AS (SELECT p.event_id, p.status, coalesce(total, 0) AS total, coalesce(terminal, 0) AS terminal, coalesce(pending, 0) AS pending FROM parents p LEFT JOIN c USING (event_id)),
d AS (SELECT *, CASE WHEN status = 'archived' THEN status WHEN total = 0 THEN 'draft' WHEN terminal = total AND pending = 0 THEN 'ready' WHEN status = 'processing' THEN status ELSE 'uploading' END AS new_status FROM j)
SELECT event_id, new_status, CAST(new_status = 'ready' AND status <> 'ready' AS INTEGER) AS became_ready FROM d"""))
def h10(t):
    out = rollups.derive_status(rollups.status_counts(t.photos, "event_id"), t.parents, "event_id")
    return out.select("event_id", "new_status", F.col("became_ready").cast("int").alias("became_ready"))


@query("h11_archive_effects", with_roles("photos", "parents", body=""", d AS (SELECT event_id FROM parents WHERE archive_at <= TIMESTAMP '2024-06-01 12:00:00' AND status = 'ready')
SELECT photo_id, CASE WHEN event_id IN (FROM d) THEN 'pending' ELSE processing_status END AS processing_status, CASE WHEN event_id IN (FROM d) THEN 0 ELSE derivative_file_size_bytes END AS derivative_file_size_bytes,
  proxy_file_size_bytes, CASE WHEN event_id IN (FROM d) THEN '-' ELSE coalesce(proxy, '-') END AS proxy, CASE WHEN event_id IN (FROM d) THEN 0 ELSE face_count END AS face_count FROM photos"""))
def h11(t):
    from lensfold.operators.gates import due
    from lensfold.plans.lifecycle import archive

    gone = due(t.parents, "archive_at", F.lit("2024-06-01 12:00:00").cast("timestamp"), "status").select("event_id")
    photos = archive(t.photos, gone, "event_id")
    return photos.select("photo_id", "processing_status", "derivative_file_size_bytes", "proxy_file_size_bytes", F.coalesce("proxy", F.lit("-")).alias("proxy"), "face_count")


@query("h11_purge_recount", with_roles("photos", "parents", body="""SELECT owner_id, CAST(coalesce(sum(CASE WHEN status <> 'archived' THEN file_size_bytes END), 0) AS BIGINT) AS used_bytes
  FROM parents LEFT JOIN photos USING (event_id) WHERE status <> 'archived' GROUP BY 1"""))
def h11_purge(t):
    from lensfold.plans.lifecycle import purge

    gone = t.parents.where("status = 'archived'").select("event_id")
    parents, photos = purge(t.parents, t.photos, gone, "event_id")
    return rollups.owner_bytes(photos, parents, "event_id", "owner_id", "file_size_bytes")
