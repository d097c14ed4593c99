"""The roles of the data model, played by the given tables.

Each role exists twice: as a DataFrame here and as a SQL common table expression in ``CTE``, which the SQL twins
prefix. Both say the same thing.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensfold.functions import scalars as X

STATUS = X.EVENT_STATUSES


class Tables:
    """The given tables, and the roles derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def log(self) -> DataFrame:
        """Action log: view, download (= purchase)."""
        photo = F.get_json_object("props", "$.k").cast("bigint")
        action = F.when(F.col("event_type") == "view", "view").otherwise("download")
        return self.events.where(F.col("event_type").isin("view", "purchase")).select(
            F.col("event_id").alias("id"), photo.alias("photo_id"), F.pmod(photo, F.lit(25)).alias("event_id"),
            F.col("user_id").alias("session_id"), action.alias("action"), "ts",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """Guest sessions: customers; the event is the nation."""
        return self.raw("customer").select(
            F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("bigint").alias("event_id"),
            F.col("c_name").alias("name"), F.concat(F.lit("+91"), F.lpad(F.col("c_custkey").cast("string"), 10, "9")).alias("phone"),
            (F.col("c_acctbal") > 0).alias("verified"), F.pmod("c_custkey", F.lit(37)).alias("matched"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.pmod(F.col("c_custkey") * 7919, F.lit(5000)).cast("int"))).alias("created_at"),
        )

    @cached_property
    def gallery(self) -> DataFrame:
        """Items that can be viewed: parts; the event is the key modulo 25."""
        return self.raw("part").select(
            F.col("p_partkey").alias("photo_id"), F.pmod("p_partkey", F.lit(25)).alias("event_id"), F.col("p_name").alias("filename"),
            (F.col("p_size") > 30).alias("shared"),
        )

    @cached_property
    def owners(self) -> DataFrame:
        """Photographers: nations."""
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("owner_id"), F.col("n_name").alias("owner_name"),
            F.col("n_regionkey").cast("bigint").alias("region_id"), F.lit(2_000_000_000).cast("bigint").alias("limit_bytes"),
        )

    @cached_property
    def parents(self) -> DataFrame:
        """Events: customers; the owner is the nation, the status comes from the key."""
        key = F.col("c_custkey")
        status = F.element_at(F.array(*[F.lit(s) for s in STATUS]), (F.pmod(key, F.lit(5)) + 1).cast("int"))
        start = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(key, F.lit(365)).cast("int"))
        return self.raw("customer").select(
            key.alias("event_id"), F.col("c_nationkey").cast("bigint").alias("owner_id"), F.col("c_name").alias("name"),
            status.alias("status"), F.when(F.pmod(key, F.lit(11)) != 0, start).alias("date_start"),
            F.date_add(start, (F.pmod(key, F.lit(9)) - 1).cast("int")).alias("date_end"),
            (F.lit("2024-06-01").cast("timestamp") + F.make_dt_interval(hours=(F.pmod(key * 13, F.lit(480)) - 240).cast("int"))).alias("archive_at"),
        )

    @cached_property
    def photos(self) -> DataFrame:
        """Photos: orders; the event is the customer."""
        key = F.col("o_orderkey")
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
        return self.raw("orders").select(
            key.alias("photo_id"), F.col("o_custkey").alias("event_id"),
            F.when(F.pmod(key, F.lit(11)) != 0, F.pmod(key * 7, F.lit(200))).alias("folder_id"),
            cents.alias("file_size_bytes"), F.floor(cents / 4).alias("proxy_file_size_bytes"),
            F.floor(cents / 10).alias("derivative_file_size_bytes"),
            F.when(F.pmod(key, F.lit(3)) == 0, F.lit("")).when(F.pmod(key, F.lit(3)) == 1, F.concat(F.lit("t/"), key)).alias("thumb"),
            F.when(F.pmod(key, F.lit(4)) == 1, F.concat(F.lit("v/"), key)).alias("preview"),
            F.when(F.pmod(key, F.lit(5)) != 0, F.concat(F.lit("p/"), key)).alias("proxy"),
            F.pmod(key, F.lit(7)).alias("face_count"), (F.col("o_orderpriority") != "1-URGENT").alias("faces_processed"),
            status.alias("processing_status"), (F.col("o_totalprice") > 200000).alias("shared"),
            (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.pmod(key * 17, F.lit(86400)).cast("decimal(18,6)"))).alias("uploaded_at"),
        )

    @cached_property
    def folders(self) -> DataFrame:
        """Folder tree: parts; the parent is the key divided by 4, key 0 is the root."""
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("folder_id"), F.when(key > 0, F.floor(key / 4)).alias("parent_id"),
            F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("sort_order"),
        )

    @cached_property
    def favorites(self) -> DataFrame:
        """Marks of a couple on photos: first lines of an order that were returned."""
        return self.raw("lineitem").where("l_returnflag = 'R' and l_linenumber = 1").groupBy(F.col("l_orderkey").alias("photo_id")).agg(
            F.max(F.col("l_shipdate").cast("timestamp")).alias("marked_at")
        )

    @cached_property
    def face_members(self) -> DataFrame:
        """Faces in photos: line items; the cluster is the part modulo 500, a tenth has none."""
        cluster = F.when(F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(10)) != 0, F.pmod("l_partkey", F.lit(500)))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("photo_id"), F.col("l_linenumber").cast("bigint").alias("line"), cluster.alias("cluster_id"),
            F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("quantity"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def matches(self) -> DataFrame:
        """Matched clusters of a session: two clusters per supplier."""
        s = F.col("s_suppkey")
        return self.raw("supplier").select(
            s.alias("session_id"), F.explode(F.array(F.pmod(s * 3, F.lit(500)), F.pmod(s * 7 + 1, F.lit(500)))).alias("cluster_id")
        ).distinct()

    @cached_property
    def gauges(self) -> DataFrame:
        """Metric samples: one gauge per user, and a minute-aligned copy of the value."""
        return self.events.select("event_id", F.col("user_id").alias("series"), "ts", "value", "event_type")


CTE = {
    "log": """log AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS photo_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 AS event_id, user_id AS session_id,
  CASE event_type WHEN 'view' THEN 'view' ELSE 'download' END AS action, ts
  FROM events WHERE event_type IN ('view', 'purchase'))""",
    "sessions": """sessions AS (SELECT c_custkey AS session_id, CAST(c_nationkey AS BIGINT) AS event_id, c_name AS name,
  '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '9') AS phone, c_acctbal > 0 AS verified, c_custkey % 37 AS matched,
  TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey * 7919 % 5000 AS INTEGER)) AS created_at FROM customer)""",
    "gallery": "gallery AS (SELECT p_partkey AS photo_id, p_partkey % 25 AS event_id, p_name AS filename, p_size > 30 AS shared FROM part)",
    "owners": """owners AS (SELECT CAST(n_nationkey AS BIGINT) AS owner_id, n_name AS owner_name,
  CAST(n_regionkey AS BIGINT) AS region_id, CAST(2000000000 AS BIGINT) AS limit_bytes FROM nation)""",
    "parents": """parents AS (SELECT c_custkey AS event_id, CAST(c_nationkey AS BIGINT) AS owner_id, c_name AS name,
  ['draft','uploading','processing','ready','archived'][c_custkey % 5 + 1] AS status,
  CASE WHEN c_custkey % 11 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) END AS date_start,
  DATE '2024-01-01' + CAST(c_custkey % 365 + c_custkey % 9 - 1 AS INTEGER) AS date_end,
  TIMESTAMP '2024-06-01' + to_hours(CAST(c_custkey * 13 % 480 - 240 AS INTEGER)) AS archive_at FROM customer)""",
    "photos": """photos AS (SELECT o_orderkey AS photo_id, o_custkey AS event_id,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 7 % 200 END AS folder_id,
  CAST(round(o_totalprice * 100) AS BIGINT) AS file_size_bytes,
  CAST(round(o_totalprice * 100) AS BIGINT) // 4 AS proxy_file_size_bytes,
  CAST(round(o_totalprice * 100) AS BIGINT) // 10 AS derivative_file_size_bytes,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 't/' || o_orderkey END AS thumb,
  CASE o_orderkey % 4 WHEN 1 THEN 'v/' || o_orderkey END AS preview,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'p/' || o_orderkey END AS proxy,
  o_orderkey % 7 AS face_count, o_orderpriority <> '1-URGENT' AS faces_processed,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS processing_status,
  o_totalprice > 200000 AS shared, o_orderdate + to_seconds(CAST(o_orderkey * 17 % 86400 AS INTEGER)) AS uploaded_at FROM orders)""",
    "folders": """folders AS (SELECT p_partkey AS folder_id, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent_id,
  p_name AS name, CAST(p_size AS BIGINT) AS sort_order FROM part)""",
    "favorites": """favorites AS (SELECT l_orderkey AS photo_id, max(l_shipdate) AS marked_at FROM lineitem
  WHERE l_returnflag = 'R' AND l_linenumber = 1 GROUP BY 1)""",
    "face_members": """face_members AS (SELECT l_orderkey AS photo_id, CAST(l_linenumber AS BIGINT) AS line,
  CASE WHEN (l_partkey + l_linenumber) % 10 <> 0 THEN l_partkey % 500 END AS cluster_id, l_suppkey AS supp,
  l_quantity AS quantity, l_shipdate AS created_at FROM lineitem)""",
    "matches": """matches AS (SELECT DISTINCT s_suppkey AS session_id, unnest([s_suppkey * 3 % 500, (s_suppkey * 7 + 1) % 500]) AS cluster_id FROM supplier)""",
}


def with_roles(*names: str, body: str, recursive: bool = False) -> str:
    """SQL text with the named roles in front. ``body`` may open with further expressions: ``, x AS (...) SELECT``."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(CTE[n] for n in names) + "\n" + body
