"""Planted vector fixtures over the given embeddings: groups that are known, on vectors that are not.

The given vectors are random, so groups are planted by adding a shared vector. All given rows take part, and there is an
anchor for every 20 of them (25 at least): clusters and parts grow with the table, what is in a part does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.functions import vectors as V


def key(vec_id: Column | str) -> Column:
    c = F.col(vec_id) if isinstance(vec_id, str) else vec_id
    return F.concat(F.lit("v"), F.lpad(c.cast("string"), 9, "0"))


def base(t) -> DataFrame:
    return t.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def other(df: DataFrame, t, index: Column, name: str) -> DataFrame:
    """Adds the given vector at ``index``."""
    pick = base(t).select(F.col("vec_id").alias("_ix"), F.col("e").alias(name))
    return df.withColumn("_ix", index.cast("bigint")).join(pick, "_ix").drop("_ix")


def mix(*terms: tuple[str, float]) -> Column:
    total = V.scale(terms[0][0], F.lit(terms[0][1]))
    for name, factor in terms[1:]:
        total = V.add(total, V.scale(name, F.lit(factor)))
    return V.unit(total)


def sizes(t) -> tuple[int, int]:
    """Number of anchors and of parts."""
    if not hasattr(t, "vector_sizes"):
        anchors = max(25, t.raw("embeddings").count() // 20)
        t.vector_sizes = anchors, max(4, anchors // 6)
    return t.vector_sizes


def part_of(anchor: str, parts: int) -> Column:
    return F.pmod(anchor, F.lit(parts)).cast("int").alias("part")


def single_level(t) -> DataFrame:
    """A group for each ``anchor``; same-anchor cosine >= 0.869, cross-anchor <= 0.458 inside a part."""
    anchors, parts = sizes(t)
    rows = other(base(t).withColumn("anchor", F.pmod("vec_id", F.lit(anchors))), t, F.col("anchor"), "a")
    rows = other(rows, t, F.col("anchor") + anchors, "b")
    return rows.select(
        part_of("anchor", parts), key("vec_id").alias("id"), "vec_id", "anchor",
        mix(("a", 1.0), ("e", 0.3)).alias("v"), F.when(F.pmod("vec_id", F.lit(6)) != 0, mix(("b", 1.0), ("e", 0.4))).alias("second"),
        F.floor(F.col("vec_id") / 3).alias("photo_id"),
    )


def two_level(t) -> DataFrame:
    """Four tight groups (``micro``) inside each wide one (``macro``)."""
    anchors, parts = sizes(t)
    rows = base(t).withColumn("micro", F.pmod("vec_id", F.lit(4 * anchors))).withColumn("macro", F.pmod("micro", F.lit(anchors)))
    rows = other(other(rows, t, F.col("macro"), "a"), t, F.col("micro") + 4 * anchors, "b")
    yaw = F.pmod(F.col("vec_id") * 37, F.lit(130)).cast("double")
    return rows.select(
        part_of("macro", parts), key("vec_id").alias("id"), "vec_id", "micro", "macro",
        mix(("a", 1.0), ("b", 0.6), ("e", 0.1)).alias("v"), yaw.alias("yaw"), F.lit(10.0).alias("pitch"), F.lit(-10.0).alias("roll"),
        (F.pmod("vec_id", F.lit(13)) != 0).alias("passed"), F.lit(None).cast("string").alias("cluster_id"),
        F.when(F.pmod("vec_id", F.lit(6)) != 0, mix(("b", 1.0), ("e", 0.4))).alias("second"),
    )


def clusters(t) -> DataFrame:
    """One cluster per anchor of any row, some with a pose centroid; plus a small twin of every third anchor."""
    anchors, parts = sizes(t)
    found = base(t).select(F.pmod("vec_id", F.lit(anchors)).alias("vec_id")).distinct()
    rows = other(found, t, F.col("vec_id"), "e")
    rows = other(other(rows, t, F.col("vec_id") + anchors, "b"), t, F.col("vec_id") + 2 * anchors, "c")
    part = part_of("vec_id", parts)
    main = rows.select(
        part, F.concat(F.lit("c"), key("vec_id")).alias("cluster_id"), "vec_id", mix(("e", 1.0)).alias("centroid"),
        F.when(F.pmod("vec_id", F.lit(3)) != 0, mix(("e", 1.0), ("c", 0.8))).alias("pyr_centroid"), mix(("b", 1.0)).alias("secondary_centroid"),
        (F.pmod("vec_id", F.lit(7)) + 4).alias("cluster_size"), F.when(F.pmod("vec_id", F.lit(3)) != 0, F.pmod("vec_id", F.lit(4))).otherwise(0).cast("bigint").alias("pyr_size"),
    )
    twin = rows.where("vec_id % 3 = 1").select(
        part, F.concat(F.lit("t"), key("vec_id")).alias("cluster_id"), "vec_id", mix(("e", 1.0), ("c", 0.5)).alias("centroid"),
        F.when(F.pmod("vec_id", F.lit(2)) == 1, mix(("c", 1.0), ("e", 0.7))).alias("pyr_centroid"), mix(("b", 1.0), ("c", 0.2)).alias("secondary_centroid"),
        (F.pmod("vec_id", F.lit(3)) + 1).alias("cluster_size"), F.when(F.pmod("vec_id", F.lit(2)) == 1, F.lit(2)).otherwise(F.lit(0)).cast("bigint").alias("pyr_size"),
    )
    return main.unionByName(twin)


SQL_MACROS = """emb AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sz AS (SELECT g, greatest(4, g // 6) AS p FROM (SELECT greatest(25, count(*) // 20) AS g FROM embeddings))"""


def sql_mix(*terms: tuple[str, float]) -> str:
    """Unit vector of a weighted sum, as a DuckDB expression."""
    zipped = f"list_zip({', '.join(n for n, _ in terms)})" if len(terms) > 1 else terms[0][0]
    if len(terms) > 1:
        body = " + ".join(f"{f} * z[{i}]" for i, (_, f) in enumerate(terms, 1))
    else:
        body = f"{terms[0][1]} * z"
    total = f"list_transform({zipped}, lambda z: {body})"
    return f"list_transform([{total}], lambda w: list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))))[1]"


SQL_SINGLE = f"""{SQL_MACROS},
fix AS (SELECT CAST(m.vec_id % sz.g % sz.p AS INTEGER) AS part, 'v' || lpad(CAST(m.vec_id AS VARCHAR), 9, '0') AS id, m.vec_id, m.vec_id % sz.g AS anchor,
  {sql_mix(("a.e", 1.0), ("m.e", 0.3))} AS v, CASE WHEN m.vec_id % 6 <> 0 THEN {sql_mix(("b.e", 1.0), ("m.e", 0.4))} END AS second, m.vec_id // 3 AS photo_id
  FROM sz CROSS JOIN emb m JOIN emb a ON a.vec_id = m.vec_id % sz.g JOIN emb b ON b.vec_id = m.vec_id % sz.g + sz.g)"""

SQL_TWO = f"""{SQL_MACROS},
fix AS (SELECT CAST(m.vec_id % sz.g % sz.p AS INTEGER) AS part, 'v' || lpad(CAST(m.vec_id AS VARCHAR), 9, '0') AS id, m.vec_id, m.vec_id % (4 * sz.g) AS micro, m.vec_id % sz.g AS macro,
  {sql_mix(("a.e", 1.0), ("b.e", 0.6), ("m.e", 0.1))} AS v, CAST(m.vec_id * 37 % 130 AS DOUBLE) AS yaw, m.vec_id % 13 <> 0 AS passed,
  CASE WHEN m.vec_id % 6 <> 0 THEN {sql_mix(("b.e", 1.0), ("m.e", 0.4))} END AS second
  FROM sz CROSS JOIN emb m JOIN emb a ON a.vec_id = m.vec_id % sz.g JOIN emb b ON b.vec_id = m.vec_id % (4 * sz.g) + 4 * sz.g)"""

SQL_CLUSTERS = f"""cl AS MATERIALIZED (SELECT CAST(m.vec_id % sz.p AS INTEGER) AS part, 'cv' || lpad(CAST(m.vec_id AS VARCHAR), 9, '0') AS cluster_id, m.vec_id, {sql_mix(("m.e", 1.0))} AS centroid,
  CASE WHEN m.vec_id % 3 <> 0 THEN {sql_mix(("m.e", 1.0), ("c.e", 0.8))} END AS pyr_centroid, {sql_mix(("b.e", 1.0))} AS secondary_centroid,
  m.vec_id % 7 + 4 AS cluster_size, CASE WHEN m.vec_id % 3 <> 0 THEN m.vec_id % 4 ELSE 0 END AS pyr_size
  FROM sz CROSS JOIN (SELECT DISTINCT vec_id % g AS anchor FROM emb CROSS JOIN sz) k JOIN emb m ON m.vec_id = k.anchor JOIN emb b ON b.vec_id = m.vec_id + sz.g JOIN emb c ON c.vec_id = m.vec_id + 2 * sz.g
UNION ALL SELECT CAST(m.vec_id % sz.p AS INTEGER), 'tv' || lpad(CAST(m.vec_id AS VARCHAR), 9, '0'), m.vec_id, {sql_mix(("m.e", 1.0), ("c.e", 0.5))},
  CASE WHEN m.vec_id % 2 = 1 THEN {sql_mix(("c.e", 1.0), ("m.e", 0.7))} END, {sql_mix(("b.e", 1.0), ("c.e", 0.2))}, m.vec_id % 3 + 1, CASE WHEN m.vec_id % 2 = 1 THEN 2 ELSE 0 END
  FROM sz CROSS JOIN (SELECT DISTINCT vec_id % g AS anchor FROM emb CROSS JOIN sz) k JOIN emb m ON m.vec_id = k.anchor JOIN emb b ON b.vec_id = m.vec_id + sz.g JOIN emb c ON c.vec_id = m.vec_id + 2 * sz.g WHERE m.vec_id % 3 = 1)"""


def sql_components(near: float, source: str = "fix") -> str:
    """Connected components of cosine >= near, by spreading the smallest id."""
    return f"""edge AS (SELECT a.part, a.id AS u, b.id AS w FROM {source} a JOIN {source} b ON a.part = b.part AND list_cosine_similarity(a.v, b.v) >= {near}),
reach(part, id, seen) AS (SELECT part, id, id FROM {source} UNION SELECT r.part, e.w, r.seen FROM reach r JOIN edge e ON e.part = r.part AND e.u = r.id),
comp AS (SELECT part, id, min(seen) AS label FROM reach GROUP BY 1, 2)"""


def sql_unit_mean(rows: str, keys: str, vec: str, weight: str = "1", extra: str = "") -> str:
    """Unit weighted mean per key over a source of rows, one output column ``centroid`` (list)."""
    return f"""(SELECT {keys}, list(s / nullif(n, 0) ORDER BY i) AS centroid{extra} FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY {keys})) AS n FROM
  (SELECT {keys}, i, sum(x * w) AS s FROM (SELECT {keys}, {weight} AS w, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS i FROM {rows}) GROUP BY {keys}, i)) GROUP BY {keys})"""
