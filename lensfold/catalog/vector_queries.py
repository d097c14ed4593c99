"""Vector functions, similarity joins, centroids, identity resolution and matching."""

from dataclasses import replace

from pyspark.sql import functions as F

from lensfold.catalog import vector_roles as R
from lensfold.catalog.registry import query
from lensfold.functions import vectors as V
from lensfold.operators import centroids as C
from lensfold.operators import similarity as S
from lensfold.operators.components import dbscan
from lensfold.operators.gates import band_filter, size_class
from lensfold.operators.linkage import average_linkage
from lensfold.operators.listing import best_target, first_n
from lensfold.operators.scoring import score_batches
from lensfold.operators.vector_index import indexed_topk
from lensfold.plans import evaluation, identity, matching

PART = ["part"]
NAMES = identity.Names(vec="v", second="second", passed="passed")
ONE = identity.ResolveConfig(names=NAMES, dim=64)
TWO = identity.ResolveConfig(names=NAMES, dim=64, eps=0.08)


def _pick(vec, *places):
    """A few components and their sum: enough to tell vectors apart in a result row."""
    return [F.round(F.element_at(vec, p).cast("double"), 5).alias(f"x{p}") for p in places] + [
        F.round(F.aggregate(F.transform(vec, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total")
    ]


def _sql_pick(vec, *places):
    return ", ".join([f"round({vec}[{p}], 5) AS x{p}" for p in places] + [f"round(list_sum({vec}), 4) AS total"])


@query("i1_unit_vectors", f"""WITH {R.SQL_MACROS}, s AS (SELECT vec_id, list_transform(e, lambda x: x * (vec_id % 5)) AS v FROM emb)
SELECT vec_id, round(CASE WHEN list_dot_product(v, v) > 0 THEN list_sum(v) / sqrt(list_dot_product(v, v)) ELSE 0 END, 6) AS total FROM s""")
def i1(t):
    v = V.unit(V.scale("e", F.pmod("vec_id", F.lit(5)).cast("double")))
    return R.base(t).select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("i2_cosine", f"""WITH {R.SQL_MACROS} SELECT m.vec_id, round(list_cosine_similarity(m.e, a.e), 6) AS cosine, round(list_dot_product(m.e, a.e), 6) AS dot,
  round(1 - list_cosine_similarity(m.e, a.e), 6) AS distance FROM emb m JOIN emb a ON a.vec_id = m.vec_id % 25""")
def i2(t):
    rows = R.other(R.base(t), t, F.pmod("vec_id", F.lit(25)), "a")
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("vec_id", r(V.cosine("e", "a"), "cosine"), r(V.dot("e", "a"), "dot"), r(V.cosine_distance("e", "a"), "distance"))


@query("c9_similarity_join", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS} SELECT f.part, id AS src, cluster_id AS dst, round(list_cosine_similarity(v, centroid), 6) AS score
  FROM fix f JOIN cl ON cl.part = f.part AND list_cosine_similarity(v, centroid) >= 0.3""")
def c9(t):
    left = R.single_level(t).select("part", F.col("id").alias("k"), "v")
    right = R.clusters(t).select("part", F.col("cluster_id").alias("k"), F.col("centroid").alias("v"))
    return S.similarity_join(left, right, "k", "v", PART, 0.3).withColumn("score", F.round("score", 6))


@query("c9_self_pairs", f"""WITH {R.SQL_SINGLE} SELECT a.part, a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS score
  FROM fix a JOIN fix b ON a.part = b.part AND a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.9""")
def c9_self(t):
    return S.self_pairs(R.single_level(t), "id", "v", PART, 0.9).withColumn("score", F.round("score", 6)).select("part", "src", "dst", "score")


@query("c10_topk_search", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, s AS (SELECT f.part, id AS src, cluster_id AS dst, list_cosine_similarity(v, centroid) AS score FROM fix f JOIN cl ON cl.part = f.part),
r AS (SELECT *, row_number() OVER (PARTITION BY part, src ORDER BY score DESC, dst) AS rank FROM s WHERE score >= 0.05)
SELECT part, src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def c10(t):
    left = R.single_level(t).select("part", F.col("id").alias("k"), "v")
    right = R.clusters(t).select("part", F.col("cluster_id").alias("k"), F.col("centroid").alias("v"))
    return S.topk_search(left, right, "k", "v", PART, 4, 0.05).withColumn("score", F.round("score", 6))


@query("c10_indexed", f"""WITH {R.SQL_SINGLE}, s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS score FROM fix a JOIN fix b ON a.vec_id % 5 = 0 AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 12) DESC, dst) AS rank FROM s WHERE score >= 0.55)
SELECT src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def c10_indexed(t):
    """All vectors in one key: the index answers from 500 rows on. A row is among its own targets, so six are asked for."""
    rows = R.single_level(t).select(F.lit(0).alias("all"), "vec_id", F.col("id").alias("k"), "v")
    hits = indexed_topk(rows.where("vec_id % 5 = 0").drop("vec_id"), rows.drop("vec_id"), "k", "v", ["all"], 6, 0.55).where("src <> dst").drop("rank")
    return first_n(hits, ["src"], [F.col("score").desc(), F.col("dst")], 5).select("src", "dst", F.round("score", 6).alias("score"), "rank")


# Unit vectors once, so that a pair costs dot products; the large tables are not inlined again.
C17 = """, u AS MATERIALIZED (SELECT part, cluster_id, cluster_size, list_transform([sqrt(list_dot_product(centroid, centroid))], lambda n: list_transform(centroid, lambda x: x / n))[1] AS m,
  list_transform([sqrt(list_dot_product(pyr_centroid, pyr_centroid))], lambda n: list_transform(pyr_centroid, lambda x: x / n))[1] AS p FROM cl),
p AS MATERIALIZED (SELECT a.part, a.cluster_id AS src, b.cluster_id AS dst, list_dot_product(a.m, b.m) AS mm, coalesce(list_dot_product(a.m, b.p), -2) AS mp, coalesce(list_dot_product(a.p, b.p), -2) AS pp
  FROM u a JOIN u b ON a.part = b.part AND a.cluster_size <= 3 AND b.cluster_size > 3),
q AS (SELECT part, src, dst, greatest(mm, mp, pp) AS score, CASE WHEN pp > greatest(mm, mp) THEN 'pyr_centroid' WHEN mp > mm THEN 'centroid_vs_pyr' ELSE 'centroid' END AS channel FROM p)"""


@query("c17_max_channel", f"WITH {R.SQL_MACROS}, {R.SQL_CLUSTERS} {C17} SELECT part, src, dst, round(score, 6) AS score, channel FROM q WHERE score >= 0.1")
def c17(t):
    sized = size_class(R.clusters(t), "cluster_size")
    small, big = (sized.where(F.col("size_class") == s) for s in ("small", "established"))
    out = S.max_channel_similarity(small, big, "cluster_id", "centroid", "pyr_centroid", PART, 0.1)
    return out.withColumn("score", F.round("score", 6))


MEAN = "SELECT part, anchor, " + _sql_pick("centroid", 1, 33) + " FROM "


@query("d8_weighted_unit_mean", f"WITH {R.SQL_SINGLE} {MEAN} {R.sql_unit_mean('fix', 'part, anchor', 'v', 'vec_id % 5 + 1')}")
def d8(t):
    rows = R.single_level(t).withColumn("w", F.pmod("vec_id", F.lit(5)) + 1)
    return C.weighted_unit_mean(rows, ["part", "anchor"], "v", "w", dim=64).select("part", "anchor", *_pick("centroid", 1, 33))


@query("d9_mean_or_null", f"WITH {R.SQL_SINGLE} {MEAN} {R.sql_unit_mean('(SELECT * FROM fix WHERE second IS NOT NULL)', 'part, anchor', 'second')}")
def d9(t):
    return C.weighted_unit_mean(R.single_level(t), ["part", "anchor"], "second", empty="null", dim=64).select("part", "anchor", *_pick("centroid", 1, 33))



@query("d10_merged_pose", f"""WITH {R.SQL_MACROS}, {R.SQL_CLUSTERS}, grp AS (SELECT part, 'cv' || substr(cluster_id, 3) AS survivor, pyr_centroid, pyr_size FROM cl WHERE vec_id % 3 = 1),
m AS (FROM {R.sql_unit_mean('(FROM grp WHERE pyr_centroid IS NOT NULL AND pyr_size > 0)', 'part, survivor', 'pyr_centroid', 'pyr_size')}),
n AS (SELECT part, survivor, sum(pyr_size) AS pyr_size FROM grp WHERE pyr_centroid IS NOT NULL AND pyr_size > 0 GROUP BY 1, 2)
SELECT DISTINCT part, survivor AS cluster_id, CAST(coalesce(n.pyr_size, 0) AS BIGINT) AS pyr_size, coalesce(round(list_sum(centroid), 4), -9) AS total FROM (SELECT DISTINCT part, survivor FROM grp)
  LEFT JOIN m USING (part, survivor) LEFT JOIN n USING (part, survivor)""")
def d10(t):
    cl = R.clusters(t)
    absorbed = cl.where("cluster_id like 't%'").select("part", "cluster_id", F.concat(F.lit("c"), F.substring("cluster_id", 2, 99)).alias("survivor"))
    pose = identity.merged_pose(cl, absorbed, NAMES, 64)
    total = F.round(F.aggregate(F.transform("_pose", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4)
    return pose.select("part", "cluster_id", F.col("_pose_size").alias("pyr_size"), F.coalesce(total, F.lit(-9.0)).alias("total"))


def _members_of_clusters(t):
    return R.single_level(t).withColumn("cluster_id", F.concat(F.lit("c"), R.key("anchor")))


D11 = """rows AS (SELECT part, cluster_id, pyr_centroid AS v, greatest(pyr_size, 1) AS w FROM cl WHERE pyr_centroid IS NOT NULL AND cluster_id LIKE 'c%'
  UNION ALL SELECT part, 'cv' || lpad(CAST(anchor AS VARCHAR), 9, '0'), v, 1 FROM fix)"""


@query("d11_fold_members", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {D11}, n AS (SELECT part, cluster_id, CAST(sum(w) AS BIGINT) AS pyr_size FROM rows GROUP BY 1, 2)
SELECT part, cluster_id, pyr_size, {_sql_pick('centroid', 2)} FROM {R.sql_unit_mean('rows', 'part, cluster_id', 'v', 'w')} JOIN n USING (part, cluster_id)""")
def d11(t):
    out = C.fold_members(R.clusters(t), _members_of_clusters(t), ["part", "cluster_id"], "pyr_centroid", "pyr_size", "v", dim=64)
    return out.select("part", "cluster_id", "pyr_size", *_pick("pyr_centroid", 2))


@query("d12_refresh_secondary", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, m AS (SELECT part, 'cv' || lpad(CAST(anchor AS VARCHAR), 9, '0') AS cluster_id, second FROM fix WHERE second IS NOT NULL),
f AS (FROM {R.sql_unit_mean('m', 'part, cluster_id', 'second')}), r AS (SELECT part, cluster_id, CASE WHEN cluster_size % 2 = 0 THEN f.centroid ELSE secondary_centroid END AS s FROM cl LEFT JOIN f USING (part, cluster_id))
SELECT part, cluster_id, coalesce(round(list_sum(s), 4), -9) AS total FROM r""")
def d12(t):
    cl = R.clusters(t)
    touched = cl.where("cluster_size % 2 = 0")
    out = C.refresh_from_members(
        cl.withColumn("secondary_centroid", F.col("secondary_centroid").cast("array<float>")), _members_of_clusters(t), touched,
        ["part", "cluster_id"], "second", "secondary_centroid", 64,
    )
    total = F.round(F.aggregate(F.transform("secondary_centroid", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4)
    return out.select("part", "cluster_id", F.coalesce(total, F.lit(-9.0)).alias("total"))


@query("d17_best_score", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS} SELECT f.part, round(max(list_cosine_similarity(second, centroid)), 6) AS best FROM fix f JOIN cl USING (part) WHERE second IS NOT NULL GROUP BY 1""")
def d17(t):
    left = R.single_level(t).where("second IS NOT NULL").select("part", F.col("id").alias("k"), F.col("second").alias("v"))
    right = R.clusters(t).select("part", F.col("cluster_id").alias("k"), F.col("centroid").alias("v"))
    return S.topk_search(left, right, "k", "v", PART, 1, -1.0).groupBy("part").agg(F.round(F.max("score"), 6).alias("best"))


@query("e1_best_target", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, p AS (SELECT f.part, id AS src, cluster_id AS dst, list_cosine_similarity(v, pyr_centroid) AS score FROM fix f JOIN cl ON cl.part = f.part WHERE pyr_centroid IS NOT NULL)
SELECT part, src, dst, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY part, src ORDER BY score DESC, dst) AS rn FROM p WHERE score >= 0.55) WHERE rn = 1""")
def e1(t):
    left = R.single_level(t).select("part", F.col("id").alias("k"), "v")
    right = R.clusters(t).where("pyr_centroid IS NOT NULL").select("part", F.col("cluster_id").alias("k"), F.col("pyr_centroid").alias("v"))
    best = S.topk_search(left, right, "k", "v", PART, 1, 0.3)
    return best_target(best, PART, "src", "dst", "score", 0.55).select("part", "src", "dst", F.round("score", 6).alias("score"))


@query("g1_member_rows", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS} SELECT part, 'c:' || cluster_id AS mid, cluster_id, CAST(greatest(cluster_size, 1) AS BIGINT) AS weight FROM cl
UNION ALL SELECT part, 'm:' || id, '-', CAST(1 AS BIGINT) FROM fix""")
def g1(t):
    rows = identity.member_rows(R.single_level(t), R.clusters(t), NAMES)
    return rows.select("part", "mid", F.coalesce("cluster_id", F.lit("-")).alias("cluster_id"), "weight")


@query("h1_components", f"WITH RECURSIVE {R.SQL_SINGLE}, {R.sql_components(0.55)} SELECT part, id, label FROM comp")
def h1(t):
    return dbscan(R.single_level(t), "id", "v", PART, 0.45)


@query("h1_pivots", f"WITH RECURSIVE {R.SQL_SINGLE.replace('fix AS', 'cut AS')}, fix AS (SELECT 0 AS part, id, v FROM cut), {R.sql_components(0.75)} SELECT id, label FROM comp")
def h1_pivots(t):
    """All vectors in one key, cut by pivots."""
    rows = R.single_level(t).select(F.lit(0).alias("part"), "id", "v")
    return dbscan(rows, "id", "v", PART, 0.25, pivots_from=0).select("id", "label")


@query("k2_wide_vectors", f"""WITH {R.SQL_MACROS}, l AS (SELECT label, flatten(list_transform(range(8), lambda k: list_transform(e, lambda x: x * (k + 1)))) AS w FROM embeddings JOIN emb USING (vec_id))
SELECT label, {_sql_pick('centroid', 1, 512)} FROM {R.sql_unit_mean('l', 'label', 'w')}""")
def k2_wide(t):
    """Eight multiples of each vector behind one another: 512 dimensions."""
    parts = [V.scale("embedding", F.lit(float(k))) for k in range(1, 9)]
    rows = t.raw("embeddings").select("label", F.concat(*parts).alias("w"))
    return C.weighted_unit_mean(rows, ["label"], "w", dim=512).select("label", *_pick("centroid", 1, 512))


@query("h1_dbscan_noise", f"""WITH RECURSIVE {R.SQL_SINGLE}, all_edge AS (SELECT a.part, a.id AS u, b.id AS w FROM fix a JOIN fix b ON a.part = b.part AND list_cosine_similarity(a.v, b.v) >= 0.925),
core AS (SELECT part, u AS id FROM all_edge GROUP BY 1, 2 HAVING count(*) >= 4), fix2 AS (SELECT f.part, f.id, f.v FROM fix f JOIN core USING (part, id)), {R.sql_components(0.925, 'fix2')}
SELECT part, id, coalesce(c.label, b.label, '-') AS label FROM fix LEFT JOIN comp c USING (part, id)
  LEFT JOIN (SELECT e.part, e.u AS id, min(label) AS label FROM all_edge e JOIN comp ON comp.part = e.part AND comp.id = e.w GROUP BY 1, 2) b USING (part, id)""")
def h1_noise(t):
    return dbscan(R.single_level(t), "id", "v", PART, 0.075, min_samples=4).select("part", "id", F.coalesce("label", F.lit("-")).alias("label"))


@query("h2_average_linkage", f"""WITH {R.SQL_TWO} SELECT part, id, 'v' || lpad(CAST(macro AS VARCHAR), 9, '0') AS "group" FROM fix""")
def h2(t):
    """The twin is the planted truth: every wide group ends under its smallest member."""
    return average_linkage(R.two_level(t), "id", "v", PART, 0.45)


def _existing(t):
    """Clusters for even anchors, with the small twins: anchors with 0, 1 and 2 clusters."""
    return R.clusters(t).where("vec_id % 2 = 0").withColumns(
        {c: F.col(c).cast("array<float>") for c in ("centroid", "pyr_centroid", "secondary_centroid")}
    )


GROUPS = """ex AS (SELECT * FROM cl WHERE vec_id % 2 = 0),
g AS (SELECT part, anchor, count(*) AS members, 'm:' || min(id) AS first FROM fix GROUP BY 1, 2),
c AS (SELECT part, vec_id AS anchor, count(*) AS cents, CAST(sum(cluster_size) AS BIGINT) AS old, arg_min(cluster_id, (-cluster_size, cluster_id)) AS survivor FROM ex GROUP BY 1, 2),
o AS (SELECT part, anchor, coalesce(cents, 0) AS n_centroids, members AS n_members, coalesce(old, 0) + members AS size,
  CASE WHEN cents IS NULL THEN 'n' || substr(sha256(part || '|' || first), 1, 31) ELSE survivor END AS cluster_id FROM g LEFT JOIN c USING (part, anchor))"""


@query("h3_outcomes", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {GROUPS}
SELECT part, CASE n_centroids WHEN 0 THEN 'new' WHEN 1 THEN 'expanded' ELSE 'merged' END AS kind, cluster_id, n_centroids, n_members, CAST(size AS BIGINT) AS cluster_size FROM o""")
def h3(t):
    """The twin takes the planted groups as given and classifies them."""
    rows = identity.member_rows(R.single_level(t), _existing(t), NAMES)
    groups = identity.classify(identity.group_members(rows, NAMES, ONE), NAMES, ONE, ONE.regular)
    return groups.select("part", "kind", "cluster_id", "n_centroids", "n_members", "cluster_size")


@query("h4_restricted_pass", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {GROUPS}, e AS (SELECT o.part, cluster_id, n_members, ex.pyr_centroid IS NULL AS fresh, greatest(ex.pyr_size, 1) AS ps FROM o JOIN ex USING (part, cluster_id) WHERE n_centroids = 1)
SELECT part, cluster_id, CAST(CASE WHEN fresh THEN n_members ELSE ps + n_members END AS BIGINT) AS pyr_size, CAST(-1 AS BIGINT) AS cluster_size FROM e""")
def h4(t):
    out = identity.run_pass(R.single_level(t), _existing(t), ONE, ONE.restricted)
    return out.changes.select("part", "cluster_id", "pyr_size", F.coalesce("cluster_size", F.lit(-1)).alias("cluster_size"))


@query("h5_recover_points", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, p AS (SELECT f.part, id, cluster_id, list_cosine_similarity(v, pyr_centroid) AS score, cluster_size, pyr_size FROM fix f JOIN cl ON cl.part = f.part WHERE pyr_centroid IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, id ORDER BY score DESC, cluster_id) AS rn FROM p WHERE score >= 0.55) WHERE rn = 1)
SELECT part, cluster_id, CAST(any_value(cluster_size) + count(*) AS BIGINT) AS cluster_size, CAST(greatest(any_value(pyr_size), 1) + count(*) AS BIGINT) AS pyr_size FROM b GROUP BY 1, 2""")
def h5(t):
    out = identity.recover_points(R.single_level(t), R.clusters(t), ONE)
    return out.changes.select("part", "cluster_id", F.col("cluster_size").cast("bigint").alias("cluster_size"), "pyr_size")


H6 = C17 + """, b AS (SELECT part, src, arg_min(dst, (-score, dst)) AS dst FROM q WHERE score >= 0.55 GROUP BY 1, 2),
joins AS (SELECT part, src AS cluster_id, dst AS survivor FROM b UNION SELECT part, dst, dst FROM b)"""


@query("h6_merge_small", f"""WITH {R.SQL_MACROS}, {R.SQL_CLUSTERS} {H6}, r AS (SELECT part, survivor, centroid AS v, cluster_size AS w FROM cl JOIN joins USING (part, cluster_id)),
n AS (SELECT part, survivor, CAST(sum(w) AS BIGINT) AS cluster_size FROM r GROUP BY 1, 2)
SELECT part, survivor AS cluster_id, cluster_size, {_sql_pick('centroid', 3)} FROM {R.sql_unit_mean('r', 'part, survivor', 'v', 'w')} JOIN n USING (part, survivor)""")
def h6(t):
    out = identity.merge_small(R.clusters(t), ONE)
    return out.changes.select("part", "cluster_id", "cluster_size", *_pick("centroid", 3))


@query("h7_apply_result", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {GROUPS}, f AS (SELECT part, cluster_id, size FROM o UNION ALL SELECT part, cluster_id, cluster_size FROM ex
  WHERE (part, cluster_id) NOT IN (SELECT part, cluster_id FROM o) AND (part, vec_id) NOT IN (SELECT part, anchor FROM o))
SELECT f.part, f.cluster_id, CAST(f.size AS BIGINT) AS cluster_size, CAST(coalesce(n_members, 0) AS BIGINT) AS members FROM f LEFT JOIN o USING (part, cluster_id)""")
def h7(t):
    members, clusters = R.single_level(t), _existing(t)
    result = identity.run_pass(members, clusters, ONE, ONE.regular)
    current = members.select("part", "id", F.lit(None).cast("string").alias("cluster_id"))
    after, current = identity.apply_result(clusters, current, result, ONE)
    counted = current.groupBy("part", "cluster_id").agg(F.count(F.lit(1)).alias("members"))
    return after.join(counted, ["part", "cluster_id"], "left").select("part", "cluster_id", "cluster_size", F.coalesce("members", F.lit(0)).alias("members"))


H8 = """reg AS (SELECT part, macro, 'n' || substr(sha256(part || '|m:' || min(id)), 1, 31) AS cluster_id, count(*) AS cluster_size FROM fix WHERE passed AND yaw < 47 GROUP BY 1, 2),
res AS (SELECT part, macro, count(*) AS pyr_size FROM fix WHERE passed AND yaw >= 47 AND yaw <= 120 GROUP BY 1, 2),
cl8 AS (SELECT part, macro, cluster_id, CAST(cluster_size AS BIGINT) AS cluster_size, CAST(coalesce(pyr_size, 0) AS BIGINT) AS pyr_size FROM reg LEFT JOIN res USING (part, macro))"""


H8_SQL = f"""WITH {R.SQL_TWO}, {H8} SELECT f.part, f.id, coalesce(c.cluster_id, '-') AS cluster_id, coalesce(cluster_size, -1) AS cluster_size, coalesce(pyr_size, -1) AS pyr_size
  FROM fix f LEFT JOIN cl8 c ON c.part = f.part AND c.macro = f.macro AND f.passed AND f.yaw <= 120"""


def _resolved(t, config):
    out = identity.resolve(R.two_level(t), None, config)
    info = out.clusters.select("part", "cluster_id", "cluster_size", "pyr_size")
    return out.members.join(info, ["part", "cluster_id"], "left").select(
        "part", "id", F.coalesce("cluster_id", F.lit("-")).alias("cluster_id"), F.coalesce("cluster_size", F.lit(-1)).alias("cluster_size"),
        F.coalesce("pyr_size", F.lit(-1)).alias("pyr_size"),
    )


@query("h8_resolve", H8_SQL)
def h8(t):
    """The twin says who must end up together from the planted groups, the pose bands and the quality flag."""
    return _resolved(t, TWO)


@query("j11_incremental_resolve", H8_SQL)
def j11(t):
    """Vectors arrive in batches by id; later batches meet the centroids of earlier ones and end in the same groups."""
    return _resolved(t, replace(TWO, batch_size=40))


@query("d19_touched_clusters", f"WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {GROUPS} SELECT part, cluster_id FROM o")
def d19(t):
    return identity.touched(identity.run_pass(R.single_level(t), _existing(t), ONE, ONE.regular), NAMES)


D20 = """cell AS (SELECT part, label, anchor, count(*) AS n FROM a GROUP BY ALL), bc AS (SELECT part, label, count(*) AS k, sum(n) AS n FROM cell GROUP BY ALL), bl AS (SELECT part, anchor, count(*) AS k, sum(n) AS n FROM cell GROUP BY ALL)
SELECT part, c.clusters, l.labels, CAST(members AS BIGINT) AS members, round(CAST(pure AS DOUBLE) / clusters, 4) AS purity, round(CAST(whole AS DOUBLE) / labels, 4) AS completeness,
  round(CAST(shared AS DOUBLE) / pc, 4) AS precision, round(CAST(shared AS DOUBLE) / pl, 4) AS recall FROM (SELECT part, sum(n * (n - 1)) AS shared FROM cell GROUP BY 1)
JOIN (SELECT part, count(*) AS clusters, sum(n) AS members, count(*) FILTER (WHERE k = 1) AS pure, sum(n * (n - 1)) AS pc FROM bc GROUP BY 1) c USING (part)
JOIN (SELECT part, count(*) AS labels, count(*) FILTER (WHERE k = 1) AS whole, sum(n * (n - 1)) AS pl FROM bl GROUP BY 1) l USING (part)"""


@query("d20_cluster_quality", f"WITH RECURSIVE {R.SQL_SINGLE}, {R.sql_components(0.93)}, a AS (SELECT part, label, anchor FROM comp JOIN fix USING (part, id)), {D20}")
def d20(t):
    found = dbscan(R.single_level(t), "id", "v", PART, 0.07)
    truth = R.single_level(t).select("part", "id", "anchor")
    return evaluation.cluster_quality(found.join(truth, ["part", "id"]), "label", "anchor", PART)


@query("d20_match_quality", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, b AS (SELECT id, any_value(anchor) AS anchor, arg_max(cl.vec_id, list_cosine_similarity(second, pyr_centroid)) FILTER (WHERE list_cosine_similarity(second, pyr_centroid) >= 0.2) AS found
  FROM fix f JOIN cl ON cl.part = f.part WHERE second IS NOT NULL AND pyr_centroid IS NOT NULL GROUP BY 1)
SELECT count(*) AS queries, count(found) AS matched, round(count(*) FILTER (WHERE found = anchor) / count(*), 4) AS accuracy, round(count(*) FILTER (WHERE found <> anchor) / count(*), 4) AS false_match_rate FROM b""")
def d20_match(t):
    asked = R.single_level(t).where("second IS NOT NULL")
    right = R.clusters(t).where("pyr_centroid IS NOT NULL")
    hits = S.topk_search(
        asked.select("part", F.col("id").alias("k"), F.col("second").alias("v")), right.select("part", F.col("cluster_id").alias("k"), F.col("pyr_centroid").alias("v")),
        "k", "v", PART, 1, 0.2,
    ).select("part", F.col("src").alias("id"), F.substring("dst", 3, 9).cast("bigint").alias("found"))
    return evaluation.match_quality(asked.join(hits, ["part", "id"], "left"), "id", "found", "anchor")


MATCH = """s AS (SELECT f.part, id AS query_id, cluster_id, list_cosine_similarity(v, centroid) AS sim, second IS NULL AS untagged, coalesce(list_cosine_similarity(second, secondary_centroid), -2) >= 0.55 AS agrees
  FROM fix f JOIN cl ON cl.part = f.part),
r AS (SELECT *, row_number() OVER (PARTITION BY part, query_id ORDER BY sim DESC, cluster_id) AS rank FROM s WHERE sim >= 0.55), m AS (SELECT * FROM r WHERE rank <= 5)"""


def _match(t):
    return matching.match(R.single_level(t).withColumnRenamed("id", "query_id"), R.clusters(t), "query_id", "cluster_id", PART, "v", "second")


@query("e4_ranked_matches", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {MATCH} SELECT part, query_id, cluster_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank, CASE WHEN untagged OR agrees THEN 'high' ELSE 'low' END AS confidence FROM m""")
def e4(t):
    return _match(t).select("part", "query_id", "cluster_id", F.round("similarity", 6).alias("similarity"), "rank", "confidence")


@query("g4_agreement", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {MATCH} SELECT part, query_id, cluster_id FROM m WHERE agrees""")
def g4(t):
    tagged = R.single_level(t).where("second IS NOT NULL").withColumnRenamed("id", "query_id")
    hits = matching.match(tagged, R.clusters(t), "query_id", "cluster_id", PART, "v", "second")
    return hits.where("confidence = 'high'").select("part", "query_id", "cluster_id")


@query("i15_match_status", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {MATCH}, q AS (SELECT part + CASE WHEN vec_id % 17 = 0 THEN 90 ELSE 0 END AS part, id FROM fix)
SELECT q.part, q.id AS query_id, count(m.cluster_id) AS matches, CASE WHEN q.part >= 90 THEN 'no_clusters' WHEN count(m.cluster_id) = 0 THEN 'no_match' ELSE 'matched' END AS status
  FROM q LEFT JOIN m ON m.part = q.part AND m.query_id = q.id GROUP BY 1, 2""")
def i15(t):
    asked = R.single_level(t).withColumnRenamed("id", "query_id").withColumn("part", F.when(F.col("vec_id") % 17 == 0, F.col("part") + 90).otherwise(F.col("part")))
    hits = matching.match(asked, R.clusters(t), "query_id", "cluster_id", PART, "v", dual=False)
    return matching.match_status(asked, R.clusters(t), hits, "query_id", PART).select("part", "query_id", "matches", "status")


@query("c12_match_fanout", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {MATCH}, mem AS (SELECT DISTINCT part, 'cv' || lpad(CAST(anchor AS VARCHAR), 9, '0') AS cluster_id, photo_id FROM fix)
SELECT DISTINCT part, query_id, photo_id FROM m JOIN mem USING (part, cluster_id)""")
def c12(t):
    return matching.matched_photos(_match(t), _members_of_clusters(t), "query_id", "cluster_id", "photo_id", PART)


@query("d21_run_metrics", f"""WITH {R.SQL_SINGLE}, {R.SQL_CLUSTERS}, {MATCH}, q AS (SELECT f.part, f.id, count(m.cluster_id) AS n FROM fix f LEFT JOIN m ON m.part = f.part AND m.query_id = f.id GROUP BY 1, 2),
z AS (SELECT part, anchor, count(*) AS n FROM fix GROUP BY 1, 2)
SELECT part, (SELECT count(*) FROM fix x WHERE x.part = q.part) AS faces, (SELECT round(count(*) FILTER (WHERE vec_id % 13 = 0) / count(*), 4) FROM fix x WHERE x.part = q.part) AS rejection_rate,
  (SELECT count(*) FROM z WHERE z.part = q.part) AS clusters, (SELECT round(avg(n), 4) FROM z WHERE z.part = q.part) AS mean_cluster_size,
  round(count(*) FILTER (WHERE n > 0) / count(*), 4) AS match_rate, round(avg(n), 4) AS mean_matches FROM q GROUP BY 1""")
def d21(t):
    members = _members_of_clusters(t).withColumn("passed", F.pmod("vec_id", F.lit(13)) != 0)
    asked = R.single_level(t).withColumnRenamed("id", "query_id")
    status = matching.match_status(asked, R.clusters(t), _match(t), "query_id", PART)
    return evaluation.run_metrics(members, status, PART, "passed", "cluster_id", "matches")


@query("k2_vector_aggregate", f"""WITH {R.SQL_MACROS}, l AS (SELECT label, e FROM embeddings JOIN emb USING (vec_id)) SELECT label, {_sql_pick('centroid', 1, 64)} FROM {R.sql_unit_mean('l', 'label', 'e')}""")
def k2(t):
    return C.weighted_unit_mean(t.raw("embeddings"), ["label"], "embedding", dim=64).select("label", *_pick("centroid", 1, 64))


@query("h8_pending_band", f"WITH {R.SQL_TWO} SELECT part, id FROM fix WHERE passed AND yaw >= 47 AND yaw <= 120")
def h8_pending(t):
    return band_filter(R.two_level(t).where("passed"), ["yaw", "pitch", "roll"], 47, 120, "restricted").select("part", "id")


def _projection():
    import numpy as np

    weights = np.sin(np.arange(64)[:, None] * 17.0 + np.arange(4)[None, :])
    return lambda rows: rows @ weights


@query("k1_score_batches", f"""WITH {R.SQL_MACROS}, p AS (SELECT vec_id, [list_dot_product(e, [sin(i * 17.0 + j) FOR i IN range(64)]) FOR j IN range(4)] AS q FROM emb)
SELECT vec_id, round(CAST(q[1] / sqrt(list_dot_product(q, q)) AS FLOAT)::DOUBLE, 4) AS s1, round(CAST(q[4] / sqrt(list_dot_product(q, q)) AS FLOAT)::DOUBLE, 4) AS s4, 0 AS second FROM p""")
def k1(t):
    def broken():
        def model(rows):
            raise RuntimeError("second model is down")
        return model

    out = score_batches(t.raw("embeddings"), "embedding", _projection, make_second=broken)
    place = lambda i: F.round(F.element_at("score", i).cast("double"), 4).alias(f"s{i}")
    return out.select("vec_id", place(1), place(4), F.col("second_score").isNotNull().cast("int").alias("second"))
