"""Incremental identity resolution: members with vectors in, clusters and assignments out.

The wide member table (vectors) is only ever read. What changes from stage to stage is the narrow table
(part, member, cluster), and the cluster table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.operators import centroids as C
from lensfold.operators import similarity as S
from lensfold.operators.components import dbscan
from lensfold.operators.gates import band_filter
from lensfold.operators.linkage import average_linkage
from lensfold.operators.pivots import PIVOTS_FROM
from lensfold.operators.sliced import position
from lensfold.session import collect_garbage, cut_lineage

CLUSTER = "cluster_id"


@dataclass(frozen=True)
class Names:
    """Column names of the member table. Cluster columns are fixed by ``CLUSTER_COLUMNS``."""

    part: tuple[str, ...] = ("part",)
    ident: str = "id"
    vec: str = "embedding"
    second: str = "secondary_embedding"
    angles: tuple[str, ...] = ("yaw", "pitch", "roll")
    passed: str = "quality_passed"


@dataclass(frozen=True)
class Policy:
    """What a pass may do with existing clusters."""

    name: str
    creates: bool
    merges: bool
    pose_only: bool  # growth goes to the pose centroid; the main centroid and the size stay as they are
    band: tuple[float, float]
    mode: str


@dataclass(frozen=True)
class ResolveConfig:
    """Default thresholds of the passes."""

    eps: float = 0.45
    min_samples: int = 1
    linkage: float = 0.45
    regular: Policy = Policy("regular", True, True, False, (0.0, 47.0), "regular")
    restricted: Policy = Policy("restricted", False, False, True, (47.0, 120.0), "restricted")
    point_threshold: float = 0.55
    merge_threshold: float = 0.55
    max_small: int = 3
    recovery: bool = True
    batch_size: int | None = None
    recount_sizes: bool = False
    dim: int | None = None
    block: int = S.BLOCK
    pivots_from: int = PIVOTS_FROM
    names: Names = field(default_factory=Names)


CLUSTER_COLUMNS = ("centroid", "pyr_centroid", "secondary_centroid", "cluster_size", "pyr_size")


def empty_clusters(members: DataFrame, names: Names) -> DataFrame:
    spark = members.sparkSession
    part = ", ".join(f"{p} {members.schema[p].dataType.simpleString()}" for p in names.part)
    return spark.createDataFrame(
        [],
        f"{part}, {CLUSTER} string, centroid array<float>, pyr_centroid array<float>, "
        "secondary_centroid array<float>, cluster_size bigint, pyr_size bigint",
    )


@dataclass
class Result:
    """Outcome of one stage, as three tables.

    ``changes``: one row per new, expanded or merged cluster; a null value means "leave as it is".
    ``assigned``: (part, member, cluster). ``absorbed``: (part, cluster, survivor). None means "no rows".
    """

    changes: DataFrame
    assigned: DataFrame | None
    absorbed: DataFrame | None


def member_rows(pending: DataFrame, clusters: DataFrame, n: Names) -> DataFrame:
    """Existing centroids and new vectors as one weighted member set; centroid ids carry a prefix."""
    on = list(n.part)
    parts = pending.select(*on).distinct()
    old = clusters.join(parts, on, "left_semi").select(
        *on, F.concat(F.lit("c:"), F.col(CLUSTER)).alias("mid"), F.col("centroid").alias("v"),
        F.lit(True).alias("is_centroid"), F.col(CLUSTER), F.col("cluster_size").cast("bigint").alias("size"),
        F.greatest(F.col("cluster_size"), F.lit(1)).cast("bigint").alias("weight"),
    )
    new = pending.select(
        *on, F.concat(F.lit("m:"), F.col(n.ident)).alias("mid"), F.col(n.vec).alias("v"),
        F.lit(False).alias("is_centroid"), F.lit(None).cast("string").alias(CLUSTER),
        F.lit(0).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("weight"),
    )
    return old.unionByName(new)


def group_members(rows: DataFrame, n: Names, config: ResolveConfig) -> DataFrame:
    """Final group of every member row; null for noise. Density components first, then average linkage."""
    on = list(n.part)
    labels = cut_lineage(dbscan(rows, "mid", "v", on, config.eps, config.min_samples, config.block, config.pivots_from))
    labelled = rows.join(labels, [*on, "mid"])
    means = C.weighted_unit_mean(
        labelled.where(F.col("label").isNotNull()), [*on, "label"], "v", dim=config.dim, out="mean"
    ).select(*on, "label", "mean")
    linked = average_linkage(means, "label", "mean", on, config.linkage, config.block)  # writes them first thing
    return labelled.join(linked, [*on, "label"], "left").withColumnRenamed("group", "grp")


def classify(grouped: DataFrame, n: Names, config: ResolveConfig, policy: Policy) -> DataFrame:
    """One row per group: kind in new, expanded, merged, unassigned, skipped, with id, size and centroid."""
    on = list(n.part)
    cent, size = F.col("is_centroid"), F.col("size")
    agg = C.vector_sums(
        grouped.where(F.col("grp").isNotNull()).withColumn("v", C.of_length("v", config.dim)), [*on, "grp"], "v", config.dim, "weight",
        {
            "n_centroids": F.count_if(cent),
            "n_members": F.count_if(~cent),
            "old_size": F.sum("size"),
            "_largest": F.min(F.when(cent, F.struct((-size).alias("s"), F.col(CLUSTER).alias("c")))),
            "_first": F.min(F.when(~cent, F.col("mid"))),
        },
    ).withColumnRenamed("_s", "_sum")
    alone = (F.col("n_members") == 0) & (F.col("n_centroids") <= 1)
    kind = (
        F.when(alone, "skipped")
        .when(F.col("n_centroids") == 0, F.lit("new" if policy.creates else "unassigned"))
        .when(F.col("n_centroids") == 1, F.lit("expanded"))
        .otherwise(F.lit("merged" if policy.merges else "unassigned"))
    )
    fresh = F.concat(F.lit("n"), F.substring(F.sha2(F.concat_ws("|", *on, "_first"), 256), 1, 31))
    size_after = F.col("old_size") + F.col("n_members")
    return agg.select(
        *on, "grp", kind.alias("kind"), "n_centroids", "n_members",
        F.when(F.col("n_centroids") == 0, fresh).otherwise(F.col("_largest.c")).alias(CLUSTER),
        (F.lit(None).cast("bigint") if policy.pose_only else size_after).alias("cluster_size"),
        (F.lit(None).cast("array<float>") if policy.pose_only else C.unit_float("_sum")).alias("centroid"),
    )


def run_pass(pending: DataFrame, clusters: DataFrame, config: ResolveConfig, policy: Policy) -> Result:
    n = config.names
    on = list(n.part)
    if config.dim is None:
        config = replace(config, dim=C.vector_dim(pending, n.vec))
    rows = cut_lineage(member_rows(pending, clusters, n))
    grouped = cut_lineage(group_members(rows, n, config))
    collect_garbage(pending.sparkSession)
    groups = cut_lineage(classify(grouped, n, config, policy))
    live = groups.where(F.col("kind").isin("new", "expanded", "merged"))
    target = live.select(*on, "grp", "kind", F.col(CLUSTER).alias("_to"))
    joined = grouped.join(target, [*on, "grp"])
    assigned = joined.where(~F.col("is_centroid")).select(
        *on, F.expr("substring(mid, 3)").alias(n.ident), F.col("_to").alias(CLUSTER)
    )
    absorbed = None
    if policy.merges and not clusters.isEmpty():
        absorbed = joined.where(F.col("is_centroid") & (F.col(CLUSTER) != F.col("_to"))).select(
            *on, CLUSTER, F.col("_to").alias("survivor")
        )
    changes = live.select(*on, "kind", CLUSTER, "cluster_size", "centroid")
    if policy.pose_only:
        grown = pending.select(*on, n.ident, F.col(n.vec).alias("_vec")).join(assigned, [*on, n.ident])
        folded = C.fold_members(clusters, grown, [*on, CLUSTER], "pyr_centroid", "pyr_size", "_vec", dim=config.dim)
        changes = changes.join(folded, [*on, CLUSTER], "left")
    else:
        changes = changes.withColumns(
            {"pyr_centroid": F.lit(None).cast("array<float>"), "pyr_size": F.lit(None).cast("bigint")}
        )
    return Result(changes, assigned, absorbed)


def recover_points(pending: DataFrame, clusters: DataFrame, config: ResolveConfig) -> Result:
    """Attach leftover members to the nearest pose centroid; the size and pose centroid grow, the main one does not."""
    n = config.names
    on = list(n.part)
    posed = clusters.where(F.col("pyr_centroid").isNotNull())
    src = pending.select(*on, F.col(n.ident).cast("string").alias("k"), F.col(n.vec).alias("v"))
    dst = posed.select(*on, F.col(CLUSTER).alias("k"), F.col("pyr_centroid").alias("v"))
    found = S.topk_search(src, dst, "k", "v", on, 1, config.point_threshold, config.block)
    assigned = cut_lineage(found.select(*on, F.col("src").alias(n.ident), F.col("dst").alias(CLUSTER)))
    grown = pending.select(*on, n.ident, F.col(n.vec).alias("_vec")).join(assigned, [*on, n.ident])
    folded = C.fold_members(posed, grown, [*on, CLUSTER], "pyr_centroid", "pyr_size", "_vec", create=False, dim=config.dim)
    counts = assigned.groupBy(*on, CLUSTER).agg(F.count(F.lit(1)).alias("_added"))
    changes = (
        posed.select(*on, CLUSTER, F.col("cluster_size").alias("_old")).join(counts, [*on, CLUSTER]).join(folded, [*on, CLUSTER])
        .select(
            *on, F.lit("expanded").alias("kind"), CLUSTER, (F.col("_old") + F.col("_added")).alias("cluster_size"),
            F.lit(None).cast("array<float>").alias("centroid"), "pyr_centroid", "pyr_size",
        )
    )
    return Result(changes, assigned, None)


def small_matches(clusters: DataFrame, config: ResolveConfig) -> DataFrame:
    """(part, src, dst, score, channel): best established cluster per small cluster."""
    on = list(config.names.part)
    cols = [*on, F.col(CLUSTER).alias("k"), "centroid", "pyr_centroid"]
    small = clusters.where(F.col("cluster_size") <= config.max_small).select(*cols)
    big = clusters.where(F.col("cluster_size") > config.max_small).select(*cols)
    return S.topk_search(small, big, "k", ["centroid", "pyr_centroid"], on, 1, config.merge_threshold, config.block)


def merge_small(clusters: DataFrame, config: ResolveConfig) -> Result:
    """Merge small clusters into the established cluster they resemble most; one merge per target."""
    n = config.names
    on = list(n.part)
    absorbed = cut_lineage(small_matches(clusters, config).select(*on, F.col("src").alias(CLUSTER), F.col("dst").alias("survivor")))
    joins = absorbed.unionByName(absorbed.select(*on, F.col("survivor").alias(CLUSTER), "survivor").distinct())
    rows = clusters.join(joins, [*on, CLUSTER]).select(*on, "survivor", "centroid", F.col("cluster_size").cast("bigint").alias("_w"))
    merged = C.weighted_unit_mean(rows, [*on, "survivor"], "centroid", "_w", dim=config.dim)
    changes = merged.select(
        *on, F.lit("merged").alias("kind"), F.col("survivor").alias(CLUSTER), F.col("weight").alias("cluster_size"), "centroid",
        F.lit(None).cast("array<float>").alias("pyr_centroid"), F.lit(None).cast("bigint").alias("pyr_size"),
    )
    return Result(changes, None, absorbed)


def merged_pose(clusters: DataFrame, absorbed: DataFrame, n: Names, dim: int) -> DataFrame:
    """Pose centroid of survivors and what they absorb, weighted by pose size; (null, 0) when none has one."""
    on = list(n.part)
    joins = absorbed.unionByName(absorbed.select(*on, F.col("survivor").alias(CLUSTER), "survivor").distinct())
    rows = clusters.join(joins, [*on, CLUSTER]).select(*on, "survivor", "pyr_centroid", F.col("pyr_size").cast("bigint").alias("_w"))
    mean = C.weighted_unit_mean(rows, [*on, "survivor"], "pyr_centroid", "_w", empty="null", dim=dim, out="_pose")
    return (
        absorbed.select(*on, "survivor").distinct().join(mean, [*on, "survivor"], "left")
        .select(*on, F.col("survivor").alias(CLUSTER), "_pose",
                F.when(F.col("_pose").isNull(), 0).otherwise(F.col("weight")).cast("bigint").alias("_pose_size"))
    )


def touched(result: Result, n: Names) -> DataFrame:
    return result.changes.select(*n.part, CLUSTER).distinct()


def apply_result(clusters: DataFrame, current: DataFrame, result: Result, config: ResolveConfig) -> tuple[DataFrame, DataFrame]:
    """The next version of (clusters, current). ``current`` is the narrow table (part, member, cluster)."""
    n = config.names
    on = list(n.part)
    key = [*on, CLUSTER]
    values = ("centroid", "pyr_centroid", "cluster_size", "pyr_size")
    new = result.changes.select(*key, "kind", *[F.col(v).alias(f"_{v}") for v in values])
    kept = clusters.join(new.where("kind <> 'new'"), key, "left")
    if result.absorbed is None:
        kept = kept.withColumns({"_merged": F.lit(False), "_pose": F.lit(None).cast("array<float>"), "_pose_size": F.lit(0)})
    else:
        pose = merged_pose(clusters, result.absorbed, n, config.dim).withColumn("_merged", F.lit(True))
        kept = kept.join(result.absorbed.select(*key), key, "left_anti").join(pose, key, "left")
    updated = kept.select(
        *key,
        F.coalesce("_centroid", "centroid").alias("centroid"),
        F.when(F.col("_merged"), F.col("_pose")).otherwise(F.coalesce("_pyr_centroid", "pyr_centroid")).alias("pyr_centroid"),
        "secondary_centroid",
        F.coalesce("_cluster_size", "cluster_size").cast("bigint").alias("cluster_size"),
        F.when(F.col("_merged"), F.col("_pose_size")).otherwise(F.coalesce("_pyr_size", "pyr_size")).cast("bigint").alias("pyr_size"),
    )
    born = new.where("kind = 'new'").select(
        *key, F.col("_centroid").alias("centroid"), F.lit(None).cast("array<float>").alias("pyr_centroid"),
        F.lit(None).cast("array<float>").alias("secondary_centroid"), F.col("_cluster_size").alias("cluster_size"),
        F.lit(0).cast("bigint").alias("pyr_size"),
    )
    members = current
    if result.absorbed is not None:
        follow = result.absorbed.select(*key, F.col("survivor").alias("_survivor"))
        members = members.join(follow, key, "left").select(*on, n.ident, F.coalesce("_survivor", CLUSTER).alias(CLUSTER))
    if result.assigned is not None:
        moved = result.assigned.select(*on, n.ident, F.col(CLUSTER).alias("_assigned"))
        members = members.join(moved, [*on, n.ident], "left").select(*on, n.ident, F.coalesce("_assigned", CLUSTER).alias(CLUSTER))
    return cut_lineage(updated.unionByName(born)), cut_lineage(members)


@dataclass
class Resolved:
    clusters: DataFrame
    members: DataFrame  # narrow: part, member, cluster (null = unassigned)
    report: DataFrame  # part, stage, kind, n


def _batches(pending: DataFrame, config: ResolveConfig) -> list[DataFrame]:
    if pending.isEmpty():
        return []
    if config.batch_size is None:
        return [pending]
    numbered = cut_lineage(
        position(pending, config.names.part, [config.names.ident], "_at")
        .withColumn("_batch", F.floor((F.col("_at") - 1) / config.batch_size).cast("int")).drop("_at")
    )
    last = numbered.agg(F.max("_batch").alias("m")).first().m  # places have no gaps, so no batch up to the last is empty
    return [numbered.where(F.col("_batch") == b).drop("_batch") for b in range(0 if last is None else last + 1)]


def resolve(members: DataFrame, clusters: DataFrame | None, config: ResolveConfig = ResolveConfig()) -> Resolved:
    """Regular pass, restricted pass, point recovery, small-cluster merge.

    ``members`` holds vectors, angles and the current ``cluster_id``. Each stage sees what the stage before wrote.
    """
    n = config.names
    on = list(n.part)
    if config.dim is None:
        config = replace(config, dim=C.vector_dim(members, n.vec))
    clusters = empty_clusters(members, n) if clusters is None else clusters
    current = cut_lineage(members.select(*on, F.col(n.ident).cast("string").alias(n.ident), CLUSTER))
    usable = members.where(F.col(n.passed)).withColumn(n.ident, F.col(n.ident).cast("string"))
    changed: list[DataFrame] = []
    reports: list[DataFrame] = []

    def pending(policy: Policy) -> DataFrame:
        free = current.where(F.col(CLUSTER).isNull()).select(*on, n.ident)
        in_band = band_filter(usable, n.angles, *policy.band, policy.mode).select(*on, n.ident, n.vec)
        return in_band.join(free, [*on, n.ident], "left_semi")

    def commit(stage: str, result: Result) -> None:
        nonlocal clusters, current
        assigned, absorbed = (None if df is None else cut_lineage(df) for df in (result.assigned, result.absorbed))
        if all(df is None or df.isEmpty() for df in (assigned, absorbed)):
            return
        result = Result(cut_lineage(result.changes), assigned, None if absorbed is None or absorbed.isEmpty() else absorbed)
        clusters, current = apply_result(clusters, current, result, config)
        collect_garbage(members.sparkSession)
        changed.append(touched(result, n))
        reports.append(result.changes.groupBy(*on, F.lit(stage).alias("stage"), "kind").agg(F.count(F.lit(1)).alias("n")))

    for policy in (config.regular, config.restricted):
        for batch in _batches(cut_lineage(pending(policy)), config):
            commit(policy.name, run_pass(batch, clusters, config, policy))
    if config.recovery:
        for batch in _batches(cut_lineage(pending(config.restricted)), config):
            commit("recover_points", recover_points(batch, clusters, config))
        commit("merge_small", merge_small(clusters, config))

    if not changed:
        empty = clusters.where("false").select(*on, F.lit("").alias("stage"), F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("n"))
        return Resolved(clusters, current, empty)
    clusters = _finish(clusters, current, members, reduce(DataFrame.unionByName, changed), config)
    return Resolved(clusters, current, reduce(DataFrame.unionByName, reports))


def _finish(clusters: DataFrame, current: DataFrame, members: DataFrame, everything: DataFrame, config: ResolveConfig) -> DataFrame:
    """Secondary centroids of every touched cluster, once at the end: only membership decides them."""
    n = config.names
    on = list(n.part)
    if n.second in members.columns:
        second = members.select(*on, F.col(n.ident).cast("string").alias(n.ident), n.second).where(F.col(n.second).isNotNull())
        owned = second.join(current.where(F.col(CLUSTER).isNotNull()), [*on, n.ident])
        clusters = C.refresh_from_members(clusters, owned, everything, [*on, CLUSTER], n.second, "secondary_centroid", config.dim)
    if config.recount_sizes:
        counted = current.where(F.col(CLUSTER).isNotNull()).groupBy(*on, CLUSTER).agg(F.count(F.lit(1)).alias("_n"))
        clusters = clusters.join(counted, [*on, CLUSTER], "left").withColumn(
            "cluster_size", F.coalesce("_n", F.lit(0)).cast("bigint")
        ).drop("_n")
    return clusters
