"""Joins that decide what a session may see, and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_of(items: DataFrame, marks: DataFrame, key: str, ts: str) -> DataFrame:
    """Items that were marked (favorites), newest mark first."""
    return marks.join(items, key).orderBy(F.col(ts).desc(), F.col(key))


def matched_items(items: DataFrame, members: DataFrame, matches: DataFrame, item: str, cluster: str, part: Sequence[str]) -> DataFrame:
    """(session, item) pairs: distinct items that have a member in a matched cluster.

    A pair is made once, by the smallest cluster that its session and its item share: both sides carry the clusters that come before in
    their own list. So pairs are neither shuffled nor made distinct, only memberships are moved.

    Memberships are sorted by cluster inside their task before they meet the sessions: neighbouring items then have the same sessions in the
    same order, and the written pairs, which outgrow all tables, take a small part of the disk.
    """
    session = [c for c in matches.columns if c not in (*part, cluster)]
    inside = members.where(F.col(cluster).isNotNull()).select(*part, cluster, item).join(items.select(item), item, "left_semi")
    seen = _by_cluster(_with_earlier(inside, [*part, item], cluster, "_item_before"), [*part, cluster])
    asked = _with_earlier(matches.where(F.col(cluster).isNotNull()).select(*part, cluster, *session), [*part, *session], cluster, "_session_before")
    first = (F.size("_session_before") == 0) | (F.size("_item_before") == 0) | ~F.arrays_overlap("_session_before", "_item_before")
    return seen.join(asked, [*part, cluster]).where(first).select(*part, item, *session)


def _with_earlier(rows: DataFrame, owner: Sequence[str], cluster: str, name: str) -> DataFrame:
    """(owner, cluster, name): each cluster of an owner once, with the smaller ones of that owner."""
    own = rows.groupBy(*owner).agg(F.array_sort(F.collect_set(cluster)).alias("_all"))
    return own.select(*owner, "_all", F.posexplode("_all").alias("_pos", cluster)).select(*owner, cluster, F.expr("slice(_all, 1, _pos)").alias(name))


def _by_cluster(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted inside each task. Spark drops a sort that stands below a join with nothing but projections between: the generator keeps it."""
    ordered = rows.sortWithinPartitions(*keys)
    return ordered.select(F.explode(F.array(F.struct(*ordered.columns))).alias("_row")).select("_row.*")


def matched_requests(
    requests: DataFrame, matches: DataFrame, members: DataFrame, key: Sequence[str], session: str, item: str, cluster: str,
    part: Sequence[str] = (),
) -> DataFrame:
    """Keys of requests for an item that has a member in one of the session's matched clusters.

    Starts from the requests: each meets the few clusters of its session and is then semi-joined. The set of all
    items a session could see is never built, and several matching members still give one row.
    """
    asked = requests.select(*key, *[c for c in (*part, session, item) if c not in key]).join(matches, [*part, session])
    inside = members.where(F.col(cluster).isNotNull()).select(*part, cluster, item).distinct()
    return asked.join(inside, [*part, cluster, item], "left_semi").select(*key).distinct()


def readable_requests(
    requests: DataFrame, shared_items: DataFrame, matches: DataFrame, members: DataFrame, key: Sequence[str], session: str,
    item: str, cluster: str, part: Sequence[str] = (),
) -> DataFrame:
    """Requests for a shared item or a matched one: two joins and a union of keys, where an OR in one join
    condition could only run as a nested loop."""
    own = matched_requests(requests, matches, members, key, session, item, cluster, part)
    shared = requests.join(shared_items.select(item), item, "left_semi").select(*key)
    return requests.join(own.unionByName(shared).distinct(), list(key), "left_semi")


def in_list_order(lists: DataFrame, items: DataFrame, owner: Sequence[str], ids: str, item: str) -> DataFrame:
    """Items of an id list with their place in the list; unknown ids drop out."""
    return lists.select(*owner, F.posexplode(ids).alias("pos", item)).join(items, item)


def not_attempted(rows: DataFrame, attempted: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(attempted.select(*key).distinct(), list(key), "left_anti")


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Many-to-one lookup. Spark broadcasts ``right`` by itself when its size is below the threshold."""
    return left.join(right, key)


def with_parent(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Each node with the parent that exists; an unknown parent makes the node a root."""
    known = nodes.select(F.col(key).alias("_known"))
    return (
        nodes.join(known, F.col(parent) == F.col("_known"), "left")
        .withColumn("resolved_parent", F.col("_known"))
        .withColumn("is_root", F.col("_known").isNull())
        .drop("_known")
    )
