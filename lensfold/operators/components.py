"""Connected components of an edge table, and density clustering on top of them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lensfold.operators import pivots
from lensfold.operators import similarity as S
from lensfold.operators.centroids import vector_dim
from lensfold.operators.skew import lookup
from lensfold.session import cut_lineage


#: Edges that are finished in one task for each part.
SMALL = 10_000


def _smallest(edges: pa.Table, part: Sequence[str], kind: pa.DataType) -> pa.Table:
    """(part, _v, _to) of a small graph's vertices: each points at the smallest vertex it is connected with."""
    top: dict = {}

    def find(v):
        while top.setdefault(v, v) != v:
            top[v] = v = top[top[v]]
        return v

    for a, b in zip(edges["src"].to_pylist(), edges["dst"].to_pylist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    heads = [find(v) for v in list(top)]
    keys = {p: pa.repeat(edges[p][0], len(top)) for p in part}
    return pa.table(keys | {"_v": pa.array(top, kind), "_to": pa.array(heads, kind)})


def _finished(graph: DataFrame, on: list[str]) -> DataFrame:
    kind = graph.schema["src"].dataType
    out = T.StructType([*[graph.schema[p] for p in on], T.StructField("_v", kind), T.StructField("_to", kind)])
    arrow = to_arrow_schema(out).field("_v").type
    return graph.groupBy(*on).applyInArrow(lambda edges: _smallest(edges, on, arrow), out)


def components(nodes: DataFrame, edges: DataFrame, ident: str, part: Sequence[str], small: int = SMALL) -> DataFrame:
    """(part, id, comp): comp is the smallest id of the component. ``edges`` has (part, src, dst).

    Each round hooks every vertex of the remaining graph to one neighbour, follows the pointers, and contracts the graph. Which
    neighbour comes first is drawn anew each round, so chains of pointers stay short whatever order ids have, and the graph shrinks by a
    constant factor per round. Every round is written to reliable storage, since lineage would otherwise double. Once no more
    than ``small`` edges are left, each part is finished in one task; the result is the same.
    """
    on = list(part)
    out = nodes.select(*on, F.col(ident), F.col(ident).alias("comp"))
    graph = cut_lineage(edges.where("src <> dst").select(*on, "src", "dst").distinct())
    rounds = size = 0
    while left := graph.count():
        last = left <= small
        if last:
            hook = _finished(graph, on)
            hook = cut_lineage(hook) if rounds else hook
        else:
            hook, graph = _contracted(graph, on, left, rounds)
        moved = hook.select(*on, F.col("_v").alias("comp"), "_to")
        if rounds:
            out = lookup(out, moved, [*on, "comp"], size)
        else:  # every node still has a name of its own
            out = out.join(moved, [*on, "comp"], "left")
        out = out.select(*on, ident, F.coalesce("_to", "comp").alias("comp"))
        if not last or rounds:
            out = cut_lineage(out)
            size = size or out.count()
            rounds += 1
        if last:
            break
    if not rounds:
        return out
    names = out.groupBy(*on, "comp").agg(F.min(ident).alias("_name"))
    return lookup(out, names, [*on, "comp"], size, "inner").select(*on, ident, F.col("_name").alias("comp"))


def _contracted(graph: DataFrame, on: list[str], size: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Where each vertex goes, and the edges between different goals. A vertex that many edges or pointers meet is looked up where
    they lie.

    All vertices point at the neighbour that comes first. Pointers run in a circle only between two vertices that point at each other:
    the smaller one stays."""
    both = graph.unionByName(graph.select(*on, F.col("dst").alias("src"), F.col("src").alias("dst")))
    first = F.min(F.struct(F.xxhash64("dst", F.lit(turn)).alias("h"), "dst"))
    hook = cut_lineage(both.groupBy(*on, F.col("src").alias("_v")).agg(first.alias("_f")).select(*on, "_v", F.col("_f.dst").alias("_to")))
    for step in range(4):
        jump = hook.select(*on, F.col("_v").alias("_to"), F.col("_to").alias("_next"))
        to = F.col("_next") if step else F.when(F.col("_next") == F.col("_v"), F.least("_v", "_to")).otherwise(F.col("_to"))
        hook = cut_lineage(lookup(hook, jump, [*on, "_to"], 2 * size).select(*on, "_v", to.alias("_to")))
    as_src = hook.select(*on, F.col("_v").alias("src"), F.col("_to").alias("_a"))
    as_dst = hook.select(*on, F.col("_v").alias("dst"), F.col("_to").alias("_b"))
    half = cut_lineage(lookup(graph, as_src, [*on, "src"], size, "inner"))
    rest = lookup(half, as_dst, [*on, "dst"], size, "inner").where("_a <> _b")
    return hook, cut_lineage(rest.select(*on, F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).distinct())


def _fingerprint(vec: str):
    """128 bits that stand for a vector when exact copies are collapsed."""
    return F.struct(F.xxhash64(vec).alias("a"), F.xxhash64(F.reverse(vec)).alias("b"))


def dbscan(
    df: DataFrame, ident: str, vec: str, part: Sequence[str], eps: float, min_samples: int = 1, block: int = S.BLOCK,
    pivots_from: int = pivots.PIVOTS_FROM,
) -> DataFrame:
    """(part, id, label) of density clustering on cosine distance <= eps; label is the smallest core id, null is noise.

    With ``min_samples=1`` every row is core. Exact copies are then collapsed first, so a group of copies costs
    one row. Otherwise: cores have enough neighbours (themselves included), components run over cores, and a
    border row joins the smallest component in reach. Keys of ``pivots_from`` rows or more are cut by pivots, others into blocks;
    the labels are the same.
    """
    on = list(part)
    near = 1.0 - eps

    def spanning(rows: DataFrame, key: str) -> DataFrame:
        if near <= 0 or not pivots.large_keys(rows, on, pivots_from):
            return S.spanning_edges(rows, key, vec, on, near, block)
        cut = pivots.pieces(rows, key, vec, on, near, vector_dim(rows, vec), pivots_from, block)
        return pivots.spanning_edges(cut, key, vec, on, near, block)

    if min_samples <= 1:
        marked = df.withColumn("_print", _fingerprint(vec))
        heads = marked.groupBy(*on, "_print").agg(F.min(ident).alias("_head"), F.min_by(vec, ident).alias(vec))
        unique = cut_lineage(heads)
        found = components(unique, spanning(unique, "_head"), "_head", on)
        labelled = unique.select(*on, "_print", "_head").join(found, [*on, "_head"])
        narrow = marked.select(*on, ident, "_print")  # the way back to all rows moves no vectors
        return narrow.join(labelled.select(*on, "_print", F.col("comp").alias("label")), [*on, "_print"]).select(*on, ident, "label")
    if near > 0 and pivots.large_keys(df, on, pivots_from):
        cut = pivots.pieces(df, ident, vec, on, near, vector_dim(df, vec), pivots_from, block)
        counted = pivots.neighbour_counts(cut, ident, vec, on, near, block)
    else:
        counted = S.neighbour_counts(df, ident, vec, on, near, block)
    core = cut_lineage(
        df.join(counted.where(F.col("neighbours") >= min_samples).select(*on, F.col("src").alias(ident)), [*on, ident], "left_semi")
        .select(*on, ident, vec)
    )
    found = cut_lineage(components(core, spanning(core, ident), ident, on))
    rest = df.join(found.select(*on, ident), [*on, ident], "left_anti").select(*on, ident, vec)
    border = S.smallest_label_in_reach(rest, core.join(found, [*on, ident]), ident, vec, "comp", on, near, block)
    known = found.select(*on, ident, F.col("comp").alias("label")).unionByName(
        border.select(*on, F.col("src").alias(ident), "label")
    )
    return df.select(*on, ident).join(known, [*on, ident], "left")
