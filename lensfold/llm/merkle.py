"""A manifest of rows as a tree of digests, and proofs that a row belongs to it.

Leaves are numbered inside their tree; while a level has more than one node, every ``FANOUT`` neighbours (the last run may be
shorter, even one) become the SHA-256 of their digests, joined as hex text. The tops of all trees, in the order of the trees, are the
leaves of one more tree, whose top is the root.

Numbering is one sort by ranges: a tree that holds a third of all rows is spread over many tasks, and what follows needs its first place
only. Trees are built in packs of ``FANOUT ** LEVELS`` neighbours: one shuffle of digests for every ``LEVELS`` levels, each 81 times
smaller than the one before. A pack's records (digest, children) are stored under the digest of its top, each once.

A proof descends from the root. All requests that still share their first rank digits travel as one row (tree, place, digest, segments):
it fetches the records of that digest, and for each next digits the children that weren't taken are put behind the
segments. In the last pack the rows of the leaves are met, one row a request; its segments in reverse are the proof.

Rows without an id come first in their tree, rows with equal ids are ordered by leaf. An empty table has no tree and gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lensfold.llm.common import few, partitions, written

FANOUT, LEVELS = 3, 4
PACK = FANOUT**LEVELS
RECORDS = "array<struct<digest: string, children: array<string>>>"
SEGMENTS = "array<struct<before: array<string>, after: array<string>>>"
TEXTS = pa.list_(pa.string())
PACKED = pa.struct([("top", pa.string()), ("records", pa.list_(pa.struct([("digest", pa.string()), ("children", TEXTS)])))])
SEGMENTS_TYPE = pa.list_(pa.struct([("before", TEXTS), ("after", TEXTS)]))
#: Packs whose rows a task turns into Python objects at once.
PACKS_AT_ONCE = 16
#: Places inside a task's rows are the low bits of ``monotonically_increasing_id``.
PLACE_BITS = 33


def leaf(*values: str | Column) -> Column:
    """Hex SHA-256 of the values, each as its UTF-8 length, a colon and itself; null is a dash."""
    texts = [F.col(v).cast("string") if isinstance(v, str) else v for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]), 256)


def joined(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``tree`` replaced by the place of its first row (trees ascend as before, null first), ``rank`` inside the tree and ``n``,
    the rows of the tree. Only (task, tree) counts are joined back, so no tree is in one task."""
    columns = [c for c in rows.columns if c != tree]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    dealt = dealt.withColumn("task", F.shiftright("at", PLACE_BITS)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    pieces = dealt.groupBy("task", tree).agg(F.min("at").alias("lowest"), F.count(F.lit(1)).alias("c"))
    pieces = written(pieces, "manifest-pieces")
    tasks = pieces.groupBy("task").agg(F.sum("c").alias("c"))  # one row a task
    tasks = tasks.select("task", F.coalesce(F.sum("c").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = W.partitionBy(tree)
    places = pieces.join(F.broadcast(tasks), "task").select(
        F.col("task").alias("_task"), F.col(tree).alias("_tree"), "base", F.min(F.col("base") + F.col("lowest")).over(own).alias("first"), F.sum("c").over(own).alias("n")
    )
    places = few(written(places, "manifest-places"))
    at = dealt.join(places, (F.col("task") == F.col("_task")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return at.select(F.col("first").alias(tree), (F.col("base") + F.col("at") - F.col("first")).alias("rank"), "n", *columns)


def height(n: str) -> Column:
    """Levels above ``n`` leaves."""
    powers = F.array(*[F.lit(FANOUT**i).cast("long") for i in range(39)])
    return F.size(F.filter(powers, lambda p: p < F.col(n)))


def packed(digests: Column, levels: Column) -> Column:
    """(top, records) of neighbouring digests after so many levels; records of the pack, lowest first."""

    @F.arrow_udf(f"struct<top: string, records: {RECORDS}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, heights in batches:
            out = []
            for nodes, h in zip(lists.to_pylist(), heights.to_pylist(), strict=True):
                records = {}
                for _ in range(h):
                    runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
                    nodes = [joined(r) for r in runs]
                    records.update(zip(nodes, runs))
                out.append({"top": nodes[0], "records": [{"digest": d, "children": c} for d, c in records.items()]})
            yield pa.array(out, PACKED)

    return run(digests, levels)


def build(leaves: DataFrame, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Packs of (tree, rank, n, digest), lowest first, each (tree, block, levels, top, records, rows), and the top of every tree (tree,
    digest). ``rows`` are the digests of a pack in order, on the lowest level with their ``payload``."""
    most = leaves.agg(F.max(height("n")).alias("h")).first()["h"] or 0
    packs, tops, level = [], [], leaves.withColumn("levels", height("n"))
    for step in range(max(1, -(-most // LEVELS))):
        own = F.struct("rank", "digest", *(payload if not step else ()))
        groups = level.groupBy("tree", F.expr(f"rank div {PACK}").alias("block"), "levels").agg(F.array_sort(F.collect_list(own)).alias("rows"))
        made = groups.withColumn("p", packed(F.col("rows.digest"), F.least("levels", F.lit(LEVELS))))
        pack = written(made.select("tree", "block", "levels", "p.top", "p.records", "rows"), f"manifest-pack-{step}")
        packs.append(pack)
        tops.append(pack.where(F.col("levels") <= LEVELS).select("tree", F.col("top").alias("digest")))
        level = pack.where(F.col("levels") > LEVELS).select("tree", F.col("block").alias("rank"), F.col("top").alias("digest"), (F.col("levels") - LEVELS).alias("levels"))
    return packs, reduce(DataFrame.unionAll, tops)


def descend(packs: list[DataFrame], starts: DataFrame) -> DataFrame:
    """The lowest packs with (digest, segments) of the request that came for them and the records under that digest, from ``starts``
    (tree, digest, segments): a tree begins in the highest pack that it has."""
    waiting = None
    for step in reversed(range(len(packs))):
        pack = packs[step]
        highest = pack.where(F.col("levels") <= LEVELS).select("tree")
        frontier = starts.join(highest, "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("block"), "digest", "segments")
        frontier = frontier if waiting is None else frontier.unionAll(waiting)
        store = pack.select(F.col("top").alias("digest"), "records").dropDuplicates(["digest"])
        here = frontier.join(pack.select("tree", "block", "rows", F.least("levels", F.lit(LEVELS)).alias("levels")), ["tree", "block"]).join(store, "digest")
        if not step:
            return here
        waiting = here.select("tree", "block", "digest", "segments", "levels", "records", F.transform("rows", lambda r: F.struct(r["rank"])).alias("rows"))
        waiting = written(waiting.mapInArrow(next_requests, f"tree long, block long, digest string, segments {SEGMENTS}"), f"manifest-frontier-{step}")
    raise AssertionError("a tree has one pack at least")


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict, dict, str, list[dict]]]]:
    """(pack, row, node, segments) of every row of some packs: from the pack's top by the digits of its place."""
    for batch in batches:
        for at in range(0, batch.num_rows, PACKS_AT_ONCE):
            out = []
            for pack in batch.slice(at, PACKS_AT_ONCE).to_pylist():
                records = {x["digest"]: x["children"] for x in pack["records"]}
                for i, row in enumerate(pack["rows"]):
                    node, path = pack["digest"], list(pack["segments"])
                    for level in reversed(range(pack["levels"])):
                        children, digit = records[node], i // FANOUT**level % FANOUT
                        path.append({"before": children[:digit], "after": children[digit + 1 :]})
                        node = children[digit]
                    out.append((pack, row, node, path))
            yield out


def next_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("digest", pa.string()), ("segments", SEGMENTS_TYPE)])
    for some in walked(batches):
        yield pa.RecordBatch.from_pylist([{"tree": pack["tree"], "block": row["rank"], "digest": node, "segments": path} for pack, row, node, path in some], schema)


def subroot_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.int64()), ("digest", pa.string()), ("segments", SEGMENTS_TYPE)])
    for some in walked(batches):
        yield pa.RecordBatch.from_pylist([{"tree": row["own"], "digest": node, "segments": path} for _, row, node, path in some], schema)


def proof_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof", TEXTS), ("folded_root", pa.string())])
    for some in walked(batches):
        out = [(row["key"], node, pack["subroot"], siblings(path), folded(row["changed"], path)) for pack, row, node, path in some]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), schema.types)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)


def folded(node: str, segments: list[dict]) -> str:
    """The top that a node and the children beside its way lead to."""
    for s in reversed(segments):
        node = joined([*s["before"], node, *s["after"]])
    return node


def siblings(segments: list[dict]) -> list[str]:
    """The proof: digests beside the way, level by level from the leaf to the root, left to right."""
    return [d for s in reversed(segments) for d in (*s["before"], *s["after"])]


def proofs(rows: DataFrame, tree: str, key: str, digest: str, changed: str) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded_root) of every row of (tree, key, leaf digest, digest of the leaf as it is now): ``proof``
    holds the digests beside its way, ``folded_root`` is what they make of the changed leaf. ``key`` is a whole number."""
    own = rows.select(F.col(tree).alias("tree"), F.col(key).cast("long").alias("key"), F.col(digest).alias("digest"), F.col(changed).alias("changed"))
    packs, tops = build(numbered(own, "tree", ["key", "digest"]), ["key", "changed"])
    second = numbered(tops.select(F.lit(0).alias("all"), "tree", "digest"), "all", ["tree"])
    upper, root = build(second.select(F.col("all").alias("tree"), "rank", "n", "digest", F.col("tree").alias("own")), ["own"])
    first = root.first()  # one digest, or none of an empty table
    top = first["digest"] if first else None
    here = descend(upper, root.select("tree", "digest", F.array().cast(SEGMENTS).alias("segments")))
    starts = written(here.mapInArrow(subroot_requests, f"tree long, digest string, segments {SEGMENTS}"), "manifest-subroots")
    here = descend(packs, starts).join(few(starts.select("tree", F.col("digest").alias("subroot"))), "tree")
    found = here.mapInArrow(proof_rows, "key long, leaf string, subroot string, proof array<string>, folded_root string")
    return found.withColumn("root", F.lit(top).cast("string"))
