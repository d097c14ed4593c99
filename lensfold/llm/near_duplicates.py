"""N-gram Jaccard join by banding of MinHash values, verified exactly.

A text is the set of its five-word windows (of all its words, if fewer than five). It has ``TREES`` keys of as many MinHash
values each; two documents meet where a key is equal. The number of values in a key is fixed before any row is read: the largest
up to ``DEEPEST`` at which documents at the threshold meet in some key with probability ``RECALL``. This is banding and takes
the place of an LSH forest, whose prefixes would be shortened from the data. Texts that meet, directly or through others, form a
candidate group; inside a group every pair is verified on the real sets.

Equal sets are one node, so copies cost one row. A group of more than ``BLOCK`` nodes is cut into blocks, and a task
verifies a pair of blocks; it returns one row a node (its links and the smallest node it is connected with), never
the pairs. Classes are connected components of the verified links.

Null, empty and blank texts have no windows: they are alone in their class and have no links. Repeated rows belong to the
same class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import few, own_name, partitions, text_or_empty, utf8_bytes, written
from lensfold.operators.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 32, 16, 0.9999
#: Nodes of a block, and words that a worker remembers the hash of.
BLOCK, REMEMBERED = 384, 200_000


def prefix_length(threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The most values of a key that still finds documents at the threshold with the wanted recall."""
    length = DEEPEST
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Sets of word windows as sorted 64-bit hashes."""

    def __init__(self, words: int):
        rng = np.random.default_rng(words)
        self.words, self.known = words, {}
        self.weights = rng.integers(1, 1 << 63, words, dtype="uint64") * np.uint64(2) + np.uint64(1)

    def of(self, text: bytes) -> np.ndarray:
        words, known = text.split(), self.known
        if not words:
            return np.empty(0, "uint64")
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), "uint64", len(words))
        n = len(words) - self.words + 1
        if n < 1:
            return _mixed((hashes * self.weights[: len(hashes)]).sum(keepdims=True) + np.uint64(len(words)))
        total = hashes[:n] * self.weights[0]
        for i in range(1, self.words):
            total = total + hashes[i : n + i] * self.weights[i]
        return np.unique(_mixed(total))


@lru_cache(maxsize=2)
def shingles(words: int) -> Shingles:
    return Shingles(words)


class Bands:
    """The keys of a set, one a band."""

    def __init__(self, trees: int, length: int):
        rng = np.random.default_rng(trees * 100 + length)
        draw = lambda n: rng.integers(1, 1 << 63, n, dtype="uint64") * np.uint64(2) + np.uint64(1)
        self.trees, self.factors, self.offsets = trees, draw(trees * length), draw(trees * length)
        self.fold, self.roots = draw(length), draw(trees)

    def keys(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo("uint64").max, "uint64")
        for i in range(0, len(found), 2048):
            np.minimum(least, (found[i : i + 2048, None] * self.factors + self.offsets).min(axis=0), out=least)
        prefix = (_mixed(least).reshape(self.trees, -1) * self.fold).sum(axis=1, dtype="uint64") + self.roots
        return _mixed(prefix).view("int64")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def signed(docs: DataFrame, key: str, text: str, words: int, threshold: float) -> DataFrame:
    """(doc_id, text_digest, node, keys): node stands for the set of windows, null where there are none."""
    length = prefix_length(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bands = shingles(words), Bands(TREES, length)
        for batch in batches:
            nodes, keys = [], []
            for raw in utf8_bytes(batch["text"]):
                found = own.of(raw)
                nodes.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(bands.keys(found) if len(found) else None)
            yield pa.record_batch(
                {"doc_id": batch["doc_id"], "text_digest": batch["text_digest"], "node": pa.array(nodes, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))}
            )
        own.known.clear()  # the worker lives on and does other work

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(text_or_empty(text)).alias("text_digest"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_digest binary, node binary, keys array<long>")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, comp) of all nodes that meet another one. A meeting place gives one edge a node, to its smallest node."""
    places = nodes.select("node", F.explode("keys").alias("at"))
    heads = places.groupBy("at").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("at", "head")
    edges = written(places.join(heads, "at").where("node <> head").select(F.col("head").alias("src"), F.col("node").alias("dst")).distinct(), "near-edges")
    met = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return components(met, edges, "node", [])


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share. Elements in few sets are counted pair by pair, the others by matrix products."""
    n, few = len(sets), 12
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    count = np.diff(np.append(first, len(values)))
    out = np.zeros(n * n, "int64")
    for c in range(2, few + 1):
        at = owner[first[count == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i):
                np.add.at(out, at[:, j] * n + at[:, i], 1)
    out = out.reshape(n, n)
    out += out.T
    many = np.flatnonzero(count > few)
    for i in range(0, len(many), 2048):
        some = many[i : i + 2048]
        matrix = np.zeros((n, len(some)), "float32")
        for j, (a, c) in enumerate(zip(first[some], count[some])):
            matrix[owner[a : a + c], j] = 1
        out += np.rint(matrix @ matrix.T).astype("int64")
    np.fill_diagonal(out, 0)
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of the threshold or more."""
    shared = shared_counts(sets)
    sizes = np.array([len(s) for s in sets])
    return (shared > 0) & (shared + 1e-9 >= threshold * (sizes[:, None] + sizes[None, :] - shared))


def smallest_connected(links: np.ndarray) -> np.ndarray:
    """For each row the smallest row it is connected with."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        found = np.minimum(label, near)
        found = found[found]
        if (found == label).all():
            return label
        label = found


def verified(groups: DataFrame, sets: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, head, links) for each node and task it was compared in, where it has links. ``sets`` has (node, text, texts)."""
    sized = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    bins = F.lit(partitions(groups.sparkSession) * 8)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = groups.join(sized, "comp").withColumn("blocks", blocks).withColumn("block", block).select(
        "node", "comp", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), bins)).otherwise(F.xxhash64("comp")).alias("bin"),
    ).select("node", "comp", "block", "bin", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("comp", "ascending"), ("node", "ascending")])
        comp, nodes = rows["comp"].to_pylist(), rows["node"].to_pylist()
        block, texts = rows["block"].to_numpy(), rows["texts"].to_numpy()
        within = rows["low"][0].as_py() == rows["high"][0].as_py()
        raw, own = rows["text"], shingles(words)
        out = ([], [], [])
        start = 0
        while start < len(comp):
            end = start
            while end < len(comp) and comp[end] == comp[start]:
                end += 1
            if end - start > 1:
                links = linked([own.of(raw[i].as_py().encode()) for i in range(start, end)], threshold)
                if not within:
                    links &= block[start:end, None] != block[None, start:end]
                head = smallest_connected(links)
                total = links @ texts[start:end]
                for i in np.flatnonzero(links.any(axis=1)):
                    out[0].append(nodes[start + i])
                    out[1].append(nodes[start + head[i]])
                    out[2].append(int(total[i]))
            start = end
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["node", "head", "links"])

    return dealt.join(sets, "node").groupBy("bin", "low", "high").applyInArrow(compare, "node binary, head binary, links long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_digest, label, class_id, links) for each row: rows with equal ``label`` are one class (null: alone),
    ``class_id`` is its smallest doc_id, ``links`` counts the other texts at the threshold or above."""
    rows = written(signed(docs, key, text, words, threshold), "near-signed")
    each = rows.where("node is not null").groupBy("node", "text_digest").agg(F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"))
    nodes = written(each.groupBy("node").agg(F.count(F.lit(1)).alias("texts"), F.first("keys").alias("keys"), F.min_by(F.struct("doc_id", "text_digest"), F.struct("doc_id", "text_digest")).alias("shown")), "near-nodes")
    groups = written(candidate_groups(nodes.select("node", "keys")), "near-groups")

    shown = groups.join(nodes, "node").select("node", "texts", F.col("shown.doc_id").alias("s_id"), F.col("shown.text_digest").alias("s_digest"))
    shown = few(written(shown, "near-shown"))
    body = docs.select(F.col(key).cast("long").alias("t_id"), text_or_empty(text).alias("text"))
    body = body.join(shown, body["t_id"].eqNullSafe(shown["s_id"]) & (text_digest(F.col("text")) == shown["s_digest"])).select("node", "texts", "text").dropDuplicates(["node"])
    found = written(verified(groups, body, words, threshold), "near-links")

    edges = found.where("node <> head").select(F.col("head").alias("src"), F.col("node").alias("dst"))
    comps = components(found.select("node").distinct(), edges, "node", [])
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "texts", F.col("shown.doc_id").alias("first_id")).join(comps, "node", "left").join(links, "node", "left").select(
        "node", "first_id", F.coalesce("comp", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("links")
    )
    known = written(known, "near-classes")
    # Written apart, so that the joins read plain tables and Spark can split a large class or a large group of copies.
    named = written(known.groupBy("label").agg(F.min("first_id").alias("class_id")), "near-names")
    known = written(known.join(named, "label").select("node", "label", "class_id", "links"), "near-known")
    return rows.select("doc_id", "text_digest", "node").join(known, "node", "left").select(
        "doc_id", "text_digest", "label", "class_id", F.coalesce("links", F.lit(0)).alias("links")
    )


def class_ids(found: DataFrame) -> DataFrame:
    """(doc_id, class_id, links): the class is named after its smallest doc_id."""
    return found.select("doc_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "links")


def one_of_each(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each class one row stays, that with the smallest id, then text, then other columns
    (by the digest of their JSON). Rows without words have no copies: all of them stay."""
    named = found.where("label is not null")
    first = F.struct("doc_id", "text_digest")
    kept = named.groupBy("label").agg(F.min(first).alias("first")).select(F.col("first.doc_id").alias("k_id"), F.col("first.text_digest").alias("k_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_digest") == F.col("k_digest"))
    each = named.groupBy("doc_id", "text_digest").agg(F.count(F.lit(1)).alias("n"))
    digest, gone_id, gone_digest = (own_name(docs, c) for c in ("near_digest", "near_id", "near_gone"))
    as_gone = [F.col("doc_id").alias(gone_id), F.col("text_digest").alias(gone_digest)]
    gone = few(written(each.join(kept, same, "left_anti").select(*as_gone), "near-gone"))
    repeated = few(written(each.where("n > 1").select(*as_gone), "near-repeated"))

    marked = docs.withColumn(digest, text_digest(text_or_empty(text)))
    meets = lambda t: docs[key].cast("long").eqNullSafe(t[gone_id]) & (marked[digest] == t[gone_digest])
    left = marked.join(gone, meets(gone), "left_anti")
    others = F.md5(F.to_json(F.struct(*[c for c in docs.columns if c not in (key, text)]))) if len(docs.columns) > 2 else F.lit("")
    # Copies of a row are reduced where they are read: no text of theirs is shuffled more than once a task.
    once = left.join(repeated, meets(repeated), "left_semi").groupBy(F.col(key), F.col(digest)).agg(F.min_by(F.struct(*docs.columns), others).alias("row")).select("row.*")
    return left.join(repeated, meets(repeated), "left_anti").select(*docs.columns).unionAll(once)
