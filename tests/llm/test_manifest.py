"""Manifest and proofs against a plain tree."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lensfold.llm import merkle
from lensfold.llm.queries import QUERIES
from tests.llm.frames import EXTRA, SCHEMA, awkward


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def way(nodes, i):
    """(top, levels of (before, after)) of a leaf."""
    path = []
    while len(nodes) > 1:
        run = nodes[i - i % 3 : i - i % 3 + 3]
        path.append((run[: i % 3], run[i % 3 + 1 :]))
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        i //= 3
    return nodes[0], path


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r, r["text"]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(trees[s], key=lambda x: x[:2]) for s in order}
    tops = [way([d for _, d, _ in leaves[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        root, upper = way(tops, k)
        for i, (_, d, r) in enumerate(leaves[s]):
            path = way([x for _, x, _ in leaves[s]], i)[1] + upper
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, r["text"].replace("\n", "")) if hit else d
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in path for x in (*before, *after)))
            out.append((r["doc_id"], d, tops[k], root, proof, node, node == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def answered(spark, root, docs):
    docs.write.parquet(f"{root}/documents.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_merkle_manifest"](spark, str(root)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2,), (1, 1), (3, 4), (81,), (82, 1), (700, 9, 1, 30), tuple([1] * 90)])
def test_against_a_plain_tree(spark, tmp_path, sizes):
    """Trees of one leaf, of whole packs and of one more; a heavy tree; more trees than a pack holds."""
    rng = random.Random(len(sizes))
    rows = [(0, rng.choice(["a\nb", "c", "", None, "é\n\n"]), rng.choice(["en", None]), None if k == 1 else f"s{k}ü", rng.choice([None, 3])) for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, *r[1:], *EXTRA) for i, r in enumerate(rows)], SCHEMA).repartition(7)
    assert answered(spark, tmp_path, docs) == plain(docs.collect())


def test_awkward_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows and ids, rows without an id."""
    docs = awkward(spark, ["x\ny"] * 4).unionAll(awkward(spark))
    assert answered(spark, tmp_path, docs) == plain(docs.collect())


def test_records_lead_from_the_root_to_every_leaf(spark):
    """Each stored digest is that of its children, and is stored once."""
    rows = spark.createDataFrame([(0, i, f"{i:064x}") for i in range(500)], "tree long, key long, digest string")
    packs, tops = merkle.build(merkle.numbered(rows, "tree", ["key"]), ["key"])
    records = [x for p in packs for r in p.select("records").collect() for x in r["records"]]
    assert all(merkle.joined(x["children"]) == x["digest"] for x in records)
    known, reached, waiting = {x["digest"]: x["children"] for x in records}, [], [tops.first()["digest"]]
    assert len(known) == len(records)
    while waiting:
        d = waiting.pop()
        reached, waiting = (reached, waiting + known[d]) if d in known else ([*reached, d], waiting)
    assert sorted(reached) == [f"{i:064x}" for i in range(500)]


def test_no_tree_is_one_task(spark):
    """A tree with nearly all rows is numbered over all tasks."""
    rows = spark.range(40_000).select((F.col("id") % 50 == 0).cast("string").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    out = merkle.numbered(rows, "tree", ["id"])
    assert out.groupBy("tree").agg(F.max("rank").alias("m"), F.min("rank").alias("l"), F.first("n").alias("n")).select("m", "l", "n").orderBy("n").collect() == [(799, 0, 800), (39_199, 0, 39_200)]
    assert out.where("tree = 0 and rank between 1000 and 1003").orderBy("rank").select("id").collect() == [(i,) for i in (1021, 1022, 1023, 1024)]
