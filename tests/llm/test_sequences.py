"""Packing: every id once and in place, little padding, the tree finds what a scan finds."""

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lensfold.llm import sequences
from lensfold.llm.queries import QUERIES
from tests.llm.frames import awkward, prose, simple

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_tree_finds_the_first_fit():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 80))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if at == len(room):
                room.append(100)
                want.append([])
            room[at] -= sizes[i]
            want[at].append(i)
        assert sequences.first_fit_decreasing(sizes, 100) == want


@pytest.mark.parametrize("length", [64, 2048])
def test_every_id_once_and_little_padding(length):
    rng = random.Random(length)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 40, length - 1, length, length + 1, 5 * length, rng.randint(0, 3 * length)]) for _ in range(rng.randint(0, 60))]
        packs = sequences.pack(sizes, length)
        pieces = defaultdict(list)
        for own in packs:
            assert own and all(n > 0 for *_, n in own) and sum(n for *_, n in own) <= length
            for doc, start, n in own:
                pieces[doc].append((start, n))
        for doc, size in enumerate(sizes):
            at = 0
            for start, n in sorted(pieces[doc]):
                assert start == at
                at += n
            assert at == size
        used = [sum(n for *_, n in own) for own in packs]
        assert sum(0 if u & (u - 1) == 0 else length - u for u in used) <= sequences.SLACK


def held(rows, docs, length=2048, end_id=1):
    library = Tokenizer.from_file(WORDS)
    want = defaultdict(int)
    for r in docs:
        want[r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [end_id])] += 1
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    # Pieces of rows that share an id are told apart by their documents' ids.
    got = defaultdict(int)
    for (doc, ids), n in want.items():
        for r in rows:
            if r["doc_id"] == doc and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]])):
                got[doc, ids] += r["length"]
        assert got[doc, ids] >= n * len(ids)
    assert sum(r["length"] for r in rows) == sum(n * len(ids) for (_, ids), n in want.items())


def test_query_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark, [prose(i, 50 * i) for i in range(30)] + ["x <|endoftext|> y"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_sequences"](spark, str(tmp_path)).collect()
    held(rows, docs.collect())
    again = spark.read.parquet(f"{tmp_path}/documents.parquet").orderBy("n_chars").coalesce(1)
    again.write.parquet(f"{tmp_path}/again/documents.parquet")
    assert sorted(map(tuple, QUERIES["op11_sequences"](spark, f"{tmp_path}/again").collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_groups_are_bounded(spark, monkeypatch):
    """Many small groups and groups cut by ids hold the same ids; a document longer than a group is one."""
    texts = [prose(i, 20 + i) for i in range(120)] + [prose(7, 4000)]
    docs = simple(spark, texts)
    for rows, ids in ((7, 10**9), (10**9, 300), (1, 1)):
        monkeypatch.setattr(sequences, "GROUP_ROWS", rows)
        monkeypatch.setattr(sequences, "GROUP_IDS", ids)
        seen = []
        batch = pa.record_batch({"bucket": pa.array([0] * 60 + [1] * 61, pa.int32()), "doc_id": pa.array(range(121)), "text": texts})
        library = sequences.encoder(WORDS)
        for _, doc_ids, _, at in sequences.groups(iter([batch]), lambda t: sequences.with_end(*library.encode_batch(t), 1)):
            assert len(doc_ids) <= rows and (at[-1] <= ids or len(doc_ids) == 1)
            seen += doc_ids.to_pylist()
        assert seen == list(range(121))
    assert docs.count() == 121


def test_sequences_are_joined(spark):
    found = sequences.pieces(simple(spark, [prose(i, 300) for i in range(20)]), WORDS, 1, 128)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in sequences.joined(found).collect()}
    for r in found.collect():
        assert whole[r["sequence_id"]][4 * r["offset"] :][: 4 * r["length"]] == bytes(r["ids"])
