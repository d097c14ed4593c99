"""Token ids of documents packed into sequences of a fixed length with little padding.

Documents are dealt to groups at random: by a hash of id and text into buckets, and inside a bucket, in the order of the hash, into
groups of at most ``GROUP_ROWS`` documents or ``GROUP_IDS`` ids (one longer document is a group). A task holds one group at a time,
and each is packed by itself:

1. A document is cut into whole sequences from its start; what is left is one piece.
2. Pieces go, longest first, into the first open sequence that has room (first-fit decreasing), found in a tournament tree whose
   nodes hold the most room below them.
3. Sequences that are still open are closed by cutting the pieces of the emptiest ones to fit the fullest ones.
4. The one that stays open at most is cut into sequences of powers of two, which need no padding, until ``SLACK`` places or less are empty.

Ids are cut only in step 1, 3 and 4; every id lies in exactly one piece. The result depends on ids, texts and the number of
buckets, not on the order of rows or on where a task runs. A null text is empty and has its end id alone, rows without an id are packed as
others. Rows equal in id and text are interchangeable. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import partitions, text_or_empty
from lensfold.llm.token_files import AT_ONCE, encoder, gathered, with_end

GROUP_ROWS, GROUP_IDS = 16_384, 8_000_000
#: Empty places that the last sequence of a group may keep.
SLACK = 16
#: A bucket's sequences are numbered from ``bucket << BUCKET_BITS``.
BUCKET_BITS = 40
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: (document, start, length) of one piece.
Piece = tuple[int, int, int]


class Tournament:
    """Room of many bins: the first one with enough of it is found, and its room reduced, in as many steps as the tree is high."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which must exist; it is put there."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            at += most[at] < size
        bin_ = at - self.leaves
        most[at] -= size
        while at > 1:
            at >>= 1
            left, right = most[2 * at], most[2 * at + 1]
            most[at] = left if left > right else right
        return bin_


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Numbers of the items of each bin; items by size, equal ones by number."""
    tree, bins = Tournament(len(sizes), room), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.put(sizes[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def closed(open_: list[list[Piece]], length: int) -> list[list[Piece]]:
    """Sequences of ``length`` and at most one other: pieces of the emptiest are cut to fit the fullest."""
    size = lambda pieces: sum(n for *_, n in pieces)
    by_size = sorted(open_, key=size)
    first, last, room = 0, len(by_size) - 1, 0
    done: list[list[Piece]] = []
    while first < last:
        target, room = by_size[last], length - size(by_size[last])
        while room and first < last:
            doc, start, n = by_size[first].pop()
            moved = min(n, room)
            target.append((doc, start + n - moved, moved))
            if n > moved:
                by_size[first].append((doc, start, n - moved))
            room -= moved
            first += not by_size[first]
        if room:
            break
        done.append(target)
        last -= 1
    return done + [p for p in by_size[first : last + 1] if p]


def powers(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """One sequence cut into such of powers of two, largest first, until no more than ``SLACK`` places are empty."""
    out, left = [], sum(n for *_, n in pieces)
    while left and length - left > SLACK:
        take = 1 << left.bit_length() - 1
        left -= take
        own: list[Piece] = []
        while take:
            doc, start, n = pieces.pop(0)
            moved = min(n, take)
            own.append((doc, start, moved))
            if n > moved:
                pieces.insert(0, (doc, start + moved, n - moved))
            take -= moved
        out.append(own)
    return out + [pieces] if left else out


def pack(sizes: list[int], length: int) -> list[list[Piece]]:
    """Sequences of pieces (document, start, length) that hold every id of documents of these sizes once."""
    full, rest = [], []
    for doc, n in enumerate(sizes):
        whole = n - n % length
        full += [[(doc, at, length)] for at in range(0, whole, length)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    ready, open_ = [], []
    for numbers in first_fit_decreasing([n for *_, n in rest], length):
        pieces = [rest[i] for i in numbers]
        (ready if sum(n for *_, n in pieces) == length else open_).append(pieces)
    filled = closed(open_, length)
    ready += filled[:-1]
    return full + ready + (powers(filled[-1], length) if filled else [])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece: where it begins in its document and in its
    sequence, and its ids as little-endian unsigned 32-bit integers. Texts are shuffled once and encoded once."""
    parts = partitions(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    dealt = own.withColumn("deal", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod(F.col("deal"), F.lit(parts)).cast("int"))
    dealt = dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "deal", "doc_id", "text").select("bucket", "doc_id", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = encoder(tokenizer), {}
        for bucket, doc_ids, ids, at in groups(batches, lambda texts: with_end(*words.encode_batch(texts), end_id)):
            first = number.get(bucket, bucket << BUCKET_BITS)
            packs = pack(np.diff(at).tolist(), length)
            number[bucket] = first + len(packs)
            yield batch_of(first, packs, doc_ids, ids, at)

    return dealt.mapInArrow(packed, SCHEMA)


def groups(batches: Iterator[pa.RecordBatch], encode) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(bucket, document ids, ids, where each document begins) of one group after the other."""
    bucket, rows, size, waiting = None, 0, 0, []

    def group():
        starts = np.cumsum([0] + [ids.size for _, ids, _ in waiting])
        at = np.concatenate([[0], *(b + own[1:] for b, (_, _, own) in zip(starts, waiting))])
        return bucket, pa.concat_arrays([d for d, *_ in waiting]), np.concatenate([ids for _, ids, _ in waiting]), at

    for batch in gathered(batches, AT_ONCE):
        ids, at = encode(batch["text"])
        buckets, ends = batch["bucket"].to_numpy(), at[1:]
        begin = 0
        while begin < batch.num_rows:
            if waiting and (buckets[begin] != bucket or rows >= GROUP_ROWS or size >= GROUP_IDS):
                yield group()
                rows, size, waiting = 0, 0, []
            bucket = int(buckets[begin])
            most = min(int(np.searchsorted(buckets, bucket, "right")), begin + GROUP_ROWS - rows)
            end = max(begin + 1, min(most, int(np.searchsorted(ends, at[begin] + GROUP_IDS - size, "right"))))
            if waiting and ends[end - 1] - at[begin] > GROUP_IDS - size:
                size = GROUP_IDS  # the next document doesn't fit: it begins the next group
                continue
            waiting.append((batch["doc_id"][begin:end], ids[at[begin] : at[end]], at[begin : end + 1] - at[begin]))
            rows, size, begin = rows + end - begin, size + int(at[end] - at[begin]), end
    if waiting:
        yield group()


def batch_of(first: int, packs: list[list[Piece]], doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    flat = np.array([(first + i, *p) for i, own in enumerate(packs) for p in own], "int64")
    sequence, doc, start, n = flat.T
    new = np.append(True, sequence[1:] != sequence[:-1])
    before = np.cumsum(n) - n
    offset = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), n.size)))
    begin, data = at[doc] + start, ids.astype("<u4", copy=False)
    values = [data[b : b + k].tobytes() for b, k in zip(begin.tolist(), n.tolist())]
    columns = [doc_ids.take(pa.array(doc)), *(pa.array(x) for x in (start, n, np.diff(at)[doc], sequence, offset)), pa.array(values, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def joined(found: DataFrame) -> DataFrame:
    """(sequence_id, ids) of whole sequences, without padding. A group is one sequence of bounded length."""
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(whole.alias("p")).select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
