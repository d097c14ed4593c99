"""Byte-level BPE: ranked merges folded over the bytes of each distinct piece of text, and decoding by joining pieces.

The rank table is read from a file that every executor can open (a parameter). A text is cut where a space or a line
starts after a non-space character; no match of the pattern runs over such a place, so the cuts change nothing and
a piece that was met before costs one look-up. Texts where white space stands before a space or a line end are cut by
the pattern alone. A worker keeps the ids of at most ``2 * REMEMBERED`` pieces and ``REMEMBERED`` matches.

Null and empty texts have no ids. Rows are looked at one by one: repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces in each of a worker's two generations.
REMEMBERED = 250_000
#: Longer pieces are forgotten at once.
LONG_PIECE = 200
#: Longer matches are merged with a heap.
SHORT_MATCH = 48


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def pieces_of(path: str) -> dict[int, bytes]:
    return {i: piece for piece, i in ranks_of(path).items()}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the adjacent pair of lowest rank is joined, the leftmost first, until no pair has a rank."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT_MATCH:
        return _merged_long(word, ranks)
    get, none = ranks.get, 1 << 60
    parts = [word[i : i + 1] for i in range(len(word))]
    costs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while costs and (least := min(costs)) != none:
        at = costs.index(least)
        parts[at] += parts.pop(at + 1)
        del costs[at]
        if at < len(costs):
            costs[at] = get(parts[at] + parts[at + 1], none)
        if at:
            costs[at - 1] = get(parts[at - 1] + parts[at], none)
    return [ranks[p] for p in parts]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over linked parts; ``ends[i]`` is where the part that starts at i ends, 0 once it is gone."""
    n = len(word)
    ends, starts = list(range(1, n + 1)), list(range(-1, n))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and ends[i] < n and (rank := ranks.get(word[i : ends[ends[i]]])) is not None:
            heapq.heappush(heap, (rank, i, ends[ends[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != stop:
            continue  # one of the two was joined to something else meanwhile
        ends[i], ends[middle] = stop, 0
        if stop < n:
            starts[stop] = i
        offer(i)
        offer(starts[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers."""

    UNSAFE = regex.compile(r"\s[ \n]")

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = ranks_of(path), regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def match(self, word: str) -> bytes:
        """Ids of one match; those that stand in several pieces (with and without a comma, say) are merged once."""
        if (known := self.matches.get(word)) is None:
            ids = merged(word.encode(), self.ranks)
            known = pack(f"<{len(ids)}i", *ids)
            if len(self.matches) >= REMEMBERED:
                self.matches.clear()
            if len(word) <= LONG_PIECE:
                self.matches[word] = known
        return known

    def piece(self, piece: str) -> bytes:
        known = self.old.get(piece)
        if known is None:
            known = b"".join(map(self.match, self.find(piece)))
            if len(piece) > LONG_PIECE:
                return known
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[piece] = known
        return known

    def encode(self, text: str) -> bytes:
        if self.UNSAFE.search(text):
            parts = self.find(text)
        else:
            cut = text.replace("\n", " \n").split(" ")
            parts = cut[:1] + [p if p[:1] == "\n" else f" {p}" for p in cut[1:]]
        young, piece = self.young.get, self.piece
        return b"".join([young(p) or piece(p) for p in parts])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(text: str | Column, path: str, pattern: str) -> Column:
    """Token ids of a text column; ``path`` holds base64 pieces and their ranks, ``pattern`` cuts texts into matches."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, pattern)
        for texts in batches:
            ids = [own.encode(t) if t else b"" for t in texts.to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]) // 4
            values = np.frombuffer(b"".join(ids), "<i4")
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return run(text)


def decode(ids: str | Column, path: str) -> Column:
    """Bytes of an array of token ids; null gives null, an unknown id fails the job."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        piece = pieces_of(path).__getitem__
        for rows in batches:
            at, flat = rows.offsets.to_pylist(), rows.values.to_numpy().tolist()
            texts = [b"".join(map(piece, flat[a:b])) for a, b in zip(at, at[1:])]
            yield pa.array([t if there else None for t, there in zip(texts, rows.is_valid().to_pylist())], pa.binary())

    return run(ids)
