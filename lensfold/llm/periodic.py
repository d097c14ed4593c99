"""Runs of repeated words: stretches that repeat with a period three times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least ``least`` words and at
least ``repeats`` periods, which no neighbouring word extends with that period.

Recursive frequency splitting: inside a segment every word of a run occurs at least ``repeats`` times, so words that occur
less often lie in no run and split the segment; the pieces are counted anew until nothing splits. Most texts have nothing left. What
survives is scanned for lags: windows of 1, 2, 4, ... words are ranked (a window of 2k words by the ranks of its halves) and each is
compared with the next equal one. A run of period q shows at the first width of q words or more, as a stretch of windows
whose next equal one is q words on: such a window is at least q and less than 2q words wide, so nothing nearer than q is equal to
it, and three periods hold at least one. The scan takes O(n log^2 n) for n words, also for a text that is one run.

A text is one row and stays in one task. A null text has no words. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lensfold.llm.common import utf8_bytes

LEAST, REPEATS = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], "int64")


def segments(words: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """(first, end) of the stretches of ``least`` words or more in which every word occurs ``repeats`` times or more."""
    waiting, stable = [(0, words.size)], []
    while waiting:
        first, end = waiting.pop()
        if end - first < least:
            continue
        own = words[first:end]
        own = own - own.min()
        if own.max() > 8 * own.size:  # a few words of a large text: count in proportion to the segment
            own = np.unique(own, return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(own)[own] < repeats)
        if not rare.size:
            stable.append((first, end))
            continue
        edges = np.concatenate([[-1], rare, [own.size]])
        kept = np.flatnonzero(np.diff(edges) > least)
        waiting += [(first + int(edges[i]) + 1, first + int(edges[i + 1])) for i in kept]
    return sorted(stable)


def scanned(words: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    found, rank, width = [], words, 1
    while repeats * (width // 2 + 1) <= words.size and rank.size:
        order = np.argsort(rank, kind="stable")
        again = rank[order[1:]] == rank[order[:-1]]
        if not again.any():
            break
        lag = np.zeros(rank.size + 2, "int64")  # between two zeros
        lag[order[:-1][again] + 1] = np.diff(order)[again]
        lag[(lag <= width // 2) | (lag > width)] = 0
        edges = np.flatnonzero(np.diff(lag))
        period = lag[edges[:-1] + 1]
        length = np.diff(edges) - 1 + width + period
        runs = np.flatnonzero((period > 0) & (length >= np.maximum(least, repeats * period)))
        found += zip(edges[runs].tolist(), length[runs].tolist(), period[runs].tolist())
        pairs = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(pairs, return_inverse=True)[1], 2 * width
    return found


def runs_of(words: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if repeats < 3:
        raise ValueError("a run repeats three times or more")
    if len(words) < least:
        return []
    numbers = numbered(words)
    return sorted((first + s, n, q) for first, end in segments(numbers, least, repeats) for s, n, q in scanned(numbers[first:end], least, repeats))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


def found(text: str | Column, least: int = LEAST, repeats: int = REPEATS) -> Column:
    """Struct of the runs of a text (by start and period; word numbers from 0) and the text with each run cut to its first period."""

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends, flat, short = [0], [], []
            for text in utf8_bytes(texts):
                words = text.split()  # at the six ASCII characters of white space
                own = runs_of(words, least, repeats)
                flat += own
                ends.append(len(flat))
                short.append(collapsed(words, own))
            columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN)))
            yield pa.StructArray.from_arrays([lists, pa.array(short, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return run(text)


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length over period, compared as whole numbers; of equal ones the first. Null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def looped(text: Column, crc: Column) -> Column:
    """Texts with repetitions planted: where 10 divides ``crc``, the words from a place that it names repeat with a period that it names.
    Others, texts without words and rows with a null ``crc`` stay as they are."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in batches:
            out = utf8_bytes(texts)
            for i, h in enumerate(numbers.to_pylist()):
                if h is None or h % 10 or not (words := out[i].split()):
                    continue
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                again = words[a : a + p]
                out[i] = b" ".join(words[:a] + (again * (-(-(n - a) // p)))[: n - a])
            yield pa.array(out, pa.binary()).cast(pa.string())

    return run(text, crc)
