"""Runs of repeated words against all lags of all words."""

import hashlib
import random
import time
import zlib

import pytest

from lensfold.llm import periodic
from lensfold.llm.queries import QUERIES
from tests.llm.frames import EXTRA, SCHEMA, awkward, prose


def plain(words, least=24, repeats=3):
    best = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                best[i, j - i + q] = min(q, best.get((i, j - i + q), q))
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def made(rng, size, letters):
    words = []
    while len(words) < size:
        if rng.random() < 0.5:
            own = rng.choices(range(letters), k=rng.randint(1, 15))
            words += own * rng.randint(1, 8) + own[: rng.randint(0, len(own))]
        else:
            words += rng.choices(range(3 * letters), k=rng.randint(1, 8))
    return [b"w%d" % w for w in words[:size]]


@pytest.mark.parametrize(("least", "repeats"), [(24, 3), (3, 3), (10, 4)])
def test_runs_equal_all_lags(least, repeats):
    rng = random.Random(least)
    found = 0
    for _ in range(1500):
        words = made(rng, rng.randint(0, 150), rng.choice([1, 2, 3, 30]))
        assert periodic.runs_of(words, least, repeats) == (want := plain(words, least, repeats)), words
        found += len(want)
    assert found > 400


def test_segments_hold_no_rare_word():
    rng = random.Random(2)
    for _ in range(300):
        numbers = periodic.numbered(made(rng, 400, 9))
        for first, end in periodic.segments(numbers):
            part = numbers[first:end].tolist()
            assert end - first >= 24 and min(map(part.count, set(part))) >= 3


def test_two_repetitions_are_no_run():
    with pytest.raises(ValueError, match="three"):
        periodic.runs_of([b"a"] * 30, 24, 2)


def test_long_texts_take_little_time():
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(300) for _ in range(100_000)]
    start = time.time()
    assert periodic.runs_of(words * 3) == [(0, 300_000, 100_000)]
    assert periodic.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert time.time() - start < 30


def answer(r):
    words = (r["text"] or "").encode().split()
    n, h = len(words), None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
    return (r["doc_id"], len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(listed), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_on_awkward_rows(spark, tmp_path):
    rng = random.Random(1)
    texts = [b" ".join(made(rng, 120, 3)).decode() for _ in range(40)] + ["\n".join(["the same line again"] * 30), " ".join(["eins zwei drei"] * 9) + " x", prose(3, 400)]
    docs = awkward(spark, texts[:9]).where("doc_id is null or doc_id <> 13").unionAll(
        spark.createDataFrame([(1000 + i, t, None, "s", 1, *EXTRA) for i, t in enumerate(texts)], SCHEMA)
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == sorted(map(answer, docs.collect()), key=repr)
