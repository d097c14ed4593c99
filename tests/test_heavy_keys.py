"""Sequential operators on keys that are cut into slices: same answers, bounded groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensfold.operators import anchored, sliced
from lensfold.operators.sliced import SLICE

START = 1_700_000_000_000_000


def plain_opens(times, ttl):
    out, over = set(), None
    for t in sorted(times):
        if over is None or t >= over:
            out.add(t)
            over = t + ttl
    return out


@pytest.mark.parametrize("ttl", [3, 40, 100_000])
def test_windows_of_sliced_keys(spark, ttl):
    """Sparse and dense stretches, windows far longer and far shorter than a slice."""
    rng = random.Random(ttl)
    log = []
    for key, n in (("hot", 900), ("warm", 300), ("cold", 12)):
        at = 0
        for _ in range(n):
            at += rng.choice([0, 1, 1, 2, 30, 200])
            log.append((key, at))
    df = spark.createDataFrame(log, "key string, s long").select("key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    got = {(r["key"], (r["_us"] - START) // 1_000_000) for r in anchored.anchors(df, ["key"], "ts", ttl, heavy=50).where("opens").collect()}
    assert got == {(k, t) for k in ("hot", "warm", "cold") for t in plain_opens([s for x, s in log if x == k], ttl)}


def test_a_burst_of_a_million_rows_of_one_key(spark):
    """All within one second: windows of 100 ms, slices of bounded size, and a long window that one event opens."""
    n = 1_000_000
    log = spark.range(n).select(F.lit("k").alias("key"), F.timestamp_micros(F.lit(START) + F.col("id")).alias("ts"))
    rows = log.select("key", F.unix_micros("ts").alias("_us"))
    packed, hot = anchored._split(rows, ["key"], ["_us"], anchored.HEAVY)
    sizes = [r["count"] for r in hot.groupBy("key", SLICE).count().collect()]
    assert packed.isEmpty() and sum(sizes) == n and max(sizes) <= anchored.HEAVY
    opens = lambda ttl: sorted(r["_us"] - START for r in anchored.anchors(log, ["key"], "ts", ttl).where("opens").collect())
    assert opens(0.1) == list(range(0, n, 100_000))
    assert opens(60) == [0]


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_states_are_composed(spark, fan):
    rng = random.Random(fan)
    rows = [(k, s, [rng.randrange(4) for _ in range(4)]) for k in "ab" for s in rng.sample(range(200), 60)]
    want = set()
    for k in "ab":
        state = 0
        for _, s, f in sorted(r for r in rows if r[0] == k):
            want.add((k, s, state))
            state = f[state]
    df = spark.createDataFrame(rows, f"key string, {SLICE} long, _exit array<int>")
    assert {tuple(r) for r in anchored.entries(df, ["key"], 4, fan=fan).select("key", SLICE, "_entry").collect()} == want


def test_a_machine_over_slices(spark):
    """Counts to five and starts anew at a zero, over keys of any size."""
    rng = random.Random(1)
    log = [(k, i, float(rng.random() > 0.1)) for k, n in (("hot", 2000), ("cold", 30)) for i in range(n)]

    def run(values, state):
        out = np.zeros(len(values), "int64")
        for i, v in enumerate(values):
            state = min(5, state + 1) if v else 0
            out[i] = state
        return out, state

    df = spark.createDataFrame(log, "key string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = [{(r["key"], r["s"]): r["n"] for r in anchored.finite_machine(df, ["key"], "ts", "s", 6, run, "v", "n", T.LongType(), heavy=h).collect()} for h in (100, 10**6)]
    assert got[0] == got[1] and len(got[0]) == 2030 and set(got[0].values()) == set(range(6))


@pytest.mark.parametrize("seconds", [5, 60, 3000])
def test_windows_that_slide(spark, seconds):
    """Largest and first value of a window, with ties, gaps and missing values, against all rows."""
    rng, log = random.Random(seconds), []
    for key, n in (("hot", 500), ("cold", 20)):
        at = -50
        for i in range(n):
            at += rng.choice([0, 0, 1, 3, 40])
            log.append((key, at, i, rng.choice([None, *range(20)])))
    df = spark.createDataFrame(log, "key string, s long, id long, v long").withColumn("ts", F.timestamp_seconds("s"))
    window = lambda k, s: [r for r in log if r[0] == k and s - seconds < r[1] <= s]
    most = {(k, i): max((r[3] for r in window(k, s) if r[3] is not None), default=None) for k, s, i, _ in log}
    first = {(k, i): min(window(k, s), key=lambda r: (r[1], r[2]))[3] for k, s, i, _ in log}
    assert {(r["key"], r["id"]): r["m"] for r in sliced.sliding_max(df, ["key"], "ts", seconds, F.col("v"), "m").collect()} == most
    assert {(r["key"], r["id"]): r["f"] for r in sliced.sliding_first(df, ["key"], "ts", "id", seconds, "v", "f").collect()} == first
    counts = {(r["key"], r["us"] // 1_000_000): r["in_window"] for r in sliced.sliding_count(df, ["key"], "ts", seconds).collect()}
    assert counts == {(k, s): len(window(k, s)) for k, s, *_ in log}


def test_a_window_over_a_million_rows(spark):
    """Every window holds all rows before: time does not grow with what a window holds."""
    n = 1_000_000
    log = spark.range(n).select(F.lit("k").alias("key"), F.timestamp_micros(F.lit(START) + F.col("id")).alias("ts"), "id", ((F.col("id") * 7919) % 1_000_003).alias("v"))
    out = sliced.sliding_max(log, ["key"], "ts", 3600, F.col("v"), "m")
    got = out.where("id in (0, 10, 999999)").select("id", "m").orderBy("id").collect()
    best = [max((i * 7919) % 1_000_003 for i in range(last + 1)) for last in (0, 10, 999_999)]
    assert [r["m"] for r in got] == best
