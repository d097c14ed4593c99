"""Queries without a SQL twin against plain computations: posteriors, shards, likeness of fingerprints."""

import base64
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lensfold.llm import fingerprints, quality
from lensfold.llm.queries import QUERIES
from tests.llm.frames import awkward, prose, simple


def plain_posteriors(rows):
    """[(host share, path share, posterior)] of rows (host, path, evidence)."""
    logit = lambda p: math.log(p / (1 - p))
    chance = lambda e, share: 1 / (1 + math.exp(-(e + logit(share))))
    share, old = 0.5, None
    for _ in range(12):
        old, share = share, min(1 - 1e-3, max(1e-3, sum(chance(e, share) for *_, e in rows) / len(rows)))
        if abs(share - old) < 1e-4:
            break
    own = [chance(e, share) for *_, e in rows]
    n, good = Counter(), Counter()
    for (host, path, _), p in zip(rows, own):
        for group in ((host,), (host, path)):
            n[group] += 1
            good[group] += p

    def strength(groups, above):
        """How many documents the prior weighs, from the spread of the groups' shares beyond chance."""
        a = b = c = 0.0
        for g in groups:
            if n[g] > 1:
                p = min(1 - 1e-4, max(1e-4, above(g)))
                a += n[g] * (good[g] / n[g] - p) ** 2
                b += p * (1 - p)
                c += (n[g] - 1) * p * (1 - p)
        return 1e6 if not c or a <= b else min(1e6, max(1.0, c / (a - b)))

    hosts = [g for g in n if len(g) == 1]
    h = strength(hosts, lambda g: share)
    q = strength([g for g in n if len(g) == 2], lambda g: (good[g[:1]] + h * share) / (n[g[:1]] + h))
    out = []
    for (host, path, e), p in zip(rows, own):
        host_share = (good[host,] - p + h * share) / (n[host,] - 1 + h)
        path_share = (good[host, path] - p + q * host_share) / (n[host, path] - 1 + q)
        safe = min(1 - 1e-4, max(1e-4, path_share))
        out.append((host_share, path_share, 1 / (1 + math.exp(-(e + logit(safe))))))
    return out


def test_posteriors_equal_a_plain_computation(spark):
    rng = random.Random(3)
    rows = []
    for host, lean in (("good", 3), ("bad", -3), ("mixed", 0), (None, 1)):
        for path in ("a", "b", None):
            for _ in range(rng.choice([1, 2, 40])):
                rows.append((host, path, rng.gauss(lean + (path == "a"), 2)))
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, path string, evidence double").repartition(5)
    out = {r["i"]: r for r in quality.judged(scored, quality.sites(scored), "host", "path", "evidence").collect()}
    for i, (h, p, x) in enumerate(plain_posteriors(rows)):
        assert np.allclose((out[i]["host_share"], out[i]["path_share"], out[i]["posterior"]), (h, p, x), atol=1e-9)
        assert out[i]["keep"] == (out[i]["posterior"] >= 0.5)


@pytest.mark.parametrize("copies", [1, 60])
def test_shards_query(spark, tmp_path, copies):
    """Sizes, digests, gapless slots, equal texts together, sizes near equal where no group of copies is too large."""
    docs = awkward(spark, [prose(i, 30 + i % 50) for i in range(300)] + [prose(999, 50)] * copies)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op6_shards"](spark, str(tmp_path)).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, shards, weight = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        shards[r["text_crc32"]].add(r["shard"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in shards.values())
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None} and set(slots) <= set(range(8))
    groups = Counter()
    for r in rows:
        groups[r["text_crc32"]] += r["size"]
    rest = [w for w in weight.values() if w < max(groups.values())] or list(weight.values())
    assert max(rest) - min(rest) <= max(w for w in groups.values() if w < max(groups.values())) and sum(weight.values()) == sum(groups.values())


def test_likeness_columns_of_the_fingerprint_query(spark, tmp_path):
    """Each is the likeness of the two fingerprints that the row, or the next document, has."""
    texts = ["\n".join(prose(10 * i + j, 12) for j in range(8)) for i in range(12)]
    texts[5] = texts[4]
    simple(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(QUERIES["op2_fingerprints"](spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    prints = [fingerprints.fingerprint(t.encode()) for t in texts]
    for i, r in enumerate(rows):
        after = (i + 1) % len(texts)
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        assert abs(r["near_next"] - fingerprints.likeness(prints[i], prints[after])) < 1e-9
        assert abs(r["near_edited"] - fingerprints.likeness(prints[i], fingerprints.fingerprint(edited.encode()))) < 1e-9
        assert r["fingerprint"] == base64.b64encode(fingerprints.packed(prints[i])).decode()
    assert rows[4]["near_next"] == 1.0 and rows[4]["fingerprint"] == rows[5]["fingerprint"]
    assert all(r["near_edited"] > r["near_next"] for r in rows if r["doc_id"] != 4)
