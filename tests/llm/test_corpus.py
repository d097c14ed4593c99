"""Mixing, packing, near duplicates, quality, licences, nearest neighbours."""

import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.llm import licence_notices, licenses, mixing, near_duplicates, nearest, packing, quality
from lensfold.llm.common import small_batches
from tests.llm.frames import awkward, empty, prose, simple


def filled(sizes, weights, share, cap):
    """Water-filling one source after another."""
    budget, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = budget / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * weights[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            budget -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 500, "d": 0}, {"a": 5, "b": 5, "c": 5000}, {"a": 7}])
def test_water_filling(spark, sizes):
    weights = dict(zip(sizes, (3.0, 1.0, 2.0, 3.0)))
    table = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(table, 1.5, 2.0).collect()}
    assert got == pytest.approx(filled(sizes, weights, 1.5, 2.0))


def test_mix_of_skewed_sources(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randint(1, 60)) + f" {i}" for i in range(3000)]
    sources = [rng.choice(["hot"] * 5 + [None, "b", "c", "d"]) for _ in texts]
    docs = simple(spark, texts, sources)
    rows = mixing.sized(docs, 7)
    steps = mixing.plan(rows, mixing.cycled_weights(rows.select("source").distinct(), (3.0, 1.0, 2.0)), 1.5, 2.0)
    got = rows.join(steps, rows["source"].eqNullSafe(steps["source"])).select("doc_id", rows["source"], "size", "source_size", "target", mixing.repeats().alias("n")).collect()
    sums, targets, sizes = Counter(), {}, Counter()
    for r in got:
        assert r["n"] in (0, 1, 2)
        sums[r["source"]] += r["size"] * r["n"]
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
    order = sorted([s for s in sizes if s is not None]) + [None]
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    assert targets == pytest.approx(filled(sizes, weights, 1.5, 2.0))
    assert all(abs(sums[s] - targets[s]) <= 31 for s in sizes)  # half of the longest document
    mixed = Counter(r["doc_id"] for r in mixing.mixed(docs, (3.0, 1.0, 2.0), 1.5, 2.0, 7).select("doc_id").collect())
    assert mixed == Counter({r["doc_id"]: r["n"] for r in got if r["n"]})


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    out = mixing.mixed(docs, (3.0, 1.0, 2.0), 1.5, 2.0, 1)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mixed(empty(spark), (3.0, 1.0, 2.0), 1.5, 2.0, 1).count() == 0


def test_best_fit_is_best_fit():
    rng = random.Random(5)
    for _ in range(300):
        sizes = sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 60))), reverse=True)
        capacity, bins, want = 60, [], []
        for s in sizes:
            fits = [(capacity - b, i) for i, b in enumerate(bins) if b + s <= capacity]
            at = min(fits)[1] if fits else len(bins)
            if at == len(bins):
                bins.append(0)
            bins[at] += s
            want.append(at)
        assert list(packing.best_fit(sizes, capacity)) == want


def test_tree_splits():
    free, rng = packing.Remaining(), random.Random(6)
    entries = [(rng.randint(1, 10_000), i) for i in range(3000)]
    for e in entries:
        free.add(e)
    left = sorted(entries)
    for _ in range(2500):
        size = rng.randint(1, 10_500)
        want = next((e for e in left if e >= (size, -1)), None)
        assert free.take(size) == want
        if want:
            left.remove(want)


@pytest.mark.parametrize("sizes", [[1], [5, 5, 5], [1000] + [1] * 50, [100] * 9, list(range(200, 0, -1))])
def test_pack_into_shards(sizes):
    got = packing.pack(sizes, 8)
    sums = Counter()
    for s, b in zip(sizes, got, strict=True):
        sums[b] += s
    assert set(got) <= set(range(8))
    assert max(sums.values()) <= max(sizes[0], sum(sizes) / 8 + sizes[0])


def test_shards_and_slots(spark):
    rng = random.Random(8)
    rows = [(f"g{i}".encode(), rng.randint(1, 5000)) for i in range(6000)] + [(b"hot", 9_000_000)]
    groups = spark.createDataFrame(rows, "group binary, size long")
    got = {bytes(r["group"]): r["shard"] for r in packing.shards_of(groups, 8).collect()}
    assert len(got) == len(rows)
    sums = Counter()
    for g, s in rows:
        sums[got[g]] += s
    hot = got[b"hot"]
    assert sums[hot] == 9_000_000
    others = [sums[s] for s in range(8) if s != hot]
    assert max(others) - min(others) < 0.01 * max(others)
    numbered = packing.slots(spark.createDataFrame([(i % 3, i // 2) for i in range(999)], "shard int, id long"), "shard", [F.col("id")]).collect()
    for shard in range(3):
        assert sorted(r["slot"] for r in numbered if r["shard"] == shard) == list(range(333))
    assert packing.shards_of(groups.limit(0), 8).count() == 0


def windows(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    """doc_id -> (class id, links) over all pairs of texts."""
    ids = defaultdict(list)
    for d, t in rows:
        ids[t or ""].append(d)
    texts = list(ids)
    sets = [windows(t) for t in texts]
    root, links = list(range(len(texts))), Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    members = defaultdict(list)
    for i, t in enumerate(texts):
        members[top(i)] += [d for d in ids[t] if d is not None]
    return {d: (min(members[top(i)]) if sets[i] else d, links[i]) for i, t in enumerate(texts) for d in ids[t] if d is not None}


def families(seed):
    rng = random.Random(seed)
    out = []
    for f in range(12):
        base = prose(100 * seed + f, rng.choice([3, 8, 60, 300])).split()
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 9)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [5, 384])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    small_batches(spark)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    docs = awkward(spark, families(1) + families(1)[:9])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] not in (None, 3, 6)]
    docs = docs.where("doc_id not in (3, 6)")
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near_duplicates.class_ids(near_duplicates.classes(docs)).collect()}
    assert got == brute_classes(rows)
    kept = near_duplicates.one_of_each(docs, near_duplicates.classes(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in brute_classes(rows).values()})


def test_near_duplicates_with_repeated_rows_and_null_ids(spark):
    small_batches(spark)
    docs = awkward(spark, [prose(3, 40), prose(3, 40)])
    found = near_duplicates.classes(docs)
    assert found.count() == docs.count()
    kept = near_duplicates.one_of_each(docs, found).collect()
    assert sum(r["text"] == prose(3, 40) for r in kept) == 1
    assert {r["text"] for r in kept if r["doc_id"] is None} == {None, "row without an id"}
    assert near_duplicates.classes(empty(spark)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype("uint64")) for _ in range(40)]
    want = np.array([[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (near_duplicates.shared_counts(sets) == want).all()


def test_keys_are_as_long_as_the_recall_allows():
    n = near_duplicates.prefix_length(0.8)
    assert 1 - (1 - 0.8**n) ** near_duplicates.TREES >= near_duplicates.RECALL > 1 - (1 - 0.8 ** (n + 1)) ** near_duplicates.TREES
    assert near_duplicates.prefix_length(0.5) < n < near_duplicates.prefix_length(0.95)


def labelled(spark, n=400):
    rng = random.Random(11)
    good = [prose(i, rng.randint(30, 120)) + "." for i in range(n)]
    bad = [" ".join(w + rng.choice(["###", "$$$"]) for w in prose(i, 60).split()) for i in range(n // 4)]
    texts = good + bad
    docs = simple(spark, texts, [f"site{i % 7}" for i in range(len(texts))])
    labels = spark.createDataFrame([(i, int(i < n), 0) for i in range(len(texts)) if i % 3 == 0], "doc_id long, quality int, toxic int")
    return docs, labels, n


def test_quality_on_held_out_rows(spark):
    docs, labels, n = labelled(spark)
    kept = {r["doc_id"] for r in quality.kept(docs, labels).select("doc_id").collect()}
    held = [i for i in range(n + n // 4) if i % 3]
    assert np.mean([(i in kept) == (i < n) for i in held]) > 0.97


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [("good", "x", 6.0)] * 200 + [("bad", "x", -6.0)] * 200 + [("new", "x", 0.0)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    out = {r["host"]: r for r in quality.judged(scored, quality.sites(scored), "host", "path", "evidence").dropDuplicates(["host"]).collect()}
    assert out["good"]["host_share"] > 0.9 > 0.7 > out["new"]["host_share"] > 0.3 > 0.1 > out["bad"]["host_share"]


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (5, 1), (11, 0), (None, 1), (7, None), (999, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    out = quality.kept(docs, labels)
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert quality.kept(docs, labels.limit(0)).count() == docs.count()
    assert quality.kept(docs, labels.where("quality = 1")).count() == docs.count()
    assert quality.kept(empty(spark), labels).count() == 0


def test_licence_notices(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "  released   UNDER the mit license", "All rights reserved.", "the license of poets", "nothing here", None, ""]
    texts = [f"{prose(i, 20)}\n{t}\n{prose(i + 50, 9)}" if t is not None else None for i, t in enumerate(lines)]
    found = {r["doc_id"]: (r["licence"], r["score"]) for r in licenses.notices(simple(spark, texts), "doc_id", "text", licenses.Templates()).collect()}
    assert {d: l for d, (l, _) in found.items()} == {0: "Apache-2.0", 1: "MIT", 2: "All-rights-reserved"}
    assert licenses.notices(awkward(spark), "doc_id", "text", licenses.Templates()).count() == 0
    assert licenses.notices(empty(spark), "doc_id", "text", licenses.Templates()).count() == 0


def test_no_line_reaches_the_threshold_without_an_anchor():
    t = licenses.Templates()
    for threshold in (0.5, 0.8, 0.95):
        anchors = set(t.anchors(threshold))
        for i in {v[0] for v in t.vectors}:
            assert sum(w**2 for j, _, word, w in t.vectors if j == i and word not in anchors) ** 0.5 < threshold


def wrapped(text, width, mark):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
GPL = "This file is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
WORDINGS = [
    ("All-rights-reserved", "Copyright (c) 2020 Jane Doe. All rights reserved."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("MIT", "Copyright 2021 The Foo Authors. Licensed under the MIT license, see LICENSE.txt for details."),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
    ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"),
    ("Apache-2.0", wrapped(APACHE, 38, "# ")),
    ("Apache-2.0", f"Copyright 2019 Ann Other\n\n{wrapped(APACHE, 72, ' * ')}"),
    ("GPL-3.0", wrapped(GPL.format("", "3"), 50, "// ")),
    ("GPL-2.0", wrapped(GPL.format("", "2"), 60, " * ")),
    ("LGPL-2.1", wrapped(GPL.format("Lesser ", "2.1"), 60, " * ")),
    ("AGPL-3.0", wrapped(GPL.format("Affero ", "3"), 60, " * ")),
    ("GPL-3.0", "This project is distributed under the terms of the GPLv3 license."),
    ("MPL-2.0", wrapped("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", 45, "// ")),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", f"{prose(3, 8)} licensed under the\nCreative Commons Attribution-NonCommercial 4.0\nInternational licence. {prose(4, 8)}"),
    ("ISC", "Released under the terms of the ISC licence"),
    (None, "the license of poets"),
    (None, "Sie kam mit der Lizenz, the license was lost."),
    (None, "Copyright law and the public domain are discussed in the next chapter of this book by many authors."),
]


def test_licence_headers_in_other_wordings(spark):
    texts = [f"{prose(i, 30)}\n{t}\n{prose(i + 50, 20)}" for i, (_, t) in enumerate(WORDINGS)]
    found = {r["doc_id"]: r["licence"] for r in licenses.notices(simple(spark, texts), "doc_id", "text", licenses.Templates()).collect()}
    assert [(found.get(i), t) for i, (_, t) in enumerate(WORDINGS)] == WORDINGS


def test_whole_licence_texts(spark):
    """Also with names, another line width, a title or without the appendix."""
    known = licence_notices.texts()
    texts = [t for _, t in known]
    texts += [f"Foo 1.2\nCopyright 2011-2024 Jane Doe and contributors <jane@example.org>\n\n{wrapped(t, 50, '')}" for t in texts]
    found = {r["doc_id"]: r["licence"] for r in licenses.notices(simple(spark, texts), "doc_id", "text", licenses.Templates()).collect()}
    want = [licence for licence, _ in known]
    assert [found.get(i) for i in range(len(texts))] == want + want


def test_no_header_or_text_reaches_the_threshold_without_an_anchor():
    for t in (licenses.headers(), licenses.whole_texts()):
        anchors = set(t.anchored(0.8))
        for i in {v[0] for v in t.vectors}:
            assert sum(w**2 for j, _, word, w in t.vectors if j == i and (i, word) not in anchors) ** 0.5 < 0.8


def test_nearest_ancestor_wins(spark):
    dirs = spark.createDataFrame([("a/b/c",), ("a/b",), ("a/x/y",), ("z",), (None,)], "directory string")
    said = spark.createDataFrame([("a", "MIT"), ("a/b", "ISC")], "directory string, licence string")
    got = {r["directory"]: (r["licence"], r["inherited_from"]) for r in licenses.inherited(dirs, said).collect()}
    assert got == {"a/b/c": ("ISC", "a/b"), "a/b": ("ISC", "a/b"), "a/x/y": ("MIT", "a")}


def test_hilbert_keys_walk_through_neighbours():
    side, axes = 8, 3
    grid = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    keys = nearest.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(side**axes))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(6000, 16))
    vectors[3000:] = vectors[:3000] + rng.normal(size=(3000, 16)) * 0.2
    vectors[100:500] = vectors[100]  # copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(7000, None), (7100, [0.0] * 16), (7200, [float("nan")] * 16), (7300, [None] * 16), (7400, [1.0]), (None, [1.0] * 16), (7500, [float("inf")] * 16), (7600, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.nearest(df, "vec_id % 50 = 0", k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 6000, 50))
    hits = 0
    for q, found in got.items():
        far = nearest.exact(vectors, vectors[q])
        far[q] = np.inf
        want = np.lexsort((np.arange(6000), far))[:10]
        assert len(found) == 10 and all(s == far[v] for v, s in found)
        assert [(s, v) for v, s in found] == sorted((s, v) for v, s in found)
        hits += len({v for v, _ in found} & set(want.tolist()))
        if 100 <= q < 500:
            assert [v for v, _ in found] == [v for v in range(100, 112) if v != q][:10]
    assert hits / (10 * len(got)) >= 0.9


def test_nearest_with_a_dense_cell(spark, monkeypatch):
    """A third of all vectors in one grid cell: its ranges are dealt to groups of bounded size and nothing is lost."""
    rng = np.random.default_rng(8)
    spread = rng.normal(size=(2000, 16))
    dense = spread[0] + 1e-7 * rng.normal(size=(1000, 16))
    vectors = np.concatenate([spread, dense])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nearest, "MOST_ROWS", 100)
    monkeypatch.setattr(nearest, "SLICE_ROWS", 128)
    found = nearest.nearest(df, "vec_id % 100 = 0", k=10).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits / 300 >= 0.95 and all(len(x) == 10 for x in got.values())


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(df, "vec_id % 100 = 0").orderBy("rank").collect()]
    assert got == [(100, 1, 2, 0.0), (100, 2, 1, 1.0)]
    assert nearest.nearest(df.limit(0), "vec_id % 100 = 0").count() == 0
    assert nearest.nearest(df.where("vec_id = 100"), "vec_id % 100 = 0").count() == 0
