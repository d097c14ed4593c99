"""The pipeline against the same steps by hand."""

from collections import Counter

import corpus_pipeline
from lensfold.llm import quality
from tests.llm.frames import awkward, empty
from tests.llm.test_corpus import brute_classes, filled
from tests.llm.test_text import plain_scan

SF_DIR = "/root/testdata/sf0.001"


def test_stages_on_given_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        outs.append(docs.collect())
    every = {r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    good, single, masked, mixed, ids = outs
    kept = {r["doc_id"] for r in good}
    assert all((d in kept) == (q == 1) for d, q in labels.items() if d in every)
    want = brute_classes([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted({c for c, _ in want.values()})
    assert len(masked) == len(single) and not any(plain_scan(r["text"]) for r in masked)
    clean = {r["doc_id"]: r["text"] for r in single if not plain_scan(r["text"])}
    assert all(clean[r["doc_id"]] == r["text"] for r in masked if r["doc_id"] in clean)
    sizes, taken = Counter(), Counter()
    for r in masked:
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}
    longest = max(len(r["text"].split()) for r in masked)
    assert all(abs(taken[s] - t) <= longest / 2 + 1 for s, t in filled(sizes, weights, 1.5, 2.0).items())
    assert Counter(r["doc_id"] for r in ids) == Counter(r["doc_id"] for r in mixed) and all(len(r["ids"]) == r["n_tokens"] for r in ids)


def test_awkward_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_quality_model_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.select("doc_id", half.evidence().alias("e")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum((r["e"] > 0) == (r["quality"] == 1) for r in rows) / len(rows) > 0.97


def test_repeated_rows_follow_one_rule(spark):
    """Blank rows stay whatever other rows do; of rows with one id and text the first by the other columns stays, in any order of rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    blank = [(1, "", "en", "a", 0), (1, "", "en", "b", 0), (3, None, None, "b", None), (3, None, None, "b", None)]
    text = [(2, "a text of some words here", "en", s, 5) for s in "bca"]
    for rows, repeats in ((blank + text[:1], 1), (blank + text, 3), (blank + text + text, 6)):
        outs = []
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, schema).repartition(3)
            outs.append(sorted(map(tuple, corpus_pipeline.without_near_copies(spark, docs, SF_DIR).collect()), key=repr))
        kept = [r for r in outs[0] if r[0] == 2]
        assert outs[0] == outs[1] and len(kept) == 1 and kept[0] in text and sorted((r for r in outs[0] if r[0] != 2), key=repr) == sorted(blank, key=repr), repeats


def test_run_gives_the_same_rows_again(spark, tmp_path):
    """Also when the table's rows lie in another order."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    outs = []
    for name, order in (("a", docs.coalesce(1)), ("b", docs.orderBy("text").repartition(5))):
        order.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        outs.append(sorted((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()))
    assert outs[0] == outs[1]
