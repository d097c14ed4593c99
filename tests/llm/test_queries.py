"""Every query on awkward tables and on empty ones."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lensfold.llm.queries import QUERIES
from tests.llm.frames import EXTRA, awkward, empty, prose

EXTRA_VEC = "rank int, score double, query_id long, cls long, slice int, id string"
PER_DOCUMENT = [n for n in QUERIES if not n.startswith(("op5_", "op11_"))]  # op11 gives pieces: see test_sequences


def tables(spark, root, docs):
    docs.write.parquet(f"{root}/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 0, "x"), (5, 1, 0, "x"), (11, 0, 0, "x"), (12, 0, None, "x"), (None, 1, 1, "x"), (7, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    vectors = [(i, [float(i % 7), float(i % 5), 1.0], 0, 1, 0.5, 1, 1, 1, "x") for i in range(220)]
    vectors += [(300, None, None, None, None, None, None, None, None), (400, [0.0, 0.0, 0.0], 0, 1, 0.5, 1, 1, 1, "x"), (None, [1.0, 1.0, 1.0], 0, 1, 0.5, 1, 1, 1, "x"), (500, [1.0], 0, 1, 0.5, 1, 1, 1, "x")]
    vectors = spark.createDataFrame(vectors, f"vec_id long, embedding array<float>, label int, {EXTRA_VEC}")
    if docs.isEmpty():
        labels, vectors = labels.limit(0), vectors.limit(0)
    labels.write.parquet(f"{root}/labels.parquet")
    vectors.write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    notices = ["Released under the MIT License.", f"{prose(1, 30)}\nAll rights reserved.", prose(2, 50), prose(2, 50)]
    return tables(spark, tmp_path_factory.mktemp("odd"), awkward(spark, notices))


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("bare"), empty(spark))


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_for_each_document(spark, odd, name):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = QUERIES[name](spark, odd)
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    assert ids(out) == ids(docs)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, bare, name):
    assert entry.queries()[name](spark, bare).count() == 0


def test_nearest_on_awkward_vectors(spark, odd):
    rows = QUERIES["op5_nearest"](spark, odd).collect()
    assert {r["query_id"] for r in rows} == {0, 100, 200} and len(rows) == 30


def test_pipeline_on_awkward_documents(spark, odd):
    assert corpus_pipeline.run(spark, odd).columns == ["doc_id", "source", "lang", "n_tokens", "ids"]


def test_extra_columns_are_those_that_operators_use():
    assert {"size", "h", "k", "shard", "node", "label"} <= set(EXTRA)
