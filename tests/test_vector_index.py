"""The partitioned vector index against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import retrieval, vector_index
from larkspur.plans import search as S


def _vectors(spark, n=600, width=12, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(10, width))[rng.integers(10, size=n)] + 0.3 * rng.normal(size=(n, width))
    x[1], x[2] = x[0], x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)


def _rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("lists,k,first", [(8, 5, 1), (30, 3, 2), (1, 1000, 1)])
def test_the_exact_way_is_exact(spark, monkeypatch, lists, k, first):
    monkeypatch.setattr(vector_index, "CELL", 50)  # lists and their queries in several cells
    vectors = _vectors(spark)
    path = vector_index.build(vectors, lists=lists)
    queries = vectors.filter("id % 9 = 0")
    assert _rows(vector_index.search(queries, path, k, first)) == _rows(retrieval.knn(queries, vectors, k))
    assert _rows(vector_index.search(queries, path, k, first, exclude_self=True)) == _rows(retrieval.knn(queries, vectors, k, exclude_self=True))


def test_bounds_leave_lists_out(spark):
    vectors = _vectors(spark, 900)
    path = vector_index.build(vectors, lists=10)
    used = vector_index.use(vectors.filter("id % 30 = 0"), path, 3, 1).agg(F.sum("n_compared") / F.sum("n_rows")).first()[0]
    assert used < 0.7


def test_nothing_to_search(spark):
    vectors = _vectors(spark, 20)
    assert vector_index.search(vectors, vector_index.build(vectors.limit(0)), 3).count() == 0
    assert vector_index.search(vectors.limit(0), vector_index.build(vectors), 3).count() == 0


def test_recall_of_chosen_probes_at_the_bench_size(spark):
    """The number of probes is chosen for one half of the queries, the recall measured on the other."""
    sf = "/root/testdata/sf0.1"
    vectors, queries = S.vectors(spark, sf), S.query_vectors(spark, sf)
    path = vector_index.build(vectors)
    first = vector_index.probes_for(queries.filter("id % 2 = 0"), path, 10)
    other = queries.filter("id % 2 = 1")
    want = {(r.query_id, r.doc_id) for r in retrieval.knn(other, vectors, 10).collect()}
    got = {(r.query_id, r.doc_id) for r in vector_index.search(other, path, 10, first, exact=False).collect()}
    rows, exact = (vector_index.use(other, path, 10, n).agg(F.sum("n_compared") / F.sum("n_rows")).first()[0] for n in (first, 1))
    print("recall", len(want & got) / len(want), "lists", first, "of", vector_index.LISTS, "rows then", rows, "exact", exact)
    assert len(want & got) / len(want) >= 0.92


def test_few_probes_do_where_vectors_cluster(spark):
    vectors = _vectors(spark, 900)
    path = vector_index.build(vectors, lists=10)
    queries = vectors.filter("id % 30 = 0")
    first = vector_index.probes_for(queries, path, 10)
    got = {(r.query_id, r.doc_id) for r in vector_index.search(queries, path, 10, first, exact=False).collect()}
    want = {(r.query_id, r.doc_id) for r in retrieval.knn(queries, vectors, 10).collect()}
    assert first <= 3 and len(want & got) >= 0.95 * len(want)
