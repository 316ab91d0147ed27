"""Steps whose work or memory once grew faster than the tables."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import evaluate, lexical, recommend, retrieval
from larkspur.plans import evaluation, learned, recommendation

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted((r[0], r.doc_id, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("alone", [False, True])
def test_neighbours_in_small_pieces(spark, monkeypatch, alone):
    for name, n in (("ROWS", 7), ("QUERIES", 3), ("PENDING", 5)):
        monkeypatch.setattr(retrieval, name, n)
    rng = random.Random(1)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)] + [1.0]) for k in range(90)]
    v = retrieval.unit(spark.createDataFrame(rows, "id long, e array<double>"), "id", "e").repartition(3)
    unit = {r.id: r.v for r in v.collect()}
    want = []
    for q in range(0, 90, 9):
        scored = sorted((-round(sum(x * y for x, y in zip(unit[q], unit[d], strict=True)), 9), d) for d in unit if not (alone and d == q))
        want += [(q, d, n, -s) for n, (s, d) in enumerate(scored[:6], 1)]
    assert [x[:3] for x in _rows(retrieval.knn(v.filter("id % 9 = 0"), v, 6, alone))] == [x[:3] for x in sorted(want)]


def test_alike_products_are_scored_once_and_never_broadcast(spark):
    rows = spark.range(4000).select("id", F.lit("Men").alias("gender"), F.concat(F.lit("b"), F.col("id") % 2).alias("brand"), F.array(F.lit("red")).alias("tags"))
    out = recommend.attribute_candidates(rows.filter("id % 1000 = 0"), rows, "gender", {"brand": 1.0}, {"tags": 0.5}, 3)
    assert "BroadcastHashJoin" not in _plan(out)
    assert {(r.seed, r.doc_id) for r in out.collect()} == {(0, 2), (0, 4), (0, 6), *((s, d) for s in (1000, 2000, 3000) for d in (0, 2, 4))}


def test_lexical_candidates_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["Red bolt", "bolt red", "blue nut", "nut", "", None, "red red bolt"])) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seeds = docs.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "seed")
    every = lexical.bm25_scores(seeds.select(F.col("seed").alias("query_id"), F.col("text").alias("query_text")), docs).filter("query_id <> doc_id")
    assert _rows(recommend.lexical_candidates(seeds, docs, 4)) == _rows(lexical.top_k(every, 4))


@pytest.mark.parametrize("block", [4096, 3])
def test_best_by_bm25_equal_all_scores_without_shuffling_them(spark, monkeypatch, block):
    for name, n in (("QUERY_BLOCK", block), ("ROWS", 7), ("PRODUCTS", 11), ("PENDING", 5)):
        monkeypatch.setattr(lexical, name, n)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["Red", "bolt", "blue", "nut", "a1", "gear", "\u00e9t\u00e9"]) for _ in range(n))
    docs = spark.createDataFrame([(k, rng.choice([text(k % 9), None, "", "red bolt"])) for k in range(150)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(["red red bolt", "", "unknown", "gear a1 nut", "\u00e9t\u00e9", "blue", None, "NUT"])], "query_id long, query_text string")
    got = lexical.bm25_top(queries, docs, 4)
    assert _rows(got) == _rows(lexical.top_k(lexical.bm25_scores(queries, docs), 4))
    assert "Join" not in _plan(got) and "Aggregate" not in _plan(got)
    nothing = docs.filter("text is null")
    assert lexical.bm25_top(queries, nothing, 4).collect() == lexical.bm25_top(queries.limit(0), docs, 4).collect() == lexical.bm25_top(queries, docs.limit(0), 4).collect() == []


def test_given_pairs_meet_their_own_terms_alone(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "d")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a c"), (8, "d")], "query_id long, query_text string")
    pairs = spark.createDataFrame([(7, 1), (7, 3), (8, 3)], "query_id long, doc_id long")
    got = lexical.bm25_scores(q, docs, candidates=pairs)
    every = {(r.query_id, r.doc_id): r.score for r in lexical.bm25_scores(q, docs).collect()}
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == {(7, 1): every[7, 1], (7, 3): 0.0, (8, 3): every[8, 3]}
    assert any("Join" in x and "term#" in x and "doc_id#" in x for x in _plan(got).splitlines())


def test_jaccard_compares_kinds_of_words(spark):
    plan = recommendation.jaccard_similarity(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [gender#" in x and "words#" in x for x in plan.splitlines())


def test_bounds_of_ranges_in_small_pieces(spark, monkeypatch):
    from larkspur.operators import block_index

    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rng.choices("abcdefgh", k=6))) for k in range(60)], "doc_id long, text string")
    q = spark.createDataFrame([(k, " ".join(rng.choices("abcdefghz", k=3))) for k in range(9)], "query_id long, query_text string")
    monkeypatch.setattr(block_index, "QUERY_BLOCK", 4)
    monkeypatch.setattr(block_index, "PIECE", 3)
    blocks, terms, _ = block_index.build(docs, size=2)
    asked, found = block_index.bounds(q, blocks, terms)
    want = blocks.join(asked, "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("impact")).alias("bound"), F.count(F.lit(1)).alias("n_blocks"))
    rows = lambda df: sorted((r.query_id, r.range, round(r.bound, 9), r.n_blocks) for r in df.collect())
    assert rows(found) == rows(want)


def test_seed_failures_rank_once_and_pair_listed_products_alone(spark, monkeypatch):
    from larkspur.operators import diagnose
    from larkspur.plans import products

    ranked, judged, calls, inner = recommendation._ranked, [], [], diagnose.seed_failures
    monkeypatch.setattr(recommendation, "_ranked", lambda *a: calls.append(a) or ranked(*a))
    monkeypatch.setattr(diagnose, "seed_failures", lambda seeds, rel, pool, *a, **b: judged.append((rel, pool, b.get("counts"))) or inner(seeds, rel, pool, *a, **b))
    got = sorted(map(tuple, products.seed_failures(spark, SMALL).collect()))
    (rel, pool, counts), p = judged[0], recommendation.products(spark, SMALL).select("id", "p_name")
    every = p.filter("id % 5 = 1").withColumnRenamed("id", "doc_id").join(p.filter("id % 20 = 0").withColumnRenamed("id", "seed"), "p_name").select("seed", "doc_id")
    assert len(calls) == 1 and rel.join(pool, ["seed", "doc_id"], "left_anti").count() == 0
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, every.groupBy("seed").count().collect()))
    final = recommendation.two_caps(pool).filter("decision = 'selected'").select("seed", "doc_id", F.col("position").alias("rank"))
    seeds = recommendation.seeds(spark, SMALL).select(F.col("id").alias("seed"))
    assert got == sorted(map(tuple, inner(seeds, every, pool, pool, final, 5, recommendation.TOP).collect()))


def test_the_length_of_a_vector_is_worked_out_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None])], "id long, e array<double>")
    out = retrieval.unit(rows, "id", "e")
    assert [tuple(r) for r in out.collect()] == [(1, [0.6, 0.8])]
    project = next(x for x in _plan(out).splitlines() if "Project" in x)
    inner = project[project.rindex("transform(") :]
    assert "aggregate(" not in inner


def _odd_vectors(spark, path):
    """Labels that are missing, of one row, of queries alone, and a row that is there twice."""
    rows = [(k, [1.0, float(k)], None if k % 11 == 0 else 7 if k == 3 else 8 if k == 40 else k // 2 % 4) for k in range(130)]
    spark.createDataFrame([*rows, rows[60], rows[20], rows[61]], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_judgments_are_counted_and_looked_up_without_pairs(spark, tmp_path):
    sf = _odd_vectors(spark, tmp_path)
    every = evaluation.judgments(spark, sf)
    counts = evaluation.judgment_counts(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(counts) == rows(every.groupBy("query_id", "grade").count())
    rng = random.Random(4)
    ranked = spark.createDataFrame([(v, q, d, n) for v in "ab" for q in range(8) for n, d in enumerate(rng.sample(range(140), 9), 1)], "variant string, query_id long, doc_id long, rank long")
    some = evaluation.judgments_of(spark, sf, ranked)
    assert rows(some) == rows(every.join(ranked.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "grade"))
    queries = spark.range(10).withColumnRenamed("id", "query_id")
    got = evaluate.query_metrics(queries, ranked, some, [1, 3, 9], counts=counts)
    rounded = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df.fillna(-1))]
    assert rounded(got) == rounded(evaluate.query_metrics(queries, ranked, every, [1, 3, 9]))


@pytest.mark.parametrize("name", ["_metrics", "_judged"])
def test_no_query_meets_all_documents_of_its_label(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(evaluation, "judgments", refuse)
    assert getattr(evaluation if name == "_metrics" else learned, name)(spark, SMALL).count()


def test_draws_hold_one_row_of_numbers_beside_the_table():
    import tracemalloc

    tracemalloc.start()
    drawn = evaluate.draws(42, 3, 50, 2000)
    assert tracemalloc.get_traced_memory()[1] < 1.5 * drawn.nbytes
    tracemalloc.stop()
