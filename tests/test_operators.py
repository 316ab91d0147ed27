"""Small cases of operators whose edges the driver tables do not reach."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import machine_token, missing, multi_values, redacted, title, tokens
from larkspur.operators import attributes, evaluate, lexical, ranking, recommend, retrieval, serving
from larkspur.sources import sinks, tables


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).collect()[0][0]


@pytest.mark.parametrize("color,name,code", [("darkblue", "dark_blue", False), ("greymelange", "grey_melange", False), ("lightgreymelange", "light_grey_melange", False), ("mediumpink", "medium_pink", False), ("darkgreymelanged", "darkgreymelanged", False), ("02dx", "02dx", True), ("pg5", "pg5", True), ("gray", "grey", False), (None, None, False), (" ", " ", False)])
def test_color_names(color, name, code):
    assert attributes.color_name(color) == (name, code)


def test_text_expressions(spark):
    assert one(spark, "code-by-lifestyle levi's", title) == "Code-By-Lifestyle Levi'S"
    assert one(spark, "t_shirt", machine_token) == "T-Shirt"
    assert one(spark, "slim_fit", machine_token) == "Slim Fit"
    assert one(spark, " a | b||a ", multi_values) == ["a", "b"]
    assert one(spark, " | ", multi_values) is None
    assert one(spark, " \t\n", missing) is True
    assert one(spark, "Café 3X", tokens) == ["caf", "3x"]
    assert one(spark, "see postgresql://u:p@h/db and Bearer abc.def at /etc/x/y.txt", redacted) == "see [redacted] and Bearer [redacted] at [redacted]"


def test_redacted_messages_returns_every_turn(spark, tmp_path):
    from larkspur.plans import catalog

    rows = [(k, 0, "x " * 200 if k % 2 else None) for k in range(len(catalog.PLANTED))]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.n_chars for r in catalog.redacted_messages(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[0] == len("see [redacted] now") and got[7] == len("An unexpected error occurred") and got[1] == 240


def test_bm25_scores_of_two_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "A a z")], "query_id long, query_text string")
    got = {r.doc_id: r.score for r in lexical.bm25_scores(q, docs).collect()}
    import math

    idf, avg = math.log1p((3 - 2 + 0.5) / 2.5), 5 / 3
    want = {d: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg)) for d, tf, n in ((1, 1, 2), (2, 2, 3))}
    assert got == pytest.approx(want)


def test_bm25_queries_take_whole_items(spark, tmp_path):
    import math

    from larkspur.plans import search

    texts, item = {1: "one two", 2: "seven eight eight", 3: "none of these"}, "one two three four five six seven eight"
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {d: t.split() for d, t in texts.items()}
    avg = sum(map(len, words.values())) / len(words)
    want = {}
    for d, w in words.items():
        for t in set(item.split()) & set(w):
            df = sum(t in x for x in words.values())
            want[d] = want.get(d, 0) + math.log1p((len(words) - df + 0.5) / (df + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg))
    assert {r.doc_id: r.score for r in search.bm25_topk(spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-6)
    assert search.bm25_candidates_union(spark, str(tmp_path)).collect()[0].n_candidates == 2


def test_rrf_of_rank_one(spark):
    lists = spark.createDataFrame([(1, 5, 1), (1, 5, 3), (1, 6, 1)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in retrieval.rrf(lists).collect()}
    assert got == pytest.approx({5: 1 / 61 + 1 / 63, 6: 1 / 61})


def test_constant_group_is_half(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (2, None)], "g long, x double")
    assert sorted((r.g, -1 if r.x is None else r.x) for r in ranking.minmax(df, "g", ["x"]).collect()) == [(1, 0.5), (1, 0.5), (2, -1), (2, 0.0), (2, 1.0)]


def test_rejected_rows_use_no_quota(spark):
    rows = [(1, 10, 1, "a", "x"), (1, 11, 2, "a", "y"), (1, 12, 3, "b", "y"), (1, 13, 4, None, "y"), (1, 14, 5, "c", None)]
    df = spark.createDataFrame(rows, "seed long, doc_id long, rank long, brand string, kind string")
    got = {r.doc_id: (r.decision, r.position) for r in recommend.select_capped(df, {"brand": 1, "kind": 1}, 3).collect()}
    assert got == {10: ("selected", 1), 11: ("brand_cap", None), 12: ("selected", 2), 13: ("kind_cap", None), 14: ("selected", 3)}


def test_metrics_of_a_query_without_results(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    ranked = spark.createDataFrame([("v", 1, 5, 1)], "variant string, query_id long, doc_id long, rank long")
    j = spark.createDataFrame([(1, 5, 3)], "query_id long, doc_id long, grade int")
    m = {r.query_id: r for r in evaluate.query_metrics(q, ranked, j, [5]).collect()}
    assert (m[1].precision, m[1].recall, m[1].ndcg, m[1].rr) == (1.0, 1.0, 1.0, 1.0)
    assert (m[2].precision, m[2].recall, m[2].ndcg, m[2].rr) == (0.0, None, 0.0, 0.0)


def test_registered_resamples_and_rounds(spark, monkeypatch):
    from hashlib import md5

    from larkspur.plans import evaluation

    diffs = [1.0 + k for k in range(20)]
    df = spark.createDataFrame([("m", k, d) for k, d in enumerate(diffs)], "metric string, query_id long, diff double")
    monkeypatch.setattr(evaluation, "_diffs", lambda *_: df)
    draw = lambda b, i: int(md5(f"42|{b}|{i}".encode()).hexdigest()[:8], 16)
    means = sorted(sum(diffs[draw(b, i) % 20] for i in range(20)) / 20 for b in range(5000))
    flips = [abs(sum(d if draw(b, i) % 2 == 0 else -d for i, d in enumerate(diffs))) / 20 for b in range(10000)]
    r = evaluation.bootstrap_ci(spark, "").collect()[0]
    assert (r.low, r.high) == pytest.approx((means[125], means[4874]), abs=1e-6)
    want = (sum(f >= sum(diffs) / 20 - 1e-12 for f in flips) + 1) / 10001
    assert evaluation.sign_flip_pvalue(spark, "").collect()[0].p == pytest.approx(want, abs=1e-6) and want < 1 / 301


def test_benjamini_hochberg_passes_nulls(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "t string, p double")
    assert {r.t: r.adjusted for r in evaluate.benjamini_hochberg(t).collect()} == pytest.approx({"a": 0.03, "b": 0.04, "c": 0.04, "d": None})


def test_overlap_of_intervals(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (5, 9)], "s int, e int")
    assert serving.overlap(df, "s", "e").collect()[0][0] == 2


def test_publish_upsert_and_checksum(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    path = f"file://{tmp_path}/t"
    first = sinks.publish(df, path)
    again = sinks.publish(df.orderBy(F.desc("id")), path)
    assert first == again and spark.read.parquet(path).count() == 2
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, sinks.upsert(df, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tuple(sinks.upsert_counts(df, new, "id").collect()[0]) == (1, 1)
    assert sinks.remaining(df, new, "id").count() == 1


def test_csv_scan(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_bytes("a,b\n1,caf\xe9\n".encode("windows-1252"))
    assert [tuple(r) for r in tables.csv_catalog(spark, str(p), ["a", "b"]).collect()] == [("1", "café")]
    with pytest.raises(ValueError):
        tables.csv_catalog(spark, str(p), ["a", "c"])


def test_jsonl_last_wins(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query_id": "x", "v": 1}\n\n[1]\n{"query_id": "x", "v": 2}\n')
    assert [r.value for r in tables.jsonl_by_key(spark, str(p)).collect()] == ['{"query_id": "x", "v": 2}']


def test_streaming_counters_resume(spark, tmp_path):
    from larkspur.streaming import events as E

    src = f"{tmp_path}/in"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(src)
    got = []
    for _ in range(2):
        E.run_available(E.read_events(spark, src, e.schema).select("event_id"), f"{tmp_path}/cp", lambda b, i: got.append(b.count()))
    assert sum(got) == e.count()
    out = []
    E.run_available(E.window_limits(E.read_events(spark, src, e.schema, 3), "user_id", 1, window="1 day", late="3650 days"), f"{tmp_path}/cp2", lambda b, i: out.extend(b.collect()), "complete")
    assert sum(r.n for r in out) == e.count() and all(r.allowed + r.refused == r.n for r in out)


def test_single_valued_attributes_prefer_the_value_of_the_longest_expression(spark):
    cases = {
        "oversized regular fit tee": ("fit", "oversized_fit"), "v-neck hooded top": ("neckline", "v_neck"), "hooded v neck": ("neckline", "v_neck"),
        "half sleeve and full sleeves": ("sleeve", "full_sleeve"), "short sleeves 3/4 sleeve": ("sleeve", "short_sleeve"), "sweatshirt shirt": ("product_type", "sweatshirt"),
        "co-ord t-shirt": ("product_type", "t_shirt"), "jeans dress": ("product_type", "dress"), "henley hooded": ("neckline", "hooded"), "shirtless": ("product_type", None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "d string")
    got = {r.d: r for r in attributes.extract(df, "d").collect()}
    assert {t: got[t][a] for t, (a, _) in cases.items()} == {t: v for t, (_, v) in cases.items()}


def test_redaction_of_planted_secrets(spark):
    cases = {
        "at postgres://user:pw@host/db": "at [redacted]", "POSTGRESQL://x y": "[redacted] y", "mongodb://a": "[redacted]", "use bearer abc": "use Bearer [redacted]",
        "open /tmp failed": "open [redacted] failed", "C:\\\\dir\\\\f x": "[redacted] x", '"/etc/p" q': '"[redacted]" q', "Traceback: x": "An unexpected error occurred",
        "no Stack Trace": "An unexpected error occurred", "  plain ": "plain", "x" * 300: "x" * 237 + "...", "y" * 240: "y" * 240,
    }
    got = {r.m: r.r for r in spark.createDataFrame([(t,) for t in cases], "m string").select("m", redacted(F.col("m")).alias("r")).collect()}
    assert got == cases


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from larkspur.api import Engine
    from larkspur.plans import recommendation, search

    sf = "/root/testdata/sf0.001"
    texts = recommendation.products(spark, sf).select("id", F.concat_ws(" ", "p_name", "brand").alias("text"))
    catalog = recommendation.goods(spark, sf).join(texts, "id").cache()
    return Engine.build(catalog, str(tmp_path_factory.mktemp("index") / "lexical"), vectors=search.vectors(spark, sf).join(catalog.select("id"), "id", "left_semi"))


def test_search_call(engine):
    got = engine.search("red ring", 5).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and got
    best = engine.product(got[0].doc_id).collect()[0]
    assert "red" in best.text and "ring" in best.text
    only = engine.search("red ring", 5, {"color": ["red"], "max_discount_price": 900}).collect()
    kept = {r.id for r in engine.catalog.filter("array_contains(color, 'red') and discount_price <= 900").collect()}
    assert only and {r.doc_id for r in only} <= kept
    engine.encode = lambda text: engine.vectors.filter("id = 3").collect()[0].v
    assert engine.search("red ring", 50).filter("doc_id = 3").count() == 1
    engine.encode = None
    for bad in (lambda: engine.search(" "), lambda: engine.search("x", engine.pool + 1), lambda: engine.search("x", 0), lambda: engine.search("x", 1, {"size": 1}), lambda: engine.search("x", 1, {"category_gender": "kids"}), lambda: engine.search("x", 1, {"min_discount_price": 2, "max_discount_price": 1})):
        with pytest.raises(ValueError):
            bad()


def test_recommend_call(engine):
    got = engine.recommend(20, 8).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and 20 not in {r.doc_id for r in got} and got
    rows = {r.id: r for r in engine.catalog.collect()}
    brands = [rows[r.doc_id].brand for r in got if rows[r.doc_id].brand]
    assert max(map(brands.count, brands)) <= 2
    assert all(rows[r.doc_id].category_gender == "Men" for r in engine.recommend(20, 5, {"category_gender": "Men"}).collect())


def test_missing_index_and_missing_metadata_raise(spark, engine, tmp_path):
    from larkspur.operators import constraints
    from larkspur.plans import products
    from larkspur.sources.sinks import index_tables

    with pytest.raises(FileNotFoundError):
        index_tables(spark, str(tmp_path))
    asked = products.requests(spark)
    for query, raises in ((3, False), (0, True)):
        lost = spark.createDataFrame([(query, 10**9)], "query_id long, doc_id long")
        if raises:
            with pytest.raises(Exception, match="no metadata"):
                constraints.filter_candidates(lost, asked, engine.catalog).collect()
        else:
            assert constraints.filter_candidates(lost, asked, engine.catalog).count() == 1
    with pytest.raises(Exception, match="blank term"):
        lexical.lookup(index_tables(spark, engine.index)[0], spark.createDataFrame([(" ",)], "term string")).collect()


def test_artifacts_and_lookups(spark, tmp_path):
    import json

    from larkspur.functions.vector import similarity
    from larkspur.operators import quality_checks

    judged = lambda grade: {"queries": [{"query_id": "q1", "query_text": "red top", "query_category": "c", "relevance_judgments": [{"product_id": "P1", "grade": grade}]}]}
    for name, value in (("good", judged(3)), ("bad", judged(7)), ("cases", {"cases": [{"seed_product_id": "P1", "seed_category": "c", "relevance_judgments": [{"product_id": "P1", "grade": 1}]}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert [tuple(r) for r in tables.benchmark_queries(tables.json_artifact(spark, f"{tmp_path}/good.json")).collect()] == [("q1", "red top", "c", "P1", 3)]
    with pytest.raises(Exception, match="grade beyond"):
        tables.benchmark_queries(tables.json_artifact(spark, f"{tmp_path}/bad.json")).collect()
    with pytest.raises(Exception, match="judged for itself"):
        tables.recommendation_cases(tables.json_artifact(spark, f"{tmp_path}/cases.json")).collect()
    binary = spark.createDataFrame([("q", ["a", "b"])], "query_id string, relevant_product_ids array<string>")
    assert sorted(tuple(r) for r in tables.binary_to_graded(binary).collect()) == [("q", "a", 2), ("q", "b", 2)]

    demo = tables.demo_catalog(spark, 4)
    assert tables.point_lookup(demo, "product_id", "DEMO-2").count() == 1
    asked = spark.createDataFrame([(1, "DEMO-3"), (2, "DEMO-1")], "pos int, id string")
    assert [r.product_id for r in tables.batch_lookup(demo, "product_id", asked).collect()] == ["DEMO-3", "DEMO-1"]
    with pytest.raises(Exception, match="is missing"):
        tables.batch_lookup(demo, "product_id", asked.union(spark.createDataFrame([(3, "x")], asked.schema))).collect()
    new = spark.createDataFrame([("DEMO-1", [9.0])], "product_id string, embedding array<float>")
    assert {r.product_id: r.embedding for r in sinks.update_vectors(demo, new, "product_id").collect()}["DEMO-1"] == [9.0]
    with pytest.raises(ValueError, match="unknown ids"):
        sinks.update_vectors(demo, spark.createDataFrame([("x", [1.0])], new.schema), "product_id")
    rows = tables.id_text_scan(spark.createDataFrame([(" a ", "t"), ("b", None)], "i string, t string"), "i", "t")
    assert sorted(r.id for r in tables.assert_ids(rows).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        tables.assert_ids(rows.union(rows))
    sinks.json_lines(demo.select("product_id"), f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == 3
    assert quality_checks.schema_findings(["a"], ["a", "b"]) == [("missing_columns", "FAIL")] and quality_checks.schema_findings(["a", "b"], ["a", "b"]) == [("unexpected_columns", "PASS"), ("column_count", "PASS")]
    assert one(spark, 0.25, similarity, "double") == 0.75


def test_windows_are_let_go_behind_the_watermark(spark, tmp_path):
    from larkspur.streaming import events

    schema = "ts timestamp, event_type string, value double"
    for n, times in enumerate((["00:00:10", "00:00:20"], ["01:00:00"], ["00:00:30", "02:00:00"], ["03:00:00"])):  # 00:00:30 comes after its window was let go
        rows = spark.createDataFrame([(f"2024-01-01 {t}", "view", 1.0) for t in times], "ts string, event_type string, value double")
        rows.select(F.to_timestamp("ts").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got: list = []
        stream = events.window_counters(events.read_events(spark, f"{tmp_path}/in", schema))
        events.run_available(stream, f"{tmp_path}/checkpoint", lambda df, _, got=got: got.extend((str(r.start), r.n) for r in df.collect()))
        if n == 1:
            assert got == [("2024-01-01 00:00:00", 2)]
        if n == 3:
            assert got == [("2024-01-01 02:00:00", 1)]
