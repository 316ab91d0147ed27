"""LambdaMART: gradients, trees that do not depend on partitions, held-out gain, artifacts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import ltr

SF = "/root/testdata/sf0.01"
SCHEMA = "query_id long, doc_id long, label long, part string, a double, b double, c double"


def _rows(n=60, seed=1):
    """Relevance follows a, steeply above one half; b is noise, c is mostly missing."""
    rng, out = random.Random(seed), []
    for q in range(n):
        part = "train" if q % 5 < 3 else "validation" if q % 5 == 3 else "test"
        for d in range(rng.randint(1, 14)):
            a = rng.random()
            out.append((q, d, int(a > 0.5) + int(a > 0.8), part, a, rng.random(), rng.random() if rng.random() < 0.1 else None))
    return out


def test_a_gradient_pulls_the_relevant_up():
    label, scores = np.array([0, 2, 1, 0]), np.array([3.0, 1.0, 2.0, 0.0])
    pull, weight = ltr.lambdas(label, scores, 10)
    assert pull[1] > 0 > pull[0] and abs(pull.sum()) < 1e-12 and (weight > 0).all()
    eps, where = 1e-5, []
    for k in range(4):  # the gradient is that of the pairs' logistic loss, each by its swap of nDCG
        gain, ideal, disc = 2.0**label - 1, ltr._ideal(2.0**label - 1, 10), ltr._discounts(scores)

        def loss(s):
            return sum(abs((gain[i] - gain[j]) * (disc[i] - disc[j])) / ideal * np.log1p(np.exp(s[j] - s[i])) for i in range(4) for j in range(4) if label[i] > label[j])  # noqa: B023

        up, down = scores.copy(), scores.copy()
        up[k] += eps
        down[k] -= eps
        where.append((loss(down) - loss(up)) / (2 * eps))
    assert np.allclose(where, pull, atol=1e-6)
    assert not ltr.lambdas(np.zeros(3), np.arange(3.0), 10)[0].any()


def test_ndcg_by_hand():
    assert ltr.ndcg(np.array([0, 1, 2]), np.array([3.0, 2.0, 1.0]), 2) == pytest.approx((1 / np.log2(3)) / (3 + 1 / np.log2(3)))
    assert ltr.ndcg(np.array([0, 0]), np.array([1.0, 2.0]), 10) is None
    assert ltr.ndcg(np.array([0, 1]), np.array([1.0, 1.0]), 10) == pytest.approx(1 / np.log2(3))


def test_same_trees_from_any_partitioning_and_a_gain(spark):
    rows, quick = _rows(), ltr.Settings(rounds=8, rate=0.3, patience=4)
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (ltr.train(ltr.groups(d, ["a", "b", "c"]).repartition(n), ["a", "b", "c"], quick) for d, n in ((df, 1), (df.orderBy(F.rand(3)), 7)))
    assert one == many and one.trees and one.trees[0][0][0][0] == 0
    test = [r for r in rows if r[3] == "test"]
    got = {(r.query_id, r.doc_id): r.score for r in ltr.scored(df.filter("part = 'test'"), one).collect()}
    def mean(score):
        per = [ltr.ndcg(np.array([r[2] for r in test if r[0] == q]), np.array([score(r) for r in test if r[0] == q]), 10) for q in {r[0] for r in test}]
        return np.mean([x for x in per if x is not None])

    assert mean(lambda r: got[r[0], r[1]]) > mean(lambda r: r[5]) + 0.1 and mean(lambda r: got[r[0], r[1]]) > 0.95


def test_trees_equal_plain_ones(spark):
    """The first tree against a direct search over all rows, without Spark."""
    rows, width = _rows(20, 2), 3
    s = ltr.Settings(rounds=1, depth=2)
    df = spark.createDataFrame([(*r[:3], "train", *r[4:]) for r in rows], SCHEMA)
    model = ltr.train(ltr.groups(df, ["a", "b", "c"]), ["a", "b", "c"], s)
    x = np.array([[np.nan if v is None else v for v in r[4:]] for r in rows])
    binned = ltr.bins(x, np.array(model.low), np.array(model.high))
    pull, weight = np.zeros(len(rows)), np.zeros(len(rows))
    for q in {r[0] for r in rows}:
        own = [k for k, r in enumerate(rows) if r[0] == q]
        pull[own], weight[own] = ltr.lambdas(np.array([rows[k][2] for k in own]), np.zeros(len(own)), s.at)

    def split(mask):
        g = lambda m: pull[m].sum() ** 2 / (weight[m].sum() + s.l2)
        found = [(g(mask & (binned[:, f] <= b)) + g(mask & (binned[:, f] > b)) - g(mask), -f, -b) for f in range(width) for b in range(ltr.BINS) if (mask & (binned[:, f] <= b)).any() and (mask & (binned[:, f] > b)).any()]
        gain, f, b = max((round(a, 9), f, b) for a, f, b in found)
        return (-f, -b) if gain > 0 else (-1, -1)

    nodes, values = model.trees[0]
    root = split(np.ones(len(rows), bool))
    left = binned[:, root[0]] <= root[1]
    assert nodes == [root, split(left), split(~left)]
    at = ltr.leaves(binned, nodes)
    assert np.allclose(values, [s.rate * pull[at == k].sum() / (weight[at == k].sum() + s.l2) for k in range(4)], atol=1e-5)


def test_artifacts_are_checked(spark, tmp_path):
    model = ltr.Model(["a", "b"], [0.0, 0.0], [1.0, 2.0], {}, [([(0, 3)], [0.5, -0.5])])
    ltr.save(spark, model, str(tmp_path / "m"))
    assert ltr.load(spark, str(tmp_path / "m"), ["a", "b"]) == model
    with pytest.raises(ValueError, match="features"):
        ltr.load(spark, str(tmp_path / "m"), ["b", "a"])
    model.version = "0"
    ltr.save(spark, model, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="version"):
        ltr.load(spark, str(tmp_path / "m"), ["a", "b"])


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ltr.train(ltr.groups(none, ["a"]), ["a"]).trees == []
    flat = spark.createDataFrame([(1, k, 0, "train", None, 1.0, 2.0) for k in range(4)], SCHEMA)
    model = ltr.train(ltr.groups(flat, ["a", "b"]), ["a", "b"])
    assert model.trees == [] and [r.doc_id for r in ltr.rank(flat, model, 2).orderBy("rank").collect()] == [0, 1]


def test_learned_ranking_beats_the_baseline_on_held_out_queries(spark):
    from larkspur.operators import ranking as K
    from larkspur.plans import learned, recommendation

    model, rows = learned.trained(spark, SF, ltr.Settings(rounds=12, rate=0.2, patience=6))
    test = ltr.scored(rows.filter("part = 'test'"), model, "learned").withColumn("base", K.weighted(recommendation._USED)).collect()

    def mean(name):
        per = []
        for q in {r.query_id for r in test}:
            own = sorted((r for r in test if r.query_id == q), key=lambda r: r.doc_id)
            per.append(ltr.ndcg(np.array([r.label for r in own]), np.array([r[name] for r in own]), 10))
        return np.mean([x for x in per if x is not None])

    print("nDCG learned", mean("learned"), "baseline", mean("base"))
    assert mean("learned") > mean("base")
