"""Exact quantiles of groups against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import order_stats, serving


def _want(rows, p):
    out = {}
    for g in {r[0] for r in rows}:
        x = [r[1] for r in rows if r[0] == g and r[1] is not None and np.isfinite(r[1])]
        if x:
            out[g] = float(np.quantile(x, p))
    return out


@pytest.mark.parametrize("buckets", [32, 1024])
def test_quantiles_equal_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(order_stats, "BUCKETS", buckets)
    rng = np.random.default_rng(5)
    rows = [("even", float(x)) for x in rng.integers(0, 5, 60)] + [(None, float(x)) for x in rng.normal(size=31)] + [("steep", float(x)) for x in 10.0 ** rng.integers(-300, 300, 40)]
    rows += [("one", 7.0), ("two", -1.5), ("two", 2.5), ("ends", 8e307), ("ends", -8e307), ("none", None), ("odd", float("nan")), ("odd", 3.0), ("odd", float("inf"))]
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r.g: r for r in order_stats.quantiles(df, ["g"], "x", ps).collect()}
    for name, p in ps.items():
        want = _want(rows, p)
        assert set(got) == set(want)
        for g in want:
            assert got[g][name] == pytest.approx(want[g], rel=1e-12), (g, name)


def test_latency_of_groups_by_two_columns(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"), (F.col("id") * 7919 % 1009).alias("ms"))
    got = serving.latency(df, ["a", "b"], "ms").collect()
    rows = [((r.a, r.b), float(r.ms)) for r in df.collect()]
    assert len(got) == 6
    for r in got:
        x = [v for g, v in rows if g == (r.a, r.b)]
        assert [r.n, r.min, r.max] == [len(x), min(x), max(x)] and [r.mean, r.p50, r.p95, r.p99] == pytest.approx([np.mean(x), *np.quantile(x, [0.5, 0.95, 0.99])])


def test_no_values(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert order_stats.quantiles(none, ["g"], "x", {"p": 0.5}).count() == 0
