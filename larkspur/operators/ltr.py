"""LambdaMART over Spark: lambda gradients within query groups, histogram trees from partition sums, early stopping.

One written row holds a query's pool (a ranked list, so of a bounded size).  Each level of a tree is one pass: a task
scores its queries by the trees so far, takes their lambdas, and adds them up by (leaf, feature, bin); Spark sums these, and the
driver picks splits from leaves x features x bins numbers.  Gradients and gains are summed as integers
(multiples of 1 / UNIT), so that the trees do not depend on how rows are partitioned.

Features are cut into BINS equal parts between their least and largest value over the training rows; a missing or
non-finite value is in bin 0, below all others.  Equal gains go to the first feature and the lowest bin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.lexical import top_k
from larkspur.session import ship, written

VERSION = "1"
BINS, UNIT = 64, 1 << 24
SUMS = "leaf int, feature int, bin int, gradient long, weight long, n long"


@dataclass(frozen=True)
class Settings:
    """Boosting rounds, learning rate, depth (8 leaves), rounds without gain before it stops, L2 term, rows in a leaf, depth of nDCG."""

    rounds: int = 50
    rate: float = 0.05
    depth: int = 3
    patience: int = 10
    l2: float = 1.0
    least_rows: int = 1
    at: int = 10


@dataclass
class Model:
    """Trees as complete binary ones: for each inner node (feature, bin: left up to it; -1: no split), for each leaf its value."""

    features: list[str]
    low: list[float]
    high: list[float]
    settings: dict = field(default_factory=dict)
    trees: list[tuple[list[tuple[int, int]], list[float]]] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)  # validation nDCG before each round
    version: str = VERSION


def bins(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    span = np.where(high > low, high - low, 1.0)
    with np.errstate(invalid="ignore"):
        at = 1 + np.clip(np.floor((x - low) / span * BINS), 0, BINS - 1)
    return np.where(np.isfinite(x), at, 0).astype(np.int64)


def leaves(binned: np.ndarray, nodes: list[tuple[int, int]]) -> np.ndarray:
    """Leaf of each row, for as many levels as the nodes have."""
    at, start, width = np.zeros(len(binned), np.int64), 0, 1
    while start < len(nodes):
        level = np.array(nodes[start : start + width])
        feature, most = level[at].T
        right = (feature >= 0) & (binned[np.arange(len(binned)), np.maximum(feature, 0)] > most)
        at, start, width = 2 * at + right, start + width, 2 * width
    return at


def predict(binned: np.ndarray, trees: list) -> np.ndarray:
    out = np.zeros(len(binned))
    for nodes, values in trees:
        out += np.array(values)[leaves(binned, nodes)]
    return out


def _discounts(scores: np.ndarray) -> np.ndarray:
    """Discount of each row at its present place; equal scores keep the rows' own order."""
    place = np.empty(len(scores), np.int64)
    place[np.argsort(-np.round(scores, 9), kind="stable")] = np.arange(len(scores))
    return 1 / np.log2(place + 2)


def _ideal(gain: np.ndarray, at: int) -> float:
    best = np.sort(gain)[::-1][:at]
    return float((best / np.log2(np.arange(len(best)) + 2)).sum())


def ndcg(label: np.ndarray, scores: np.ndarray, at: int) -> float | None:
    """With gains 2^label - 1; none where no row is relevant."""
    gain, ideal = 2.0**label - 1, _ideal(2.0**label - 1, at)
    discount = _discounts(scores)
    return float((gain * discount)[discount >= 1 / np.log2(at + 1) - 1e-12].sum()) / ideal if ideal else None


def lambdas(label: np.ndarray, scores: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient (upwards) and weight of each row: pairs of different labels, each by the nDCG that a swap would change."""
    gain, ideal = 2.0**label - 1, _ideal(2.0**label - 1, at)
    if not ideal:
        return np.zeros(len(label)), np.zeros(len(label))
    discount = _discounts(scores)
    above = label[:, None] > label[None, :]
    swap = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / ideal
    chance = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -50, 50)))
    pull, weight = np.where(above, swap * chance, 0), np.where(above, swap * chance * (1 - chance), 0)
    return pull.sum(1) - pull.sum(0), weight.sum(1) + weight.sum(0)


def groups(rows: DataFrame, features: list[str], label: str = "label", group: str = "query_id", item: str = "doc_id", part: str = "part") -> DataFrame:
    """(query_id, part, labels, matrix), written: one row for each query, its rows in the order of their ids, missing features as NaN."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    each = rows.select(F.col(group).alias("query_id"), F.col(part).alias("part"), F.struct(F.col(item).alias("i"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), values.alias("x")).alias("r"))
    held = each.groupBy("query_id", "part").agg(F.sort_array(F.collect_list("r")).alias("r"))  # a pool at most
    return written(held.select("query_id", "part", F.col("r.y").alias("labels"), F.flatten("r.x").alias("matrix")), "ltr-groups")


def _pass(held: DataFrame, model: Model, nodes: list, score_parts: tuple[str, ...], at: int) -> list:
    """Sums (SUMS) over the training queries for each leaf of the tree in work; with score_parts, row (-1, k, 0) has the nDCG of that part's queries."""
    low, high, trees, width = np.array(model.low), np.array(model.high), list(model.trees), len(model.features)
    n_leaves = (len(nodes) + 1) if nodes else 1

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((3, n_leaves, width, BINS + 1), np.int64)
        quality = np.zeros((len(score_parts), 2), np.int64)
        for b in batches:
            for part, labels, matrix in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if part != "train" and part not in score_parts:
                    continue
                label, binned = np.array(labels), bins(np.array(matrix, float).reshape(-1, width), low, high)
                scores = predict(binned, trees)
                if part in score_parts and (q := ndcg(label, scores, at)) is not None:
                    quality[score_parts.index(part)] += round(q * UNIT), 1
                if part == "train":
                    gradient, weight = lambdas(label, scores, at)
                    leaf = leaves(binned, nodes)
                    for f in range(width):
                        for k, v in enumerate((np.rint(gradient * UNIT).astype(np.int64), np.rint(weight * UNIT).astype(np.int64), 1)):
                            np.add.at(total[k], (leaf, f, binned[:, f]), v)
        leaf, f, at_bin = np.nonzero(total[2])
        rows = [pa.array(np.append(a, b), kind) for a, b, kind in zip((leaf, f, at_bin, *total[:, leaf, f, at_bin]), (np.full(len(score_parts), -1), np.arange(len(score_parts)), np.zeros(len(score_parts), int), quality[:, 0], np.zeros(len(score_parts), int), quality[:, 1]), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        yield pa.record_batch(rows, names=["leaf", "feature", "bin", "gradient", "weight", "n"])

    return held.mapInArrow(run, SUMS).groupBy("leaf", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("gradient", "weight", "n")]).collect()


def _value(g: int, h: int, s: Settings) -> float:
    return g / UNIT / (h / UNIT + s.l2)


def _gain(g: int, h: int, s: Settings) -> float:
    return (g / UNIT) ** 2 / (h / UNIT + s.l2)


def _level(sums: list, n_leaves: int, width: int, s: Settings) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Best split of every leaf, and (gradient, weight, rows) of the leaves that come of them."""
    table = np.zeros((3, n_leaves, width, BINS + 1), object)
    table[:] = 0
    for r in sums:
        if r.leaf >= 0:
            table[:, r.leaf, r.feature, r.bin] = r.gradient, r.weight, r.n
    splits, children = [], []
    for leaf in range(n_leaves):
        whole = tuple(int(v) for v in table[:, leaf, 0].sum(axis=1))
        best, choice, parts = 0.0, (-1, -1), (whole, (0, 0, 0))
        for f in range(width):
            left = np.cumsum(table[:, leaf, f], axis=1)
            for b in range(BINS):
                one = tuple(int(v) for v in left[:, b])
                if one[2] < s.least_rows or whole[2] - one[2] < s.least_rows:
                    continue
                two = tuple(w - v for w, v in zip(whole, one, strict=True))
                gain = _gain(*one[:2], s) + _gain(*two[:2], s) - _gain(*whole[:2], s)
                if gain > best + 1e-12:
                    best, choice, parts = gain, (f, b), (one, two)
        splits.append(choice)
        children += parts
    return splits, children


def train(held: DataFrame, features: list[str], settings: Settings | None = None) -> Model:
    """A model of the training groups; of its rounds those up to the best nDCG of the validation groups are kept (all, without such groups)."""
    s = settings or Settings()
    spark, width = held.sparkSession, len(features)
    ship(spark)
    flat = held.filter("part = 'train'").select(F.posexplode("matrix").alias("at", "x")).filter(~F.isnan("x") & (F.abs("x") < float("inf")))
    ends = {r.f: (r.low, r.high) for r in flat.groupBy(F.pmod("at", F.lit(width)).alias("f")).agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    low, high = ([ends.get(f, (0.0, 0.0))[k] for f in range(width)] for k in (0, 1))
    model, best = Model(list(features), low, high, asdict(s)), (-1.0, 0)
    for round_ in range(s.rounds + 1):
        nodes: list[tuple[int, int]] = []
        for level in range(s.depth):
            sums = _pass(held, model, nodes, ("validation",) if level == 0 else (), s.at)
            if level == 0:
                got = next((r for r in sums if r.leaf == -1), None)
                quality = got.gradient / UNIT / got.n if got is not None and got.n else float(round_)
                model.gains.append(quality)
                if quality > best[0] + 1e-9:
                    best = quality, round_
                if round_ == s.rounds or round_ - best[1] >= s.patience:
                    model.trees = model.trees[: best[1]]
                    return model
            splits, children = _level(sums, 1 << level, width, s)
            nodes += splits
        if nodes[0][0] < 0:  # nothing to split: no further round can change anything
            model.trees = model.trees[: best[1]]
            return model
        model.trees.append((nodes, [s.rate * _value(g, h, s) for g, h, _ in children]))
    return model


def scored(rows: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """rows with the model's score of each."""
    ship(rows.sparkSession)
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in model.features])

    @F.pandas_udf("double")
    def of(x):
        import pandas as pd

        matrix = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(model.features)))
        return pd.Series(predict(bins(matrix, np.array(model.low), np.array(model.high)), model.trees))

    return rows.withColumn(name, of(values))


def rank(rows: DataFrame, model: Model, k: int, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best of each query by the model's score, equal scores by id."""
    return top_k(scored(rows, model), k, by=group, item=item)


def matrix_rows(rows: DataFrame, features: list[str], label: Column, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(query, item, label, group_size, values): features in their order, missing ones as NaN."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    return rows.select(group, item, label.alias("label"), values.alias("values")).join(sizes, group)


def save(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(model), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, features: list[str]) -> Model:
    """A saved model; one of another version, or of other features or another order, is refused."""
    got = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if got["version"] != VERSION:
        raise ValueError(f"the model is of version {got['version']}, not {VERSION}")
    if got["features"] != list(features):
        raise ValueError(f"the model's features are {got['features']}")
    got["trees"] = [([tuple(n) for n in nodes], values) for nodes, values in got["trees"]]
    return Model(**got)
