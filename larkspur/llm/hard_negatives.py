"""Hard negatives by exact integer inner products, pruned in an orthogonal (principal-component) rotation.

Every row's vector is quantised to integers and rotated by the eigenvectors of the summed second moments, so that the
leading components carry most of a product.  For an anchor and a row the product of the leading components is
accumulated in stages; what is left is at most the product of both residual norms, and SLACK covers rounding.
A pair goes as soon as no score that is still possible can be among the wanted ones; survivors are verified by
integer products, which alone decide.

Anchors are the stated queries, rows all others.  Both are dealt by a hash of the row into a grid of cells (at most
about CELL rows a side), each a task of its own; a cell gives out k rows for an anchor at most, which are merged by anchor.
The first pass finds each anchor's positives, the second the negatives between the bounds that they give.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no part; a
shorter vector counts as followed by zeros; an empty one takes part, with products 0; rows with equal vec_id are rows of their own, each with its
anchor's results where the id is an anchor's; equal scores are ordered by vec_id; an empty table gives no rows; other columns are ignored.
Scores beyond 64 bits raise an error, as do components beyond 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import cut, ship

K = 5
SCALE = 256
#: Rows of a side of a cell, at most about.
CELL = 1 << 17
#: Anchors and rows whose products are in memory at once; the first block is small, to find bounds early.
ANCHORS, FIRST, ROWS = 512, 256, 4096
#: Leading components after which a pair is looked at.
STAGES = (8, 24)
#: Relative rounding of a product of single-precision rotated vectors, for each component, with room to spare.
SLACK = 2.0**-21
#: Bounds that any score meets.
ANY = -(2**63), 2**63 - 1

VECTORS = "key long, vec_id long, label long, exact binary, rotated binary"
_VECTORS = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("exact", pa.binary()), ("rotated", pa.binary())])
FOUND = "key long, slot int, vec_id long, score long"
_FOUND = pa.schema([("key", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their integers as doubles, zeros behind shorter vectors)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0)
    row = np.repeat(np.arange(len(column)), size)
    good = column.is_valid().to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(flat)]] = False
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(column), max(width, int(size.max(initial=0)))))
    out[row, at] = np.where(np.isfinite(flat), np.floor(SCALE * flat), 0)
    if np.abs(out[good]).max(initial=0) > 2.0**62:
        raise ValueError("a component is beyond 64-bit integers")
    return good, out[good]


def _moments(rows: DataFrame) -> DataFrame:
    """Second moments (a, b, total), a <= b, summed by Spark from one matrix of each task; row (-1, -1) has the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((0, 0))
        for b in batches:
            _, x = quantised(b.column(2), len(total))
            if x.shape[1] > len(total):
                grown = np.zeros((x.shape[1],) * 2)
                grown[: len(total), : len(total)] = total
                total = grown
            n, total = n + len(x), total + x.T @ x
        a, b = np.triu_indices(len(total))
        yield pa.record_batch([np.append(a, -1), np.append(b, -1), np.append(total[a, b], float(n))], names=["a", "b", "total"])

    return rows.mapInArrow(run, "a long, b long, total double").groupBy("a", "b").agg(F.sum("total").alias("total"))


def rotation(moments: list) -> tuple[int, np.ndarray]:
    """(number of rows, orthogonal matrix whose columns are the components, leading ones first)."""
    width = max((r.b for r in moments), default=-1) + 1
    matrix, n = np.zeros((width, width)), 0
    for r in moments:
        if r.a < 0:
            n = int(r.total)
        else:
            matrix[r.a, r.b] = matrix[r.b, r.a] = r.total
    peak = np.abs(matrix).max(initial=0) or 1.0
    return n, np.linalg.eigh(matrix / peak)[1][:, ::-1]


def _vectors(rows: DataFrame, turn) -> DataFrame:
    """Rows that take part (VECTORS); key numbers them over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, key = turn.value, TaskContext.get().partitionId() << 33
        for b in batches:
            good, x = quantised(b.column(2), len(q))
            n, mask = len(x), pa.array(good)
            turned = (x @ q).astype(np.float32)
            exact = x.astype("<i4" if np.abs(x).max(initial=0) < 2**31 else "<i8")
            yield pa.record_batch([pa.array(np.arange(key, key + n)), b.column(0).filter(mask), b.column(1).filter(mask), *[pa.array([r.tobytes() for r in m], pa.binary()) for m in (exact, turned)]], schema=_VECTORS)
            key += n

    return rows.mapInArrow(run, VECTORS)


class Side:
    """Rows of a cell as arrays."""

    def __init__(self, t: pa.Table, width: int):
        self.key, self.id, self.label = (t.column(c).to_numpy() for c in ("key", "vec_id", "label"))
        raw = t.column("exact").to_pylist()
        self.exact = np.array([np.frombuffer(r, "<i4" if len(r) == 4 * width else "<i8") for r in raw]).reshape(len(raw), width).astype(np.int64)
        self.turned = np.frombuffer(b"".join(t.column("rotated").to_pylist()), np.float32).reshape(len(raw), width)
        whole = np.cumsum(np.square(self.turned[:, ::-1].astype(np.float64)), axis=1)[:, ::-1]  # of the components from one on
        self.rest = np.sqrt(np.concatenate([whole, np.zeros((len(raw), 1))], axis=1))

    def take(self, at) -> Side:
        out = object.__new__(Side)
        for name, v in vars(self).items():
            setattr(out, name, v[at])
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, one by one."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:  # exact in doubles
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    if largest < 2**63:
        return np.einsum("ij,ij->i", a, b)
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for u, v in zip(a, b, strict=True)], object).astype(np.int64)


def _pairs(a: Side, b: Side, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of `alive` whose score may lie between the anchor's bounds, by partial products and norms of what is left."""
    width = a.turned.shape[1]
    slack = SLACK * width
    stages = [*(m for m in STAGES if m < width), width]
    first = stages[0]
    part = (a.turned[:, :first] @ b.turned[:, :first].T).astype(np.float64)
    room = np.outer(a.rest[:, first], b.rest[:, first]) + slack * np.outer(a.rest[:, 0], b.rest[:, 0])
    i, j = np.nonzero(alive & (part + room >= least[:, None]) & (part - room <= most[:, None]))
    part = part[i, j]
    for at, to in pairwise(stages):
        part = part + np.einsum("ij,ij->i", a.turned[i, at:to], b.turned[j, at:to])
        room = a.rest[i, to] * b.rest[j, to] + slack * a.rest[i, 0] * b.rest[j, 0]
        keep = (part + room >= least[i]) & (part - room <= most[i])
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def best(a: Side, b: Side, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, vec_id, score): for each range (low, high) of an anchor its k best rows of the same, or of another, label.

    low and high have a row for each anchor; slot is anchor * ranges + range.
    """
    n, ranges = low.shape
    low, high = low.ravel(), high.ravel()
    slot, name, score = (np.zeros(0, np.int64) for _ in range(3))
    floor = low.copy()  # rises to the k-th best score of a slot
    most = np.where(high == ANY[1], np.inf, high).reshape(n, ranges).max(axis=1)
    at, step = 0, FIRST
    while at < len(b.key):
        some = b.take(slice(at, at + step))
        at, step = at + step, min(2 * step, ROWS)
        equal = a.label[:, None] == some.label[None, :]
        alive = equal & (a.key[:, None] != some.key[None, :]) if same else ~equal
        i, j = _pairs(a, some, alive, np.where(floor == ANY[0], -np.inf, floor).reshape(n, ranges).min(axis=1), most)
        if not len(i):
            continue
        got = products(a.exact[i], some.exact[j])
        for r in range(ranges):
            s = i * ranges + r
            keep = (got >= floor[s]) & (got <= high[s])
            slot, name, score = np.append(slot, s[keep]), np.append(name, some.id[j[keep]]), np.append(score, got[keep])
        order = np.lexsort((name, -score, slot))
        slot, name, score = slot[order], name[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        slot, name, score, place = (x[place < k] for x in (slot, name, score, place))
        full = place == k - 1
        floor[slot[full]] = np.maximum(floor[slot[full]], score[full])
    return slot, name, score


def _by_cell(anchors: DataFrame, rows: DataFrame, width: int, same: bool, k: int, sizes: tuple[int, int]) -> DataFrame:
    """FOUND of every cell of the grid."""
    down, across = sizes

    def whole(c: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)

    left = anchors.select("*", F.pmod(F.xxhash64("key"), F.lit(down)).cast("int").alias("down"), whole("across", across))
    # columns of their own: a cogroup loses those that both sides share by descent
    right = rows.select(*[F.col(c).alias(f"row_{c}") for c in rows.columns], F.pmod(F.xxhash64("key"), F.lit(across)).cast("int").alias("row_across"), whole("row_down", down))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [_FOUND.empty_table()]
        if a.num_rows and b.num_rows:
            x, y = Side(a, width), Side(b.rename_columns([c.removeprefix("row_") for c in b.column_names]), width)
            low, high = (np.array(a.column(c).to_pylist(), np.int64).reshape(len(x.key), -1) for c in ("low", "high"))
            groups = [(x.label == v, y.label == v) for v in np.unique(x.label)] if same else [(np.ones(len(x.key), bool), slice(None))]
            for mine, theirs in groups:
                other = y.take(theirs)
                for at in np.split(np.flatnonzero(mine), np.arange(ANCHORS, mine.sum(), ANCHORS)):
                    slot, name, score = best(x.take(at), other, low[at], high[at], same, k)
                    found.append(pa.table([x.key[at][slot // low.shape[1]], (slot % low.shape[1]).astype(np.int32), name, score], schema=_FOUND))
        return pa.concat_tables(found)

    return left.groupBy("down", "across").cogroup(right.groupBy("row_down", "row_across")).applyInArrow(cell, FOUND)


def hard_negatives(rows: DataFrame, anchor: Column, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", k: int = K, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which rows are anchors, an expression on vec_id and label.  For each anchor the k best other rows of
    its label are positives; for each of them the k best rows of another label with least_percent to 100
    percent of the positive's score are returned.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    n, turn = rotation(_moments(rows).collect())  # one number for each pair of components
    width = len(turn)
    vectors = cut(_vectors(rows, spark.sparkContext.broadcast(turn)), "negative-vectors")
    asked = vectors.filter(anchor)
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sizes = -(-asked.count() // CELL) or 1, max(-(-n // CELL), least)
    any_score = [F.array(F.lit(v)) for v in ANY]
    order = [F.desc("score"), F.asc("vec_id")]

    def first(found: DataFrame, *by: str) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)

    positives = first(_by_cell(asked.withColumns({"low": any_score[0], "high": any_score[1]}), vectors, width, True, k, sizes), "key")
    positives = cut(positives.select("key", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")
    # the lowest score wanted is least_percent of the positive's, rounded up; below a score of 0 there is none
    scores = F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"])
    ranges = positives.groupBy("key").agg(scores.alias("high")).withColumn("low", F.transform("high", lambda s: F.when(s < 0, F.lit(ANY[1])).otherwise(s - F.floor(s * F.lit(100 - least_percent) / 100).cast("long"))))
    found = first(_by_cell(asked.join(ranges, "key"), vectors, width, False, k, sizes), "key", "slot")
    named = positives.join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return found.join(named, ["key", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def oracle() -> str:
    return """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""
