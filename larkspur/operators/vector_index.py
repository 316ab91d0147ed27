"""Partitioned vector index: inverted lists around centroids, probed by distance bounds, with an exact way.

Centroids come of a bounded sample (SAMPLE rows, by a hash of the id; spherical k-means with a fixed start); every row goes to
its nearest centroid.  The rows are Parquet partitioned by list, a list with its radius: the largest angle from the centroid.
No row of a list is nearer to a query than the angle to the centroid less the radius, which bounds its cosine.

A search probes the lists of each query's nearest centroids, as many as `probes_for` finds to give a wanted recall for a sample of
queries.  Exact: then all others too whose bound reaches the k-th cosine found.  Lists and the queries that probe them meet in cells of at most about CELL rows a side, so neither a large
list nor a list that many queries ask for is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.lexical import top_k
from larkspur.session import fresh_path, ship, written

SAMPLE, ROUNDS, CELL = 20_000, 10, 1 << 16
#: Lists, and lists probed first.
LISTS, PROBES = 64, 8
#: Rounding that a bound is given before it rules a list out.
SLACK = 1e-7


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def centroids(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids, at most `lists`, of a sample of about `sample` rows."""
    total = vectors.count()
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.filter(at < sample / total).select("id", "v").collect() if total else []
    x = np.array([r.v for r in sorted(rows, key=lambda r: r.id)], float)
    if not len(x):
        return np.zeros((0, 0))
    held = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ held.T).argmax(1)
        sums = np.zeros_like(held)
        np.add.at(sums, near, x)
        held = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), held)
    return held


def build(vectors: DataFrame, path: str | None = None, lists: int = LISTS, sample: int = SAMPLE) -> str:
    """Writes the index of unit vectors (id, v) and gives its folder: rows/list=n/ and lists (list, n, radius, centroid)."""
    spark = vectors.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "vector-index")
    held = centroids(vectors, lists, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cosines = _matrix(b.column(1)) @ held.T
                yield pa.record_batch([b.column(0), b.column(1), pa.array(cosines.argmax(1).astype(np.int32)), pa.array(np.arccos(np.clip(cosines.max(1), -1, 1)))], names=["id", "v", "list", "angle"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    placed = rows.mapInArrow(assign, "id long, v array<double>, list int, angle double") if len(held) else rows.limit(0).selectExpr("*", "0 AS list", "0D AS angle")
    placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    seen = spark.read.schema("id long, v array<double>, angle double, list int").parquet(f"{path}/rows")
    sizes = {r.list: r for r in seen.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}  # LISTS rows
    table = [(k, sizes[k].n, sizes[k].radius, c.tolist()) for k, c in enumerate(held) if k in sizes]
    spark.createDataFrame(table, "list int, n long, radius double, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return path


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, list]:
    """(rows, the lists' table, which has a row for each list)."""
    rows = spark.read.schema("id long, v array<double>, angle double, list int").parquet(f"{path}/rows")
    return rows, spark.read.parquet(f"{path}/lists").orderBy("list").collect()


def probes(queries: DataFrame, table: list) -> DataFrame:
    """(query_id, v, list, bound, place): every query with every list, nearest centroid first, and the bound of its cosines; LISTS small rows a query."""
    names = np.array([r.list for r in table], np.int32)
    held, radius = np.array([r.centroid for r in table]), np.array([r.radius for r in table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = np.arccos(np.clip(_matrix(b.column(1)) @ held.T, -1, 1))
                bound = np.cos(np.maximum(0, angle - radius)) + SLACK
                order = np.argsort(angle, axis=1, kind="stable")
                own = np.take_along_axis(bound, order, 1)
                ends = pa.array(np.arange(len(angle) + 1) * len(names), pa.int32())
                yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(names[order].ravel())), pa.ListArray.from_arrays(ends, pa.array(own.ravel()))], names=["query_id", "v", "lists", "bounds"])

    each = queries.select(F.col("id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "query_id long, v array<double>, lists array<int>, bounds array<double>")
    return each.select("query_id", "v", F.posexplode(F.arrays_zip("lists", "bounds")).alias("place", "p")).select("query_id", "v", F.col("p.lists").alias("list"), F.col("p.bounds").alias("bound"), "place")


def _found(asked: DataFrame, rows: DataFrame, table: list, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, doc_id, score): of each asked (query_id, v, list), k rows of every cell of the list at most."""
    spark = rows.sparkSession
    wanted = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    sizes = spark.createDataFrame([(r.list, r.n) for r in table], "list int, n long")  # a row for each list
    cells = written(sizes.join(wanted, "list").select("list", F.ceil(F.col("n") / CELL).cast("int").alias("down"), F.ceil(F.col("asked") / CELL).cast("int").alias("across")), "vector-cells")
    whole = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda name, c: F.pmod(F.xxhash64(name), F.col(c)).cast("int")
    left = asked.join(F.broadcast(cells), "list").select("list", whole("down").alias("i"), part("query_id", "across").alias("j"), "query_id", "v")
    right = rows.join(F.broadcast(cells), "list").select(F.col("list").alias("l"), part("id", "down").alias("r"), whole("across").alias("s"), F.col("id").alias("doc_id"), F.col("v").alias("w"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
        parts = [out.empty_table()]
        if a.num_rows and b.num_rows:
            x = _matrix(b.column("w").combine_chunks())
            ids, names, y = b.column("doc_id").to_numpy(), a.column("query_id").to_numpy(), _matrix(a.column("v").combine_chunks())
            for at in range(0, len(names), 512):
                cosines = y[at : at + 512] @ x.T
                if exclude_self:
                    cosines[names[at : at + 512, None] == ids[None, :]] = -2
                floor = np.partition(cosines, len(ids) - k, 1)[:, len(ids) - k] - SLACK if len(ids) > k else np.full(len(cosines), -2.0)
                q, d = np.nonzero((cosines >= floor[:, None]) & (cosines > -1.5))
                parts.append(pa.table([names[at + q], ids[d], cosines[q, d]], schema=out))
        return pa.concat_tables(parts)

    return left.groupBy("list", "i", "j").cogroup(right.groupBy("l", "r", "s")).applyInArrow(cell, "query_id long, doc_id long, score double")


def search(queries: DataFrame, path: str, k: int, first: int = PROBES, exact: bool = True, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest by cosine of unit vectors (id, v); without `exact`, of the lists probed first."""
    spark = queries.sparkSession
    ship(spark)
    rows, table = stored(spark, path)
    kind = "query_id long, doc_id long, score double"
    if not table:
        return top_k(spark.createDataFrame([], kind), k)
    every = probes(queries, table)
    found = written(_found(every.filter(F.col("place") < first), rows, table, k, exclude_self), "vector-found")
    if exact:
        floor = _floors(found, k)
        rest = every.filter(F.col("place") >= first).join(floor, "query_id", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(-2.0)))
        found = found.unionByName(_found(written(rest.select("query_id", "v", "list"), "vector-rest"), rows, table, k, exclude_self))
    return top_k(found, k)


def _floors(found: DataFrame, k: int) -> DataFrame:
    """The k-th cosine of the queries that have so many."""
    return top_k(found, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))


def probes_for(queries: DataFrame, path: str, k: int, recall: float = 0.95) -> int:
    """The fewest lists to probe first at which the given queries find that share of their k nearest."""
    rows, table = stored(queries.sparkSession, path)
    near = search(queries, path, k).join(rows.select(F.col("id").alias("doc_id"), "list"), "doc_id")
    counts = near.join(probes(queries, table).select("query_id", "list", "place"), ["query_id", "list"]).groupBy("place").count().collect()  # LISTS rows
    total, got = sum(r["count"] for r in counts), 0
    for r in sorted(counts, key=lambda r: r.place):
        got += r["count"]
        if got >= recall * total:
            return r.place + 1
    return 1


def use(queries: DataFrame, path: str, k: int, first: int = PROBES) -> DataFrame:
    """(query_id, n_lists, n_probed, n_rows, n_compared): lists and rows that an exact search of each query meets."""
    rows, table = stored(queries.sparkSession, path)
    every = probes(queries, table)
    floor = _floors(_found(every.filter(F.col("place") < first), rows, table, k, False), k)
    sizes = F.broadcast(queries.sparkSession.createDataFrame([(r.list, r.n) for r in table], "list int, n long"))
    read = (F.col("place") < first) | (F.col("bound") >= F.coalesce("floor", F.lit(-2.0)))
    met = every.join(floor, "query_id", "left").join(sizes, "list")
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_lists"), F.sum(read.cast("long")).alias("n_probed"), F.sum("n").alias("n_rows"), F.sum(F.when(read, F.col("n")).otherwise(0)).alias("n_compared"))
