"""Retrieval metrics, failure categories, paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.ordered import numbered, running
from larkspur.session import ship, written


def query_metrics(queries: DataFrame, ranked: DataFrame, judgments: DataFrame, ks: list[int], least_grade: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """(variant, query_id, k, n_returned, precision, recall, hit, ndcg, rr, first_rank) of every query, those without a result included.

    queries (query_id), ranked (variant, query_id, doc_id, rank), judgments (query_id, doc_id, grade).
    Precision divides by min(k, returned), 0 without results; recall is null without relevant ones; nDCG
    has linear gain over log2(rank + 1), 0 without results, else null where the ideal is 0.  counts (query_id, grade, n) says
    how many judgments of each grade a query has; with it, judgments need only hold those of the ranked documents.
    """
    if counts is None:
        counts = judgments.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    k_rows = F.explode(F.array(*map(F.lit, ks))).alias("k")
    base = queries.crossJoin(F.broadcast(ranked.select("variant").distinct())).select("variant", "query_id", k_rows)
    j = ranked.filter(F.col("rank") <= max(ks)).join(judgments, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    j = j.select("variant", "query_id", "rank", "grade")
    at = base.join(j, ["variant", "query_id"], "left")
    inside, good = F.col("rank") <= F.col("k"), F.col("grade") >= least_grade
    got = at.groupBy("variant", "query_id", "k").agg(
        F.sum(F.coalesce(inside, F.lit(False)).cast("long")).alias("n_returned"),
        F.sum(F.coalesce(inside & good, F.lit(False)).cast("long")).alias("hits"),
        F.min(F.when(good, F.col("rank"))).alias("first_rank"),
        F.coalesce(F.sum(F.when(inside, F.col("grade") / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    places = counts.filter("n > 0").select("query_id", "grade", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(max(ks))).cast("int"))))  # equal grades have equal gains
    best = places.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    ideal = best.filter(F.col("i") <= max(ks)).select("query_id", k_rows, "i", "grade").filter("i <= k").groupBy("query_id", "k").agg(F.sum(F.col("grade") / F.log2(F.col("i") + 1)).alias("idcg"))
    relevant = counts.groupBy("query_id").agg(F.sum(F.when(F.col("grade") >= least_grade, F.col("n")).otherwise(0)).alias("n_relevant"))
    m = got.join(ideal, ["query_id", "k"], "left").join(relevant, "query_id", "left")
    idcg = F.coalesce("idcg", F.lit(0.0))
    return m.select(
        "variant", "query_id", "k", "n_returned",
        F.when(F.col("n_returned") > 0, F.col("hits") / F.least("k", "n_returned")).otherwise(0.0).alias("precision"),
        F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).alias("recall"),
        (F.col("hits") > 0).cast("double").alias("hit"),
        F.when(F.col("n_returned") == 0, 0.0).when(idcg == 0, None).otherwise(F.col("dcg") / idcg).alias("ndcg"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"), "first_rank",
    )


METRICS = ["precision", "recall", "hit", "ndcg", "rr"]


def aggregate(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means over queries, nulls left out, with the number of queries that count; 0 where none does."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), F.count("recall").alias("n_eligible"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in METRICS])


def by_category(metrics: DataFrame, categories: DataFrame) -> DataFrame:
    """Overall and per category in one pass; category is null for overall."""
    return metrics.join(categories, "query_id").rollup("variant", "category").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in METRICS]).filter("variant is not null")


def long(metrics: DataFrame) -> DataFrame:
    return metrics.select("variant", "query_id", "k", F.explode(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*METRICS))).alias("metric", "value"))


def candidate_coverage(pool: DataFrame, judgments: DataFrame, least_grade: int = 2) -> DataFrame:
    """Share of each query's relevant documents that are in the pool."""
    rel = judgments.filter(F.col("grade") >= least_grade).select("query_id", "doc_id")
    return rel.join(pool.select("query_id", "doc_id").distinct().withColumn("p", F.lit(1)), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.count("p").alias("n_in_pool"), (F.count("p") / F.count(F.lit(1))).alias("coverage"))


def catalog_coverage(ranked: DataFrame, catalog: DataFrame, by: str = "variant") -> DataFrame:
    n = catalog.agg(F.count(F.lit(1)).alias("n_catalog"))
    return ranked.groupBy(by).agg(F.countDistinct("doc_id").alias("n_distinct"), F.count("doc_id").alias("n_rows")).crossJoin(F.broadcast(n)).withColumns({"coverage": F.try_divide("n_distinct", "n_catalog"), "unique_ratio": F.try_divide("n_distinct", "n_rows")})


def failure_category(rank: Column, k: int, depth: int = 10) -> Column:
    return F.when(rank.isNull(), "absent").when(rank <= k, "in_top_k").when(rank > depth, "depth_limited").otherwise("below_k")


def pattern(bm25_rank: Column, vector_rank: Column, rrf_rank: Column, low: int = 20, depth: int = 10) -> Column:
    """Labels of how a judged document was found."""
    both, none = bm25_rank.isNotNull() & vector_rank.isNotNull(), bm25_rank.isNull() & vector_rank.isNull()
    first = F.when(both, "RETRIEVED_BY_BOTH").when(none, "NOT_RETRIEVED_BY_EITHER").when(bm25_rank.isNotNull(), "BM25_ONLY").otherwise("SEMANTIC_ONLY")
    return F.array_compact(F.array(first, F.when(~none & (rrf_rank.isNull() | (rrf_rank > low)), "RETRIEVED_BUT_RRF_LOW_RANK"), F.when(~none & (F.least(bm25_rank, vector_rank) > depth), "DEPTH_LIMITED")))


def deltas(metrics: DataFrame, baseline: str, by: list[str]) -> DataFrame:
    """Each other variant against the baseline: absolute and relative change, the latter null from 0."""
    b = metrics.filter(F.col("variant") == baseline).select(*by, F.col("value").alias("base"))
    return metrics.filter(F.col("variant") != baseline).join(b, by).select("variant", *by, "value", "base", (F.col("value") - F.col("base")).alias("delta"), F.when(F.col("base") != 0, (F.col("value") - F.col("base")) / F.col("base")).alias("relative"))


# paired statistics -----------------------------------------------------------------------------


def paired(values: DataFrame, reference: str, candidate: str, keys: list[str]) -> DataFrame:
    """(keys, diff, reason): candidate less reference; a missing side excludes the pair, with the reason."""
    v = lambda name, c: values.filter(F.col("variant") == name).select(*keys, F.col("value").alias(c))
    j = v(reference, "r").join(v(candidate, "c"), keys, "full_outer")
    reason = F.when(F.col("r").isNull() & F.col("c").isNull(), "both_missing").when(F.col("r").isNull(), "reference_missing").when(F.col("c").isNull(), "candidate_missing")
    return j.select(*keys, (F.col("c") - F.col("r")).alias("diff"), reason.alias("reason"))


def paired_all(values: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """As `paired`, with the columns reference and candidate, for all pairs at once: values are grouped once and each pair read off."""
    held = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("variant", "value"))).alias("m"))  # one entry a variant
    each = held.select(*keys, "m", F.inline(F.array(*[F.struct(F.lit(r).alias("reference"), F.lit(c).alias("candidate")) for r, c in pairs])))
    r, c = F.element_at("m", F.col("reference")), F.element_at("m", F.col("candidate"))
    reason = F.when(r.isNull() & c.isNull(), "both_missing").when(r.isNull(), "reference_missing").when(c.isNull(), "candidate_missing")
    return each.select("reference", "candidate", *keys, (c - r).alias("diff"), reason.alias("reason"))


#: Resamples that a task draws at once.
BLOCK = 500


def draws(seed: int, first: int, rounds: int, n: int):
    """Numbers of 32 bits from the md5 of seed, resample and place, the same in every engine: a row for each resample from `first` on."""
    import hashlib

    import numpy as np

    out = np.empty((rounds, n), np.int64)
    for b in range(rounds):  # a row at a time: a whole list of Python's numbers takes five times as much
        out[b] = [int.from_bytes(hashlib.md5(f"{seed}|{first + b}|{i}".encode()).digest()[:4], "big") for i in range(n)]
    return out


def _resampled(diffs: DataFrame, group: list[str], rounds: int, seed: int, one) -> DataFrame:
    """(group, found): `one(differences, draws)` of each group for each block of resamples.

    A group's differences, in the order of their queries, are one row; it meets each block of draws once, in
    the task of that block, which draws for each number of queries once and serves all groups.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    ship(diffs.sparkSession)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("query_id", "diff"))), lambda x: x["diff"])
    d = diffs.filter("diff is not null").groupBy(*group).agg(rows.alias("d"))
    blocks = -(-rounds // BLOCK)
    spread = d.select(F.to_json(F.struct(*group)).alias("g"), "d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    spread = spread.repartition(blocks, "block").sortWithinPartitions("block", F.size("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, of = None, None
        for b in batches:
            names, found = b.column(0).to_pylist(), []
            for values, block in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if of != (block, len(values)):
                    of, drawn = (block, len(values)), draws(seed, block * BLOCK, min(BLOCK, rounds - block * BLOCK), len(values))
                found.append(one(np.array(values, float), drawn))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.float64()))], names=["g", "found"])

    got = spread.mapInArrow(run, "g string, found array<double>")
    back = F.from_json("g", diffs.select(*group).schema.simpleString())
    return got.select(back.alias("g"), "found").select(*[F.col(f"g.{c}").alias(c) for c in group], "found")


def _groups(group: str | list[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def bootstrap(diffs: DataFrame, group: str | list[str], resamples: int = 5000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean difference of each group of queries."""
    by = _groups(group)

    def means(values, drawn):
        return (values[drawn % len(values)].sum(1) / len(values)).round(12)

    s = _resampled(diffs, by, resamples, seed, means).groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("ms"))
    lo, hi = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1
    whole = diffs.filter("diff is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"))
    return s.join(whole, by).select(*by, "n", "mean_diff", F.col("ms")[lo].alias("low"), F.col("ms")[hi].alias("high"), (F.col("n") < 30).alias("small_sample"))


def sign_flip(diffs: DataFrame, group: str | list[str], rounds: int = 10000, seed: int = 42) -> DataFrame:
    """Two-sided p of the mean difference under random signs: (extreme + 1) / (rounds + 1)."""
    by = _groups(group)

    def extreme(values, drawn):
        means = abs((1 - 2 * (drawn % 2)) @ values) / len(values)
        return [float((means >= abs(values.sum()) / len(values) - 1e-12).sum())]

    found = _resampled(diffs, by, rounds, seed, extreme)
    return found.groupBy(*by).agg(((F.sum(F.col("found")[0]) + 1) / F.lit(rounds + 1)).alias("p"))


def comparison(values: DataFrame, pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """The whole matrix of paired comparisons: one row for each pair and each group of `by`, over their common queries.

    n, n_excluded, mean_diff (candidate less reference), low, high, small_sample, p, and adjusted: p after Benjamini-Hochberg over
    all rows.  Groups without a common query have n = 0 and nothing else.
    """
    key = ["reference", "candidate", *by]
    d = written(paired_all(values, pairs, [*by, "query_id"]), "paired")
    counts = d.groupBy(*key).agg(F.count("diff").alias("n_pairs"), F.count("reason").alias("n_excluded"))
    told = bootstrap(d, key).join(sign_flip(d, key), key).drop("n")
    rows = counts.join(told, key, "left").withColumnRenamed("n_pairs", "n")
    return benjamini_hochberg(written(rows, "comparison"))


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds adjusted: the running least, from the largest p down, of p * m / rank; null p stays null."""
    some = tests.filter(F.col(p).isNotNull())
    r = numbered(some, [F.asc(p)], "_rank", "_tests").withColumn("_own", F.least(F.lit(1.0), F.col(p) * F.col("_tests") / F.col("_rank")))
    adjusted = running(r, [F.desc("_rank")], "_own", "adjusted", "min").drop("_rank", "_tests", "_own")
    return adjusted.unionByName(tests.filter(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))
