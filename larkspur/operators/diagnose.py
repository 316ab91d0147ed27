"""Diagnostics of ranked lists against judgments and caps, over all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Depths at which a relevant item is looked for.
DEPTHS = (1, 5, 10, 20, 50)


def running_count(df: DataFrame, group: str, key: str, order: str) -> Column:
    """How often the row's key has occurred in its group up to the row."""
    return F.count(F.lit(1)).over(Window.partitionBy(group, key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def first_seen(df: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """The first row of each item of a group; order becomes its place among what is left."""
    one = df.withColumn("_n", F.row_number().over(Window.partitionBy(group, item).orderBy(order))).filter("_n = 1").drop("_n")
    return one.withColumn(order, F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long"))


def tie_order(df: DataFrame, group: str, rank: str, score: str, item: str) -> DataFrame:
    """(group, n_misplaced): neighbours by rank whose scores rise, or whose equal scores stand with falling items."""
    w = Window.partitionBy(group).orderBy(rank)
    s, i = F.lag(score).over(w), F.lag(item).over(w)
    bad = F.coalesce((s < F.col(score)) | ((s == F.col(score)) & (i > F.col(item))), F.lit(False))
    return df.select(group, bad.alias("bad")).groupBy(group).agg(F.sum(F.col("bad").cast("long")).alias("n_misplaced"))


def violations(df: DataFrame, caps: dict[str, int], group: str = "seed", item: str = "doc_id", order: str = "rank") -> DataFrame:
    """Per group: whether the group itself is among its items, repeated items, and for each key how many rows exceed its cap (no key: no cap)."""
    over = {f"_{k}": F.when(F.col(k).isNotNull(), running_count(df, group, k, order) > cap) for k, cap in caps.items()}
    n = df.withColumns({"_again": running_count(df, group, item, order) > 1, **over})
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return n.groupBy(group).agg(F.max(F.col(item) == F.col(group)).alias("leakage"), count(F.col("_again")).alias("duplicates"), *[count(F.col(f"_{k}")).alias(f"{k}_violations") for k in caps])


def depth_flags(rank: Column, top_k: int) -> dict[str, Column]:
    """Whether a rank (null: not retrieved) lies within each depth, none deeper than top_k."""
    return {f"within_{k}": F.coalesce(rank <= min(k, top_k), F.lit(False)) for k in DEPTHS}


def rank_delta(a: DataFrame, b: DataFrame, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(group, item, rank_a, rank_b, delta): positive where b ranks the item better; null where one lacks it."""
    x, y = a.select(group, item, F.col("rank").alias("rank_a")), b.select(group, item, F.col("rank").alias("rank_b"))
    return x.join(y, [group, item], "full_outer").withColumn("delta", F.col("rank_a") - F.col("rank_b"))


def review_flag(pattern: Column, rrf_rank: Column, deepest: int = 20) -> Column:
    """A judged item whose text should be looked at: missed by both lists, or fused below `deepest`, or not at all."""
    return (pattern == "both_miss") | rrf_rank.isNull() | (rrf_rank > deepest)


def ranking_tags(judged: DataFrame, pool: DataFrame, ranked: DataFrame, top_k: int, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(group, tag, n_items) of groups with judged relevant items (group, item): not in the pool, in the pool but below top_k, first of the list."""
    rows = judged.select(group, item).distinct()
    rows = rows.join(pool.select(group, item, F.lit(True).alias("in_pool")).distinct(), [group, item], "left")
    rows = rows.join(ranked.filter(F.col("rank") <= top_k).groupBy(group, item).agg(F.min("rank").alias("rank")), [group, item], "left")
    tag = F.array(
        F.when(F.col("in_pool").isNull(), "relevant_not_in_candidate_pool"),
        F.when(F.col("in_pool") & F.col("rank").isNull(), "relevant_retrieved_but_ranked_low"),
        F.when(F.col("rank") == 1, "relevant_ranked_high"),
    )
    return rows.select(group, F.explode(F.array_compact(tag)).alias("tag")).groupBy(group, "tag").agg(F.count(F.lit(1)).alias("n_items"))


def seed_failures(seeds: DataFrame, judged: DataFrame, pool: DataFrame, ranked: DataFrame, final: DataFrame, k: int, top_k: int, rejected: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(seed, failure): what went wrong with each seed (seed).

    judged (seed, doc_id) are the relevant items; pool, ranked and final (seed, doc_id, rank) the stages; rejected
    (seed, doc_id) what a constraint took out.  Where counts (seed, n_rel) says how many relevant items a seed has,
    judged may hold those of the stages alone.
    """
    rel = judged.select("seed", "doc_id").distinct()
    has = lambda df, name: df.join(rel, ["seed", "doc_id"], "left_semi").groupBy("seed").agg(F.countDistinct("doc_id").alias(name))
    n_rel = rel.groupBy("seed").agg(F.count(F.lit(1)).alias("n_rel")) if counts is None else counts
    j = seeds.join(n_rel, "seed", "left").join(has(pool, "in_pool"), "seed", "left")
    j = j.join(has(ranked.filter(F.col("rank") <= k), "in_ranked"), "seed", "left").join(has(final.filter(F.col("rank") <= k), "in_final"), "seed", "left")
    j = j.join(final.groupBy("seed").agg(F.count(F.lit(1)).alias("n_final")), "seed", "left")
    dropped = F.lit(False)
    if rejected is not None:
        j = j.join(has(rejected, "n_rejected"), "seed", "left")
        dropped = F.coalesce(F.col("n_rejected"), F.lit(0)) > 0
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_rel", "in_pool", "in_ranked", "in_final", "n_final")}
    found = F.array(
        F.when(n["in_final"] == 0, "no_relevant_retrieved"),
        F.when((n["n_rel"] > 0) & (n["in_pool"] < n["n_rel"]), "insufficient_candidates"),
        F.when((n["in_pool"] > 0) & (n["in_ranked"] == 0), "relevant_in_candidate_pool_but_not_top_k"),
        F.when(dropped, "relevant_dropped_by_constraint"),
        F.when(~dropped & (n["in_ranked"] > 0) & (n["in_final"] == 0), "relevant_selected_before_constraints"),
        F.when(n["n_final"] < top_k, "shortfall"),
    )
    return j.select("seed", F.explode(F.array_compact(found)).alias("failure"))


def pool_ranks(pool: DataFrame, group: str = "query_id", item: str = "doc_id", order: str = "position") -> DataFrame:
    """A fixed pool as ranked lists: both ranks are the place, the score falls from the number of items to 1."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long")
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return pool.select(group, item, place.alias("bm25_rank"), place.alias("vector_rank"), (n - place + 1).cast("double").alias("score"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, n_differing): rows of two runs and how many one has and the other has not; 0 if they are the same."""
    both = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    counted = both.groupBy(*a.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counted.agg(n(F.col("_a")).alias("n_a"), n(F.col("_b")).alias("n_b"), n(F.abs(F.col("_a") - F.col("_b"))).alias("n_differing"))
