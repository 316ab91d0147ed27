"""Ranking features, normalisation within a query, weighted scores, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.ordered import numbered

# Weights of the baseline score over normalised features (others weigh nothing).
BASELINE_WEIGHTS = {
    "bm25_score": 0.12, "bm25_rank": 0.08, "vector_score": 0.12, "vector_rank": 0.08, "rrf_score": 0.18, "in_both": 0.03,
    "brand_match": 0.10, "color_match": 0.06, "type_match": 0.05, "gender_match": 0.04, "material_match": 0.03, "matched_count": 0.04, "matched_share": 0.07,
}


def match(asked: Column, has: Column) -> Column:
    """True or false where asked for, null where not."""
    return F.when(asked.isNotNull(), F.coalesce(asked == has, F.lit(False)))


def matched(flags: list[str]) -> dict[str, Column]:
    """matched_count and matched_share of what is asked for; the share is null where nothing is."""
    n = sum((F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in flags), F.lit(0))
    asked = sum((F.col(c).isNotNull().cast("long") for c in flags), F.lit(0))
    return {"matched_count": n, "matched_share": F.try_divide(n, asked)}


def discount_amount(original: Column, discount: Column) -> Column:
    return F.greatest(original - discount, F.lit(0))


def minmax(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Each column to 0..1 within its group; a constant one to 0.5, null stays null; one window for all columns."""
    w = Window.partitionBy(group)
    low, high = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    scaled = {c: F.when(F.col(c).isNotNull(), F.when(high(c) == low(c), F.lit(0.5)).otherwise((F.col(c) - low(c)) / (high(c) - low(c)))) for c in cols}
    return df.withColumns(scaled)


def rank_strength(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: 1.0 / F.col(c) for c in cols})


def weighted(weights: dict[str, float], missing: float = 0.0) -> Column:
    """Sum of weight times feature, by feature name; a missing feature counts as `missing`."""
    total = F.lit(0.0)
    for c in sorted(weights):
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(missing)) * F.lit(weights[c])
    return total


def breakdown(df: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """(keys, feature, contribution) long."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(w)).alias("contribution")) for c, w in sorted(weights.items())])
    return df.select(*keys, F.inline(parts))


def split_groups(ids: DataFrame, id_col: str, seed: str = "42", train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """(id, part): every query wholly in train, validation or test, by rank of a seeded digest; at least one each of three or more."""
    digest = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    r = numbered(ids.select(id_col), [digest, F.col(id_col)], "r", "n")
    first = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    second = F.greatest(F.lit(1), F.floor(F.col("n") * validation))
    return r.select(F.col(id_col).alias("id"), F.when(F.col("r") <= first, "train").when(F.col("r") <= first + second, "validation").otherwise("test").alias("part"))


def invariants(df: DataFrame, group: str, rank: str, item: str, score: str) -> DataFrame:
    """Counts of groups with gaps in their ranks, of repeated items and of non-finite scores."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.countDistinct(rank).alias("nr"), F.countDistinct(item).alias("ni"), F.sum((F.col(score).isNull() | F.isnan(score)).cast("long")).alias("bad"))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum(((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("nr") != F.col("n"))).cast("long")).alias("rank_gaps"), F.sum((F.col("ni") != F.col("n")).cast("long")).alias("repeated_items"), F.sum("bad").alias("bad_scores"))
