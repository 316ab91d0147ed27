"""Content similarity of seed and candidate, the 25 recommendation features and their weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.vector import dot
from larkspur.operators.constraints import LISTS, SCALARS
from larkspur.operators.ranking import discount_amount
from larkspur.operators.recommend import jaccard, scalar_similarity

# The weights of the recommendation score.  Raw BM25 is not normalised.
WEIGHTS = {
    "semantic_similarity": 0.20, "lexical_similarity": 0.10, "retrieved_by_multiple_sources": 0.05, "retrieved_by_vector": 0.03,
    "retrieved_by_attribute": 0.03, "retrieved_by_bm25": 0.03, "brand_match": 0.12, "brand_normalized_match": 0.03,
    "category_gender_match": 0.08, "product_type_match": 0.10, "color_overlap": 0.08, "pattern_overlap": 0.03, "material_overlap": 0.04,
    "fit_overlap": 0.03, "sleeve_overlap": 0.02, "neckline_overlap": 0.02, "product_features_overlap": 0.03, "style_attributes_overlap": 0.03,
}
# The order of the columns of the feature matrix.
FEATURES = (
    "retrieved_by_vector", "retrieved_by_attribute", "retrieved_by_bm25", "retrieved_by_multiple_sources", "source_count", "candidate_generation_score",
    "semantic_similarity", "lexical_similarity", "brand_match", "brand_normalized_match", "category_gender_match", "product_type_match", "color_overlap",
    "pattern_overlap", "material_overlap", "fit_overlap", "sleeve_overlap", "neckline_overlap", "product_features_overlap", "style_attributes_overlap",
    "discount_price", "original_price", "discount_amount", "discount_price_delta_from_seed", "original_price_delta_from_seed",
)


def structured(seed: str = "s_") -> dict[str, Column]:
    """Four scalar and eight set similarities of a candidate with its seed (columns with the prefix)."""
    scalars = {f"{c}_match": scalar_similarity(F.col(seed + c), F.col(c)) for c in SCALARS}
    return scalars | {f"{c}_overlap": jaccard(F.col(seed + c), F.col(c)) for c in LISTS}


def generation(sources: str = "sources", score: str = "score") -> dict[str, Column]:
    """Where a merged candidate comes from (sources: an array)."""
    by = {f"retrieved_by_{s}": F.array_contains(sources, s).cast("double") for s in ("vector", "attribute", "bm25")}
    return by | {"retrieved_by_multiple_sources": (F.size(sources) > 1).cast("double"), "source_count": F.size(sources).cast("double"), "candidate_generation_score": F.col(score)}


def catalog_context(seed: str = "s_") -> dict[str, Column]:
    """Prices, discount and their differences from the seed's."""
    delta = lambda c: (F.col(c) - F.col(seed + c)).cast("double")
    return {
        "discount_amount": discount_amount(F.col("original_price"), F.col("discount_price")).cast("double"),
        "discount_price_delta_from_seed": delta("discount_price"), "original_price_delta_from_seed": delta("original_price"),
    }


def features(pairs: DataFrame, catalog: DataFrame, vectors: DataFrame, lexical: DataFrame) -> DataFrame:
    """(seed, doc_id, FEATURES) of merged candidates (seed, doc_id, sources, score).

    catalog (id, SCALARS, LISTS, prices), vectors (id, v) and lexical (seed, doc_id, score) are joined by key, for
    the seed and for the candidate; a pair without vectors has no semantic similarity, one without shared terms
    a lexical similarity of 0.
    """
    columns = [*SCALARS, *LISTS, "discount_price", "original_price"]
    mine = catalog.select(F.col("id").alias("doc_id"), *columns)
    theirs = catalog.select(F.col("id").alias("seed"), *[F.col(c).alias(f"s_{c}") for c in columns])
    # the sides grow with the catalog: merged, never broadcast, however well their files compress
    j = pairs.join(mine.hint("merge"), "doc_id").join(theirs.hint("merge"), "seed")
    j = j.join(vectors.select(F.col("id").alias("doc_id"), "v").hint("merge"), "doc_id", "left").join(vectors.select(F.col("id").alias("seed"), F.col("v").alias("sv")).hint("merge"), "seed", "left")
    j = j.join(lexical.select("seed", "doc_id", F.col("score").alias("bm25")).hint("merge"), ["seed", "doc_id"], "left")
    near = {"semantic_similarity": F.when(F.col("v").isNotNull() & F.col("sv").isNotNull(), dot(F.col("sv"), F.col("v"))), "lexical_similarity": F.coalesce("bm25", F.lit(0.0))}
    return j.withColumns(generation() | near | structured() | catalog_context()).select("seed", "doc_id", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def matrix(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> Column:
    """The features in their order as an array, missing ones NaN."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names])
