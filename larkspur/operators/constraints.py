"""Hard constraints of requests on products, over all requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import collapse, missing
from larkspur.operators.ranking import match
from larkspur.operators.retrieval import multi_facet, price_facet, scalar_facet

# What a request may ask for; lists must be held in full, prices are inclusive bounds.
SCALARS = ("brand", "brand_normalized", "category_gender", "product_type")
LISTS = ("color", "pattern", "material", "fit", "sleeve", "neckline", "product_features", "style_attributes")
BOUNDS = ("min_discount_price", "max_discount_price")
GENDERS = ("men", "women")
ASKED = "q_"


def active(prefix: str = ASKED) -> Column:
    """Something is asked for; an empty list is something."""
    asked = F.lit(False)
    for c in (*SCALARS, *LISTS, *BOUNDS):
        asked = asked | F.col(prefix + c).isNotNull()
    return asked


def facets_hold(prefix: str = ASKED) -> Column:
    ok = F.lit(True)
    for c in SCALARS:
        ok = ok & scalar_facet(F.col(prefix + c), F.col(c))
    for c in LISTS:
        ok = ok & multi_facet(F.col(prefix + c), F.col(c))
    return ok


def satisfies(prefix: str = ASKED) -> Column:
    """All 14 constraints hold; what is not asked for always does."""
    return facets_hold(prefix) & price_facet(F.col(prefix + BOUNDS[0]), F.col(prefix + BOUNDS[1]), F.col("discount_price"))


def filter_candidates(candidates: DataFrame, requests: DataFrame, catalog: DataFrame, group: str = "query_id", item: str = "doc_id", id_col: str = "id") -> DataFrame:
    """The candidates (group, item, ...) that satisfy the constraints of their request; those of requests without any stay.

    requests has one row of each group, its constraints with the prefix q_.  A candidate that the catalog
    lacks raises where its request has constraints.
    """
    known = catalog.select(F.col(id_col).alias(item), F.lit(True).alias("_known"), *SCALARS, *LISTS, "discount_price")
    j = candidates.join(requests.select(group, *[ASKED + c for c in (*SCALARS, *LISTS, *BOUNDS)]), group, "left").join(known, item, "left")
    message = F.concat(F.lit("no metadata of candidate "), F.coalesce(F.col(item).cast("string"), F.lit("null")))
    keep = F.when(~active(), F.lit(True)).when(F.col("_known").isNull(), F.raise_error(message).cast("boolean")).otherwise(satisfies())
    return j.filter(keep).select(*candidates.columns)


def matching_features(prefix: str = ASKED, metadata: Column | None = None) -> dict[str, Column]:
    """The five matches (null where not asked for), their count and share, and constraint_match.

    The normalised brand is compared where it is asked for, else the brand.  constraint_match is null
    without constraints, and without metadata (a Boolean column, true by default) where prices are asked for.
    """
    asked = lambda c: F.col(prefix + c)
    known = F.lit(True) if metadata is None else metadata
    flags = {
        "brand_match": F.coalesce(match(asked("brand_normalized"), F.col("brand_normalized")), match(asked("brand"), F.col("brand"))),
        "color_match": F.when(asked("color").isNotNull(), multi_facet(asked("color"), F.col("color"))),
        "product_type_match": match(asked("product_type"), F.col("product_type")),
        "category_gender_match": match(asked("category_gender"), F.col("category_gender")),
        "material_match": F.when(asked("material").isNotNull(), multi_facet(asked("material"), F.col("material"))),
    }
    n = sum((F.coalesce(c.cast("long"), F.lit(0)) for c in flags.values()), F.lit(0))
    specified = sum((c.isNotNull().cast("long") for c in flags.values()), F.lit(0))
    priced = asked(BOUNDS[0]).isNotNull() | asked(BOUNDS[1]).isNotNull()
    constraint = F.when(active(prefix), F.when(known, satisfies(prefix)).when(~priced, facets_hold(prefix)))
    return {**flags, "matched_attribute_count": n, "attribute_overlap": F.try_divide(n, specified), "constraint_match": constraint}


def valid_gender(c: Column) -> Column:
    """True for men and women in any case, blanks around them left out; null stays null."""
    return F.lower(F.trim(c)).isin(*GENDERS)


def query_representation(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """Adds normalized_query, lexical_text, semantic_text (given ones, else the normalised query), usable and problem.

    problem names the first of: a blank query, a price range upside down, an unknown gender.
    """
    optional = lambda c: F.col(c) if c in queries.columns else F.lit(None).cast("string")
    normal = F.nullif(collapse(F.col(text)), F.lit(""))
    upside_down = F.col(ASKED + BOUNDS[0]) > F.col(ASKED + BOUNDS[1])
    problem = F.when(normal.isNull(), "blank_query").when(upside_down, "price_range").when(F.col(ASKED + "category_gender").isNotNull() & ~valid_gender(F.col(ASKED + "category_gender")), "category_gender")
    lexical, semantic = (F.when(missing(optional(c)), normal).otherwise(optional(c)) for c in ("lexical_text", "semantic_text"))
    return queries.withColumns({"normalized_query": normal, "lexical_text": lexical, "semantic_text": semantic, "usable": ~(missing(lexical) & missing(semantic)), "problem": problem})


