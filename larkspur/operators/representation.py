"""Texts of a product: labelled, lexical and semantic, and the combined view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import clean, collapse, machine_token, multi_values, rendered

# Labels in their order, with the column each one shows.
LABELS = [("Brand", "brand"), ("Category", "category_gender"), ("Product type", "product_type"), ("Color", "color_normalized"), ("Fit", "fit"), ("Pattern", "pattern"), ("Sleeve", "sleeve"), ("Neckline", "neckline"), ("Material", "material"), ("Features", "product_features"), ("Style", "style_attributes")]
MULTI = ("pattern", "material", "product_features", "style_attributes")


def represent(df: DataFrame) -> DataFrame:
    """Cleaned scalars, multi-valued cells as arrays; missing is null throughout."""
    cols = {c: multi_values(F.col(c)) if c in MULTI else clean(F.col(c)) for _, c in LABELS if c in df.columns}
    return df.withColumns(cols)


def _shown(c: str, joined: bool) -> Column:
    if c in MULTI:
        return F.array_join(F.transform(F.col(c), lambda m: machine_token(m)), ", ") if joined else F.array_join(c, ",")
    return rendered(F.col(c)) if joined else F.col(c)


def product_text(df: DataFrame) -> Column:
    """`Label: value` clauses, missing ones left out, with a full stop at the end; null without any."""
    t = F.concat_ws(". ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), _shown(c, True))) for label, c in LABELS if c in df.columns])
    return F.when(t != "", F.concat(t, F.lit(".")))


def structured_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[_shown(c, False) for _, c in LABELS if c in df.columns])


def lexical_text(df: DataFrame, description: str = "description") -> Column:
    return F.concat_ws(" ", F.nullif(structured_text(df), F.lit("")), F.nullif(collapse(F.col(description)), F.lit("")))


def semantic_text(df: DataFrame, description: str = "description") -> Column:
    return F.concat_ws(" ", product_text(df), F.when(clean(F.col(description)).isNotNull(), F.concat(F.lit("Description: "), collapse(F.col(description)))))


def query_embedding_text(query: Column) -> Column:
    # Fixed value: the instruction that the embedding model expects before a query.
    return F.concat(F.lit("Represent this sentence for searching relevant passages: "), query)


def bundle(df: DataFrame) -> DataFrame:
    r = represent(df)
    return r.withColumns({"product_text": product_text(r), "lexical_text": lexical_text(r), "semantic_text": semantic_text(r)})
