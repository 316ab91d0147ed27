"""Validation findings, profiles and deduplication of catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions.text import missing

PRICE = r"^\s*(?:\d{1,3}(?:,\d{3})*|\d+)\s*$"
URL = r"^https?://[^/?#]+"


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))


def schema_findings(found: list[str], expected: list[str]) -> list[tuple[str, str]]:
    """(rule, status): missing columns fail and end the checks; unexpected ones and another count fail."""
    lost, extra = [c for c in expected if c not in found], [c for c in found if c not in expected]
    if lost:
        return [("missing_columns", "FAIL")]
    return [("unexpected_columns", "FAIL" if extra else "PASS"), ("column_count", "PASS" if len(found) == len(expected) else "FAIL")]


def findings(df: DataFrame, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """(category, rule, status, affected) of all rules in one pass; a rule is (category, name, bad row, status if any)."""
    one = df.agg(*[count_if(c).alias(f"r{k}") for k, (_, _, c, _) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(name).alias("rule"), F.when(F.col(f"r{k}") > 0, status).otherwise("PASS").alias("status"), F.col(f"r{k}").alias("affected")) for k, (cat, name, _, status) in enumerate(rules)])
    return one.select(F.inline(rows))


def identity(df: DataFrame, id_col: str) -> DataFrame:
    """Rows, null ids, repeated ids and repeated whole rows."""
    d = df.distinct().agg(F.count(F.lit(1)).alias("d"))
    n = df.agg(F.count(F.lit(1)).alias("n_rows"), count_if(missing(F.col(id_col).cast("string"))).alias("null_ids"), (F.count(id_col) - F.countDistinct(id_col)).alias("repeated_ids"))
    return n.crossJoin(d).select("n_rows", "null_ids", "repeated_ids", (F.col("n_rows") - F.col("d")).alias("repeated_rows"))


def price(c: Column) -> Column:
    """Whole number of a text with thousands separators; null where it is none."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("long")


def value_duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct and repeated values of a key (null is a value), rows in repeated ones, the largest group."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.lit("+".join(cols)).alias("key"), F.count(F.lit(1)).alias("n_values"), count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeated"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def group_variance(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Among groups of more than one row: how many have more than one value of each column (null is a value)."""
    many = lambda c: (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) > 1).alias(c)
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[many(c) for c in cols]).filter("_n > 1")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), *[count_if(F.col(c)).alias(f"vary_{c}") for c in cols])


def largest_groups(df: DataFrame, key: str, id_col: str, groups: int = 3, examples: int = 3) -> DataFrame:
    """The largest groups (ties by key) with their first ids."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).orderBy(F.desc("n"), key).limit(groups)
    w = Window.partitionBy(key).orderBy(id_col)
    rows = df.join(F.broadcast(top), key).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= examples)
    return rows.groupBy(key, "n").agg(F.array_sort(F.collect_list(id_col)).alias("ids"))


def exact_dedup(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(distinct rows, ids that still have several rows): the second must be empty."""
    d = df.distinct()
    return d, d.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def case_variants(df: DataFrame, col: str) -> DataFrame:
    """Values that occur in more than one spelling of case."""
    return df.groupBy(F.lower(col).alias("folded")).agg(F.countDistinct(col).alias("n_variants"), F.count(F.lit(1)).alias("n_rows")).filter("n_variants > 1")


def top_values(df: DataFrame, col: str, k: int = 15) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def changed_cells(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """How many cells of each column a cleaning expression changes; a missing cell counts as changed."""
    return df.agg(*[F.sum((~F.coalesce(F.col(c) == new, F.lit(False))).cast("long")).alias(c) for c, new in cols.items()])


def issue_rows(df: DataFrame, id_col: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(id, issue): one row for each rule that a row breaks."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("issue"))


def coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of rows with a value, for each column; 0 on an empty table."""
    return df.agg(*[F.round(F.coalesce(F.avg((~missing(F.col(c).cast("string"))).cast("double")), F.lit(0.0)), 6).alias(c) for c in cols])



def representation_issues(df: DataFrame, id_col: str, lists: list[str], scalars: list[str], source: dict[str, str]) -> DataFrame:
    """(id, category, issue): seven categories of what may be wrong with product representations.

    df has scalars, lists (arrays), description, discount_price, original_price, price_anomaly, color_raw and
    color_is_coded; source names, for some scalars, the column of the raw value that they must keep.
    """
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    blank = lambda c: F.exists(c, lambda x: missing(x))
    rules = [("structural", "missing_id", missing(F.col(id_col).cast("string")))]
    rules += [("structural", f"blank_{c}", F.col(c).isNotNull() & missing(F.col(c))) for c in scalars]
    rules += [("consistency", f"repeated_{c}", repeated(F.col(c))) for c in lists] + [("consistency", f"blank_in_{c}", blank(F.col(c))) for c in lists]
    none = F.lit(True)
    for c in (*scalars, *lists):
        none = none & F.col(c).isNull()
    rules += [("degeneracy", "no_attributes", none), ("degeneracy", "empty_list", F.lit(False) if not lists else F.exists(F.array(*[F.size(c) == 0 for c in lists]), lambda x: x))]
    rules += [("preservation", f"changed_{c}", ~F.col(c).eqNullSafe(F.nullif(F.trim(raw), F.lit("")))) for c, raw in source.items()]
    rules += [("description", "missing_description", missing(F.col("description"))), ("description", "short_description", F.length(F.trim("description")) < 3)]
    low, high = F.col("discount_price"), F.col("original_price")
    rules += [("price", "missing_price", low.isNull() | high.isNull()), ("price", "negative_price", (low < 0) | (high < 0)), ("price", "unmarked_anomaly", (low > high) & ~F.coalesce("price_anomaly", F.lit(False)))]
    rules += [("color", "coded_with_names", F.col("color_is_coded") & F.col("color").isNotNull()), ("color", "raw_without_color", ~F.col("color_is_coded") & ~missing(F.col("color_raw")) & F.col("color").isNull())]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("category"), F.lit(n).alias("issue"))) for k, n, c in rules]))
    return df.select(F.col(id_col).alias("id"), F.inline(found))
