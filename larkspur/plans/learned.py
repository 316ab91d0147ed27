"""Learned ranking over the fused search lists: matrix, training on the split of the queries, ranking of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import ltr
from larkspur.operators import ranking as K
from larkspur.plans import evaluation as E
from larkspur.plans import recommendation as R
from larkspur.session import written

FEATURES = ["bm25_score", "bm25_rank", "vector_score", "vector_rank", "rrf_score", "in_both", "gender_match", "brand_match", "matched_count", "matched_share"]


def _judged(spark, sf_dir) -> DataFrame:
    """The normalised features of every pool row with its grade, 0 where it was not judged."""
    pool = written(R._normalized(spark, sf_dir), "normalized-pool")
    grades = E.judgments_of(spark, sf_dir, pool).select("query_id", "doc_id", F.col("grade").alias("label"))
    return pool.join(grades, ["query_id", "doc_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))


def ltr_matrix(spark, sf_dir):
    m = ltr.matrix_rows(_judged(spark, sf_dir), FEATURES, F.col("label"))
    cells = [F.round(F.nanvl(F.col("values")[k], F.lit(None).cast("double")), 6).alias(c) for k, c in enumerate(FEATURES)]
    return m.select("query_id", "doc_id", "label", "group_size", *cells, F.size(F.filter("values", lambda x: F.isnan(x))).cast("long").alias("n_missing"))


def trained(spark, sf_dir, settings: ltr.Settings | None = None) -> tuple[ltr.Model, DataFrame]:
    """A model of the training queries, and the judged rows with their part."""
    rows = _judged(spark, sf_dir)
    parts = K.split_groups(rows.select("query_id").distinct(), "query_id")
    rows = written(rows.join(parts.withColumnRenamed("id", "query_id"), "query_id"), "ltr-rows")
    return ltr.train(ltr.groups(rows, FEATURES), FEATURES, settings), rows


def ltr_rank(spark, sf_dir):
    model, rows = trained(spark, sf_dir)
    r = ltr.rank(rows, model, 10)
    return r.select("query_id", "doc_id", "part", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (ltr_matrix, ltr_rank)}
ORACLE_SQL = {
    "ltr_matrix": f"WITH {R.SNORM}, q AS (SELECT vec_id // 20 AS query_id, vec_id AS own, label FROM embeddings WHERE vec_id % 20 = 0), j AS (SELECT query_id, vec_id AS doc_id, vec_id % 3 + 1 AS grade FROM embeddings JOIN q USING (label) WHERE vec_id <> own) SELECT query_id, doc_id, coalesce(grade, 0)::BIGINT AS label, count(*) OVER (PARTITION BY query_id) AS group_size, "
    + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in FEATURES)
    + ", CAST(" + " + ".join(f"({c} IS NULL)::INT" for c in FEATURES) + " AS BIGINT) AS n_missing FROM nm LEFT JOIN j USING (query_id, doc_id)",
}
