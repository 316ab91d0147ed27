"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, dominance, hard_negatives, langid, licenses, media, neardup, packing, quality, ranked_search, token_files, toxicity, wordpieces
from larkspur.llm.common import table
from larkspur.llm.training import bounded_sample, fold


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_pcm(media.decode_media(media.store_texts(table(spark, sf_dir, "documents")))))


def labelled(spark: SparkSession, sf_dir: str, label: str, folds: int, held_out: int, rows: int, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, label, weight): a bounded sample of the documents that have the label and are not held out.

    One label for each id, the highest where they differ.  The sample, about `rows` of each label, is taken
    from the labels alone; it may then be broadcast, and no text is shuffled to find its label.
    """
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sample = bounded_sample(labels.filter(fold("doc_id", folds) != held_out), "doc_id", "label", rows, "weight")
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> quality.QualityModel:
    return quality.fit(labelled(spark, sf_dir, "quality", 4, 2, quality.FIT_ROWS, docs), rows=None)


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.ToxicityModel:
    return toxicity.fit(labelled(spark, sf_dir, "toxic", 5, 0, toxicity.FIT_ROWS, docs), rows=None, weight_col="weight")


QUALITY_LEAST, TOXIC_LEAST = 0.7, 0.5


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_LEAST).cast("int").alias("predicted"), "evidence", "neighbours", "similarity")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold("doc_id", 4) != 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents")))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.pack(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_media_columns": op4_media_columns,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_files": op10_token_files,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": licenses.oracle(),
    "op12_ranked_search": ranked_search.oracle(),
    "op13_hard_negatives": hard_negatives.oracle(),
}
