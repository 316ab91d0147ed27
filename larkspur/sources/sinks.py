"""Sinks: validated publishing with a manifest, checksums, index tables, upserts, resumable chunks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> int:
    """Sum of the rows' hashes: the same for any order and partitioning of the rows."""
    total = df.select(F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).cast("decimal(38,0)").alias("h")).agg(F.sum("h")).collect()[0][0]
    return int(total or 0)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, schema_version: str = "1", check: Callable[[DataFrame], None] | None = None) -> dict:
    """Writes to a temporary place, reads back and validates, then puts data and manifest in place; on failure what was there stays."""
    spark = df.sparkSession
    temp, old = f"{path}.tmp", f"{path}.old"
    df.write.mode("overwrite").parquet(temp)
    back = spark.read.parquet(temp)
    if [f.name for f in back.schema] != df.columns:
        raise ValueError("columns changed on the way")
    if check:
        check(back)
    manifest = {"schema_version": schema_version, "rows": back.count(), "columns": df.columns, "checksum": checksum(back)}
    fs, final = _fs(spark, path)
    jp = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(jp(old), True)
    had = fs.exists(final)
    if had and not fs.rename(final, jp(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(jp(temp), final):
        if had:
            fs.rename(jp(old), final)
        raise OSError(f"{temp} can't be moved")
    out = fs.create(jp(f"{path}.manifest.json"), True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    fs.delete(jp(old), True)
    return manifest


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win; old rows of other keys stay."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def upsert_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """inserted and updated keys, in one pass over both key columns."""
    both = new.select(key).withColumn("n", F.lit(1)).join(old.select(key).withColumn("o", F.lit(1)), key, "full_outer")
    return both.agg(F.sum((F.col("o").isNull()).cast("long")).alias("inserted"), F.sum((F.col("o").isNotNull() & F.col("n").isNotNull()).cast("long")).alias("updated"))


def update_vectors(catalog: DataFrame, vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Catalog with the vector column taken from vectors where they have the key; keys that the catalog lacks raise."""
    lost = vectors.select(key).join(catalog.select(key), key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} vectors of unknown ids")
    v = vectors.select(key, F.col(column).alias("_v"))
    kept = F.coalesce("_v", column) if column in catalog.columns else F.col("_v")
    return catalog.join(v, key, "left").withColumn(column, kept).drop("_v")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no finished chunk has: what a resumed job still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


INDEX_TABLES = ("postings", "doc_stats", "corpus_stats")


def publish_index(postings: DataFrame, doc_stats: DataFrame, corpus_stats: DataFrame, path: str) -> dict:
    """Lexical index as three published tables, postings clustered by term, and a manifest of the corpus; gives the manifest."""
    spark = postings.sparkSession
    parts = (postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), doc_stats, corpus_stats)
    manifest = {name: publish(df, f"{path}/{name}") for name, df in zip(INDEX_TABLES, parts, strict=True)}
    manifest["corpus"] = spark.read.parquet(f"{path}/corpus_stats").collect()[0].asDict()
    fs, place = _fs(spark, f"{path}/manifest.json")
    out = fs.create(place, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest


def index_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, doc_stats and corpus_stats of a published index; raises where its manifest is missing."""
    fs, place = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(place):
        raise FileNotFoundError(f"no index at {path}")
    postings, stats, corpus = (spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES)
    return postings, stats, corpus


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)
