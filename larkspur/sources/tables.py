"""Scans: driver tables, CSV catalogs, JSON and JSONL artifacts, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import clean

#: Columns of a raw catalog row, all read as text.
RAW_CATALOG = ["Product_URL", "Brand", "Description", "Id_Product", "URL_image", "Category_by_gender", "Discount Price (in Rs.)", "Original Price (in Rs.)", "Color"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_catalog(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "windows-1252") -> DataFrame:
    """A CSV with header, every column as text; columns that are not as declared raise."""
    names = columns or RAW_CATALOG
    if encoding.lower() not in ("iso-8859-1", "us-ascii", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # other charsets are refused without it
    found = spark.read.option("header", True).option("encoding", encoding).csv(path).columns
    if found != names:
        raise ValueError(f"expected columns {names}, found {found}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("header", True).option("encoding", encoding).option("mode", "FAILFAST").option("multiLine", True).schema(schema).csv(path)


def id_text_scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pruned (id, text) with stripped ids; rows without an id are refused by assert_ids."""
    return df.select(clean(F.col(id_col).cast("string")).alias("id"), F.col(text_col).alias("text"))


def assert_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Raises where an id is missing or repeated."""
    r = df.agg(F.sum(F.col(id_col).isNull().cast("long")), F.count(id_col) - F.countDistinct(id_col)).collect()[0]
    if r[0] or r[1]:
        raise ValueError(f"{r[0]} rows without id, {r[1]} repeated ids")
    return df


def json_artifact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON object of a file; anything else raises."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    if df.count() != 1:
        raise ValueError("a JSON object is expected")
    return df


def jsonl_by_key(spark: SparkSession, path: str, key: str = "query_id") -> DataFrame:
    """Lines that are objects; the last line of a key wins (by file and place within it)."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    keyed = lines.select("value", "at", F.get_json_object("value", f"$.{key}").alias(key)).filter(F.col("value").startswith("{") & F.col(key).isNotNull())
    return keyed.groupBy(key).agg(F.max_by("value", "at").alias("value"))


def _checked(rows: DataFrame, bad: Column, what: str) -> DataFrame:
    """The rows, none of which may be bad."""
    return rows.filter(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True)))


def benchmark_queries(df: DataFrame) -> DataFrame:
    """(query_id, query_text, query_category, product_id, grade) of a graded search benchmark; blank texts and ids and grades beyond 0 to 3 raise."""
    q = df.select(F.explode("queries").alias("q"))
    j = q.select("q.query_id", "q.query_text", "q.query_category", F.explode("q.relevance_judgments").alias("j"))
    rows = j.select("query_id", "query_text", "query_category", "j.product_id", "j.grade")
    blank = clean(F.col("query_text")).isNull() | clean(F.col("query_id").cast("string")).isNull() | clean(F.col("product_id").cast("string")).isNull()
    return _checked(rows, blank | ~F.col("grade").between(0, 3), "blank text or id, or a grade beyond 0 to 3")


def binary_to_graded(judged: DataFrame) -> DataFrame:
    """A binary list of relevant ids as judgments of grade 2."""
    return judged.select("query_id", F.explode("relevant_product_ids").alias("product_id"), F.lit(2).alias("grade"))


def recommendation_cases(df: DataFrame) -> DataFrame:
    """(seed_product_id, seed_category, product_id, grade) of a recommendation benchmark; a seed judged for itself and grades beyond 0 to 3 raise."""
    c = df.select(F.explode("cases").alias("c"))
    rows = c.select("c.seed_product_id", "c.seed_category", F.explode("c.relevance_judgments").alias("j")).select("seed_product_id", "seed_category", "j.product_id", "j.grade")
    return _checked(rows, (F.col("product_id") == F.col("seed_product_id")) | ~F.col("grade").between(0, 3), "a seed judged for itself, or a grade beyond 0 to 3")


def point_lookup(df: DataFrame, id_col: str, value) -> DataFrame:
    return df.filter(F.col(id_col) == F.lit(value))


def batch_lookup(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of the asked ids in the order asked for: ids has (pos, id); an id that df lacks raises."""
    j = ids.withColumnRenamed("id", "_id").join(df.withColumn("_known", F.lit(True)), F.col("_id") == F.col(id_col), "left")
    return _checked(j, F.col("_known").isNull(), "an asked id is missing").drop("_id", "_known").orderBy("pos")


def catalog_mode(rows: Column, prefixed: Column, full: int, fixture: int = 32) -> Column:
    """empty, full, fixture (few rows, all with the fixture's prefix) or partial."""
    return F.when(rows == 0, "empty").when(rows == full, "full").when((rows <= fixture) & (rows == prefixed), "fixture").otherwise("partial")


def demo_catalog(spark: SparkSession, size: int = 384) -> DataFrame:
    """Three fixed products with one-hot vectors."""
    rows = [(f"DEMO-{k + 1}", name, [float(j == k) for j in range(size)]) for k, name in enumerate(("navy cotton shirt", "black slim jeans", "red printed dress"))]
    return spark.createDataFrame(rows, "product_id string, description string, embedding array<float>")
