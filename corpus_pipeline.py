"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents, with the
columns that they came with.  The models of the first two stages are fitted on the labelled rows of the
documents that the stage gets; the rest of every stage sees all of them.

Defined results, for every stage: a null text counts as empty; ids may be null or shared, since stages
decide for rows and never for ids (near duplicates: rows that are the same in every column are one row);
very long texts are processed whole; an empty table gives no rows; extra columns, whatever their names,
are kept as they are and never used, but for `doc_id` and `text`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, neardup, packing, quality, toxicity
from larkspur.llm.common import cut, fresh_path, release, ship, table
from larkspur.llm.queries import TOXIC_LEAST, quality_model, toxicity_model

#: A document goes if its calibrated quality is below this.
QUALITY_LEAST = 0.5


#: Texts that are judged at once, which bounds a task's memory.
TEXTS = 256


def _kept(docs: DataFrame, column: str, mask: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows whose text (null: empty) passes; mask makes, once per task, a function of texts."""
    at = docs.columns.index(column)  # by place: other columns may have any names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the worker's earlier tasks have left
        passes = mask()
        for b in batches:
            for start in range(0, b.num_rows, TEXTS):
                some = b.slice(start, TEXTS)
                yield some.filter(pa.array(passes([t or "" for t in some.column(at).to_pylist()]), pa.bool_()))
        del passes
        release()

    return docs.mapInArrow(run, docs.schema)


#: Keys of this many rows are joined by broadcast (16 MB of them); more are shuffled.
BROADCAST_KEYS = 1_000_000


def _key(docs: DataFrame, *columns: str) -> Column:
    """A hash of the named columns of a row, nulls told from each other."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """docs with a key of its own name, and that name."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, _key(docs, *columns)), name


def _small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it is small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below op6's threshold stay.

    Without labelled rows the score is 0 and every row stays; an empty text has the share of toxic rows among
    labelled texts without terms.  Ties, repeated rows and rows without an id are scored each by its own text.
    """
    ship(spark)
    held = spark.sparkContext.broadcast(toxicity_model(spark, sf_dir, docs))
    return _kept(docs, "text", lambda: lambda texts, score=toxicity.scorer(held.value): np.array([s[0] < TOXIC_LEAST for s in score(texts)], bool))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose calibrated quality is QUALITY_LEAST at least stay.

    Without labelled rows the score is 0.5 and every row stays.  Ties, repeated rows and rows without an id
    are scored each by its own text.
    """
    ship(spark)
    model = quality_model(spark, sf_dir, docs)
    return _kept(docs, "text", lambda: lambda texts: quality.scores(model, texts) >= QUALITY_LEAST)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays: that of the smallest doc_id (none is the largest), ties by a hash of the row.

    Rows that are equal in every column count as one.  Rows that share an id but no near-duplicate text all
    stay; texts without words are no duplicates of anything but of rows equal to them.
    """
    ship(spark)
    rows, key = _keyed(docs, *docs.columns)
    found = neardup.near_duplicates(rows, id_col=key).select(F.col("doc_id").alias("k"), F.col("component_id").alias("c")).distinct()
    ids = rows.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("i")).distinct()
    first = found.join(ids, "k").groupBy("c").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "k")).alias("first")).select(F.col("first.k").alias(key))
    return rows.join(cut(first, "pipeline-first"), key, "left_semi").dropDuplicates([key]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their ids; equal texts share their fate.  Without items every row stays."""
    ship(spark)
    rows, key = _keyed(docs, "text")
    found = decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    return rows.join(_small(cut(found.select(F.col("doc_id").alias(key)).distinct(), "pipeline-found")), key, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows (packing.SCHEMA): each row is a document of its own, an empty or null text its end id alone."""
    ship(spark)
    return packing.pack(docs, keep_encoder=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
