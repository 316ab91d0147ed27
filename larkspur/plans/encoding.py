"""The embedding writer over all documents, with a stand-in encoder that SQL can repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkspur.session import fresh_path
from larkspur.streaming.embeddings import merge, write_embeddings

#: The characters that the stand-in counts, beside the length.
COUNTED = "aeiou n"


def letter_shares(texts: list[str]) -> np.ndarray:
    """Length and counts of some characters, scaled to length 1."""
    x = np.array([[len(t), *(t.count(c) for c in COUNTED)] for t in texts], float).reshape(len(texts), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def embedding_writer(spark, sf_dir):
    """Vectors of all documents, written in chunks, merged and read back."""
    out = fresh_path(spark, "embeddings")
    source = f"{sf_dir}/documents.parquet"
    # a stream takes a single file by a pattern only
    write_embeddings(spark, f"{sf_dir}/document[s].parquet", "doc_id long, text string", out, letter_shares, {"model": "letter shares", "size": len(COUNTED) + 1}, "doc_id")
    merge(spark, out, f"{out}/all", spark.read.parquet(source).select("doc_id"))
    return spark.read.parquet(f"{out}/all").select(F.col("id").alias("doc_id"), *[F.round(F.col("v")[k].cast("double"), 5).alias(f"v{k}") for k in range(len(COUNTED) + 1)])


_COUNTS = ["length(t)", *[f"length(t) - length(replace(t, '{c}', ''))" for c in COUNTED]]
QUERIES = {"embedding_writer": embedding_writer}
ORACLE_SQL = {
    "embedding_writer": "WITH x AS (SELECT doc_id, " + ", ".join(f"({c})::DOUBLE AS c{k}" for k, c in enumerate(_COUNTS)) + " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), n AS (SELECT *, greatest(sqrt(" + " + ".join(f"c{k} * c{k}" for k in range(len(_COUNTS))) + "), 1e-300) AS size FROM x) SELECT doc_id, " + ", ".join(f"round((c{k} / size)::FLOAT::DOUBLE, 5) AS v{k}" for k in range(len(_COUNTS))) + " FROM n",
}
