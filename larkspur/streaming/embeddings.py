"""Embedding writer: texts to vectors in chunks, resumed after a failure, merged in the order of their ids.

A run takes what lies in the source folder, some files a chunk (Structured Streaming, availableNow, with its own checkpoint).
A chunk is encoded in Arrow batches by the tasks, written under its number, read back and checked, and then
noted in a manifest of its own; it is the same files after a restart, so a chunk that was cut off is written
anew and one that is noted is not encoded again.  The configuration lies beside the chunks: a run with
another one is refused, as is a merge of chunks of several.

Defined results: a null text is encoded as an empty one; a null or repeated id, and a vector of another size or with a non-finite or
missing component, raise and leave the chunk unfinished; an empty source gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.vector import vector_problem
from larkspur.session import ship
from larkspur.sources.sinks import _fs, checksum, publish
from larkspur.streaming.events import run_available

SCHEMA = "id long, v array<float>"


def config_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def _put(spark: SparkSession, path: str, value: dict) -> None:
    fs, place = _fs(spark, path)
    out = fs.create(place, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> dict | None:
    fs, place = _fs(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(place) else None


def claim(spark: SparkSession, out: str, config: dict) -> str:
    """Notes the configuration of a new output, or compares it with that of a begun one; gives its digest."""
    begun = _get(spark, f"{out}/config.json")
    if begun is None:
        _put(spark, f"{out}/config.json", config)
    elif begun != config:
        other = sorted(k for k in {*begun, *config} if begun.get(k) != config.get(k))
        raise ValueError(f"{out} was begun with another configuration: {', '.join(f'{k} {begun.get(k)!r}, not {config.get(k)!r}' for k in other)}")
    return config_digest(config)


def encoded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], id_col: str, text_col: str, batch: int) -> DataFrame:
    """(id, v): the texts' vectors, `batch` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                vectors = np.asarray(encode([t or "" for t in some.column(1).to_pylist()]), np.float32)
                yield pa.record_batch([some.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["id", "v"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def _checked(rows: DataFrame, size: int) -> int:
    """The number of rows; what is wrong with any raises."""
    problem = F.coalesce(F.when(F.col("id").isNull(), F.lit("no_id")), vector_problem(F.col("v"), size))
    found = {r.p: r.n for r in rows.groupBy(F.when(problem != "zero", problem).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = rows.agg(F.countDistinct("id")).first()[0]
    n = found.pop(None, 0)
    if found or ids != n:
        raise ValueError(f"vectors can't be taken: {found or {'repeated_ids': n - ids}}")
    return n


def write_embeddings(spark: SparkSession, source: str, schema, out: str, encode: Callable[[list[str]], np.ndarray], config: dict, id_col: str = "id", text_col: str = "text", files_per_chunk: int = 1, batch: int = 256) -> list[dict]:
    """Encodes what `out` lacks of the Parquet files in `source`; gives the manifests of all chunks.

    config describes the encoder, with `size`, the number of components; anything that changes vectors belongs into it.
    """
    ship(spark)
    digest = claim(spark, out, config)

    def chunk(df: DataFrame, n: int) -> None:
        if _get(spark, f"{out}/manifest/{n}.json"):
            return  # finished by a run that ended before it could say so
        place = f"{out}/chunks/chunk={n}"
        encoded(df, encode, id_col, text_col, batch).write.mode("overwrite").option("compression", "zstd").parquet(place)
        back = spark.read.schema(SCHEMA).parquet(place)
        _put(spark, f"{out}/manifest/{n}.json", {"chunk": n, "rows": _checked(back, config["size"]), "checksum": checksum(back), "config": digest})

    texts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(source)
    run_available(texts, f"{out}/checkpoint", chunk)
    return manifests(spark, out)


def manifests(spark: SparkSession, out: str) -> list[dict]:
    """The finished chunks' manifests (a small file each), by number."""
    fs, place = _fs(spark, f"{out}/manifest")
    if not fs.exists(place):
        return []
    return sorted((json.loads(r[0]) for r in spark.read.text(f"{out}/manifest/*.json", wholetext=True).collect()), key=lambda m: m["chunk"])


def merge(spark: SparkSession, out: str, target: str, expected: DataFrame | None = None) -> dict:
    """Publishes all chunks as one table in the order of ids; gives its manifest.

    Refused: chunks missing in between or of another configuration, rows that changed since their chunk was noted,
    ids in several chunks, and, where `expected` (id) is given, ids without a vector or vectors without an id.
    """
    held, config = manifests(spark, out), _get(spark, f"{out}/config.json")
    if [m["chunk"] for m in held] != list(range(len(held))):
        raise ValueError(f"chunks {[m['chunk'] for m in held]} are not all")
    if any(m["config"] != config_digest(config) for m in held):
        raise ValueError("chunks of several configurations")
    rows = spark.read.schema(SCHEMA).parquet(*[f"{out}/chunks/chunk={m['chunk']}" for m in held]) if held else spark.createDataFrame([], SCHEMA)
    if sum(m["checksum"] for m in held) != checksum(rows):
        raise ValueError("rows have changed since their chunks were noted")
    if expected is not None:
        ids = expected.select(F.col(expected.columns[0]).cast("long").alias("id"))
        lost, extra = ids.join(rows, "id", "left_anti").count(), rows.join(ids, "id", "left_anti").count()
        if lost or extra:
            raise ValueError(f"{lost} ids without a vector, {extra} vectors without an id")
    return publish(rows.repartitionByRange("id").sortWithinPartitions("id"), target, check=lambda back: _checked(back, config["size"])) | {"chunks": len(held), "config": config_digest(config)}
