"""Shared plumbing of the corpus operators: reading tables, shipping the package, cutting lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of a cluster, once per application.

    Arrow batches are held to ARROW_ROWS rows unless the session says otherwise, since whole texts
    (some very long) travel in them.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="larkspur"), "larkspur_pkg.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, str(p.relative_to(package.parent)))
        spark.sparkContext.addPyFile(target)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of this machine only where that is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/larkspur-checkpoints"
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, compression: str = "zstd", level: int = 3) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a lost executor then redoes only what follows.  level is that of zstd."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    release()
    df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables made by cut() that nothing reads any more."""
    for df in tables:
        _drop(spark, df)


def _drop(spark: SparkSession, df: DataFrame) -> None:
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the input: sorted and merged, so that the driver never collects it to broadcast it (files compress well, rows in memory do not)."""
    return df.hint("merge")


#: A key with more than 1 in PIECES of all rows is split by split_join, which bounds the split keys too.
PIECES = 1000


def split_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, n: str, total: int) -> DataFrame:
    """rows joined with per_key on key, the rows of frequent keys spread over several tasks.

    per_key has one row of each key, with n, the number of rows that the key has in rows; total is the
    number of all rows.  A key of more than total / PIECES rows is split by a hash of the column `by`, and
    its row of per_key repeated.  There are at most PIECES such keys, whatever the input, so their table
    may be broadcast.
    """
    piece = total // PIECES + 1
    parts = F.ceil(F.col(n) / F.lit(piece)).cast("int")
    split = F.broadcast(per_key.filter(F.col(n) > piece).select(key, parts.alias("_parts")))
    salted = rows.join(split, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(sorted_side(repeated), [key, "_salt"]).drop("_salt")


def release() -> None:
    """Give back what the driver's Python no longer uses, which its allocators would otherwise keep from one stage to the next."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function made once per task (for its caches)."""

    def run(batches):
        one = make()
        for b in batches:
            out = one(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def as_text(values: pa.Array) -> list[str]:
    """Texts of an Arrow column; a null counts as empty."""
    return [v or "" for v in values.to_pylist()]


def rows_with_id(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, by their own names: extra columns, whatever their names, never meet ours."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in cols])
