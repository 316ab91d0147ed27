"""Writes the token ids of all documents, in ascending doc_id order, to wavelet-matrix shard files and reads them back.

Documents are range-partitioned by id (the one shuffle, of compressed texts), each partition encodes its
documents and writes files of at most SHARD_TOKENS ids (or one document) to the shared folder, each under
a temporary name first and then renamed, so that a task that runs twice leaves one whole file.  Only a
manifest row per file meets in one place, to add up the starts.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows with equal
doc_id follow each other in the order of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import as_text, cut, fresh_path, rows_with_id, ship
from larkspur.llm.tokens import encoder
from larkspur.llm.wavelet import WaveletShard, encode_shard

SHARD_TOKENS = 1 << 21
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
NULL_ID = np.iinfo(np.int64).min
MANIFEST = "part long, file long, path string, n_docs long, n_tokens long, bytes long"
_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), *[(c, pa.int64()) for c in ("n_docs", "n_tokens", "bytes")]])
_READ = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def _filesystem(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def write_file(url: str, blob: bytes) -> None:
    at, path = _filesystem(url)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with at.open_output_stream(temp) as f:
        f.write(blob)
    try:
        at.move(temp, path)
    except OSError:  # an earlier run of the task has left its file, and this file system does not replace files
        if at.get_file_info(path).size != len(blob):
            raise
        at.delete_file(temp)


def read_file(url: str) -> bytes:
    at, path = _filesystem(url)
    with at.open_input_stream(path) as f:
        return f.read()


def write_token_files(docs: DataFrame, folder: str | None = None, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the files and returns their manifest (MANIFEST), itself a written table."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "token-files")
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(folder)
    at.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids of whole documents, end ids included
        lengths: list[np.ndarray] = []
        names: list[np.ndarray] = []
        tokens = file = 0

        def flush() -> pa.RecordBatch:
            nonlocal tokens, file
            url, size = f"{folder}/{part:08d}-{file:06d}.wvlt", np.concatenate(lengths)
            blob = encode_shard(np.concatenate(held), size, np.concatenate(names))
            write_file(url, blob)
            row = pa.record_batch([[part], [file], [url], [len(size)], [tokens], [len(blob)]], schema=_MANIFEST)
            held.clear(), lengths.clear(), names.clear()
            tokens, file = 0, file + 1
            return row

        for b in batches:
            flat, ends = enc.encode(as_text(b.column(1)))
            flat, ends = np.insert(flat, ends[1:], end_id), ends + np.arange(len(ends))
            ids = b.column(0).fill_null(NULL_ID).to_numpy()
            at = 0
            while at < len(ids):
                # as many further documents as the file still takes, but one at least into an empty file
                to = int(np.searchsorted(ends, ends[at] + shard_tokens - tokens, side="right")) - 1
                to = max(to, at + 1) if not tokens else max(to, at)
                if to > at:
                    held.append(flat[ends[at] : ends[to]])
                    lengths.append(np.diff(ends[at : to + 1]))
                    names.append(ids[at:to])
                    tokens += int(ends[to] - ends[at])
                    at = to
                if at < len(ids):
                    yield flush()
        if tokens:
            yield flush()

    ordered = rows_with_id(docs, id_col, text_col).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", text_col)
    return cut(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, all from the stored planes."""
    upto = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = WaveletShard(read_file(path))
                ids, ends = memoryview(shard.all_ids().astype("<u4")).cast("B"), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NULL_ID)
                yield pa.record_batch([names, pa.array(starts + base), pa.array(shard.lengths), pa.array(crc, pa.int64())], schema=_READ)

    spark = manifest.sparkSession
    ship(spark)
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
