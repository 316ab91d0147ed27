"""What grows with the input is never collected to be broadcast."""

from pyspark.sql import functions as F

from larkspur.llm.common import split_join
from larkspur.llm.neardup import near_duplicates


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_broadcast_no_table_of_documents(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[k % 5 : 40 + k % 5])) for k in range(40)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "BroadcastHashJoin" not in _plan(out)
    assert out.filter("kept").count() == 1


def test_split_join_broadcasts_frequent_keys_alone(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    out = split_join(rows, keys, "k", "id", "n", 3000)
    assert _plan(out).count("BroadcastHashJoin") == 1 and _plan(out).count("SortMergeJoin") == 1
    assert out.count() == 3000 and out.filter("id > top").count() == 0


def test_op4_stores_pcm_of_the_operators_rate(spark, tmp_path):
    from larkspur.llm import media, queries

    spark.createDataFrame([(1, "x" * 100), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.pcm_bytes - 44 for r in queries.op4_media_columns(spark, str(tmp_path)).collect()}
    assert got == {1: 128 * media.TARGET_RATE // media.RATE * 2, 2: 64 * media.TARGET_RATE // media.RATE * 2}


def test_pcm_is_packed_without_loss():
    import numpy as np

    from larkspur.llm import media

    rng = np.random.default_rng(4)
    wide = rng.integers(-32768, 32768, 3001).astype(np.int16)
    codes = media.EXPAND[media.MULAW][rng.integers(0, 256, 700)]
    for pcm in (wide, wide[:600], wide[:1], wide[:2], wide[:3], wide[:0], codes, np.zeros(9, np.int16), media.resample(codes, 8000, 16000), media.resample(wide, 8000, 16000)):
        assert np.array_equal(media.unpack_pcm(len(pcm), *media.pack_pcm(pcm)), pcm)
    assert sum(map(len, media.pack_pcm(media.resample(codes, 8000, 16000)))) < 2 * len(codes)


def test_op4_stores_pcm_in_less_than_its_own_bytes(spark):
    import hashlib
    from pathlib import Path
    from urllib.parse import urlparse

    from larkspur.llm import media

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1)
    stored = media.store_texts(docs)
    packed = media.store_pcm(media.decode_media(stored))
    size = lambda df: sum(Path(urlparse(f).path).stat().st_size for f in df.inputFiles())
    assert size(packed) < 1.6 * size(stored)
    want = {r.doc_id: hashlib.sha256(r.pcm).hexdigest() for r in media.decode_media(stored).collect()}
    assert {r.doc_id: r.pcm_sha256 for r in media.digests(packed).collect()} == want
    assert {r.doc_id: hashlib.sha256(r.pcm).hexdigest() for r in media.read_pcm(packed).collect()} == want
