"""The resumable embedding writer: failures, resumption, refusals, merge."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from larkspur.streaming import embeddings as M

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this file
SCHEMA = "id long, text string"
CONFIG = {"model": "letters", "size": 3}


def letters(texts):
    return np.array([[len(t), t.count("a"), 1] for t in texts])


def _source(spark, folder, n=4, first=0):
    for k in range(first, first + n):
        rows = [(10 * k + j, None if j == 3 else "a" * j + "b") for j in range(5)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _write(spark, tmp, encode=letters, config=CONFIG):
    return M.write_embeddings(spark, f"{tmp}/in", SCHEMA, f"{tmp}/out", encode, config, batch=2)


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    _source(spark, f"{tmp_path}/in")

    def breaking(texts, tmp=str(tmp_path)):
        import os

        done = len([f for f in os.listdir(f"{tmp}/out/manifest") if f.endswith(".json") and not f.startswith(".")]) if os.path.isdir(f"{tmp}/out/manifest") else 0
        if done >= 2:
            raise RuntimeError("the encoder broke")
        return letters(texts)

    with pytest.raises(Exception, match="encoder broke"):
        _write(spark, tmp_path, breaking)
    before = M.manifests(spark, f"{tmp_path}/out")
    assert [m["chunk"] for m in before] == [0, 1]

    def only_the_rest(texts, tmp=str(tmp_path)):
        with open(f"{tmp}/encoded.txt", "a") as f:
            f.write("x" * len(texts))
        return letters(texts)

    after = _write(spark, tmp_path, only_the_rest)
    assert after[:2] == before and [m["rows"] for m in after] == [5] * 4
    assert len((tmp_path / "encoded.txt").read_text()) == 10  # of 20 texts, those of the two chunks that were missing
    made = M.merge(spark, f"{tmp_path}/out", f"{tmp_path}/all", spark.read.parquet(f"{tmp_path}/in").select("id"))
    rows = spark.read.parquet(f"{tmp_path}/all")
    assert made["rows"] == 20 and made["chunks"] == 4 and rows.count() == rows.select("id").distinct().count() == 20
    want = {10 * k + j: [float(x) for x in letters(["" if j == 3 else "a" * j + "b"])[0]] for k in range(4) for j in range(5)}
    assert {r.id: list(r.v) for r in rows.collect()} == want


def test_a_noted_chunk_is_not_encoded_again(spark, tmp_path):
    """The stream's own commit is lost, the chunk's manifest is not."""
    import shutil

    _source(spark, f"{tmp_path}/in", 2)
    first = _write(spark, tmp_path)
    shutil.rmtree(tmp_path / "out" / "checkpoint" / "commits")

    def refuse(texts):
        raise RuntimeError("encoded again")

    assert _write(spark, tmp_path, refuse) == first


def test_new_files_are_further_chunks(spark, tmp_path):
    _source(spark, f"{tmp_path}/in", 2)
    first = _write(spark, tmp_path)
    _source(spark, f"{tmp_path}/in", 1, 2)
    assert _write(spark, tmp_path)[:2] == first and len(M.manifests(spark, f"{tmp_path}/out")) == 3
    assert _write(spark, tmp_path) == M.manifests(spark, f"{tmp_path}/out")


def test_another_configuration_is_refused(spark, tmp_path):
    _source(spark, f"{tmp_path}/in", 1)
    _write(spark, tmp_path)
    with pytest.raises(ValueError, match="model 'letters', not 'words'"):
        _write(spark, tmp_path, config={"model": "words", "size": 3})


@pytest.mark.parametrize("bad", [lambda t: np.ones((len(t), 2)), lambda t: np.full((len(t), 3), np.nan)])
def test_bad_vectors_are_refused(spark, tmp_path, bad):
    _source(spark, f"{tmp_path}/in", 1)
    with pytest.raises(Exception, match="can't be taken"):
        _write(spark, tmp_path, bad)
    assert M.manifests(spark, f"{tmp_path}/out") == []


def test_a_merge_refuses_what_is_not_whole(spark, tmp_path):
    _source(spark, f"{tmp_path}/in", 3)
    _write(spark, tmp_path)
    out = f"{tmp_path}/out"
    with pytest.raises(ValueError, match="1 ids without a vector"):
        M.merge(spark, out, f"{tmp_path}/all", spark.range(30).filter("id % 10 < 5").union(spark.range(77, 78)))
    chunk = spark.read.schema(M.SCHEMA).parquet(f"{out}/chunks/chunk=0").collect()
    spark.createDataFrame(chunk[:4], M.SCHEMA).write.mode("overwrite").parquet(f"{out}/chunks/chunk=0")
    with pytest.raises(ValueError, match="changed"):
        M.merge(spark, out, f"{tmp_path}/all")
    (tmp_path / "out" / "manifest" / "1.json").unlink()
    with pytest.raises(ValueError, match="not all"):
        M.merge(spark, out, f"{tmp_path}/all")


def test_an_id_in_two_chunks_is_refused(spark, tmp_path):
    _source(spark, f"{tmp_path}/in", 1)
    _source(spark, f"{tmp_path}/in", 1)
    _write(spark, tmp_path)
    with pytest.raises(ValueError, match="repeated_ids"):
        M.merge(spark, f"{tmp_path}/out", f"{tmp_path}/all")
