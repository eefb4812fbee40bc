"""Files of the shared folder: looked up in mounted folders and other stores, and missed when they are gone."""

import os
import pickle

import numpy as np
import pytest
from pyarrow import fs

from runlore.llm import language_model, shared_files
from runlore.llm.hash_files import HashFiles, Repeated


def local(folder):
    return folder.removeprefix("file:").replace("//", "/")


def test_hash_files(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500)
    rows = [(int(k), i) for i, k in enumerate(keys)] + [(int(keys[0]), 900)]
    found = pickle.loads(pickle.dumps(HashFiles.written(spark.createDataFrame(rows, "key bigint, value bigint"), 10)))
    at, value = found.find(np.array([5, keys[3], keys[0]]))
    assert sorted(zip(at.tolist(), value.tolist(), strict=True)) == [(1, 3), (2, 0), (2, 900)] and found.keys == 501
    empty = HashFiles.written(spark.createDataFrame([], "key bigint, value bigint"), 0)
    assert len(empty.find(keys)[0]) == 0
    os.remove(f"{local(empty.folder)}/0")
    shared_files._maps.clear()
    with pytest.raises(FileNotFoundError):
        empty.find(np.arange(100))


def test_a_file_cut_short_is_an_error(tmp_path):
    shared_files.put(str(tmp_path), "a", np.arange(10))
    (tmp_path / "a").write_bytes((tmp_path / "a").read_bytes()[:-8])
    with pytest.raises(OSError, match="whole"):
        shared_files.arrays(str(tmp_path), "a")


def test_other_stores_are_read_and_forgotten(tmp_path, monkeypatch):
    monkeypatch.setattr(shared_files, "_store", lambda folder: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), folder))
    monkeypatch.setattr(shared_files, "KEEP", 100)
    for name in "abc":
        shared_files.put(str(tmp_path), name, np.arange(10) + ord(name), np.zeros(3, np.uint8))
    assert [int(shared_files.arrays(str(tmp_path), name)[0][0]) for name in "abca"] == [97, 98, 99, 97] and len(shared_files._read) == 1


def test_repeated(spark):
    rng = np.random.default_rng(2)
    once, twice, thrice = (rng.integers(0, 1 << 64, n, np.uint64) for n in (3000, 200, 50))
    parts = [np.concatenate([once[:2000], twice, thrice]), np.concatenate([once[2000:], twice, thrice, thrice])]
    made = [r for p in parts for r in Repeated.packed(p, 5).itertuples(index=False)]
    rows = spark.createDataFrame([(int(r.shard), bytes(r.keys)) for r in made], "shard int, keys binary")
    found = Repeated.written(rows, 5)
    assert found.holds(twice).all() and found.holds(thrice).all() and found.holds(once).sum() < 3
    inside = Repeated.written(spark.createDataFrame([(int(r.shard), bytes(r.keys)) for r in Repeated.packed(thrice.repeat(2), 5).itertuples(index=False)], rows.schema), 5)
    assert inside.holds(thrice).all()
    assert not Repeated.written(rows.filter("false"), 5).holds(once).any()


@pytest.mark.parametrize("kind", ["bigrams", "words", "trigrams"])
def test_a_model_without_a_file_is_an_error(spark, docs, kind):
    model = language_model.train_language_model(docs)
    folder = local(model.folder)
    gone = [x for x in os.listdir(folder) if x.startswith(f"{kind}-")]
    if not gone:
        pytest.skip("the model has no such files")
    for name in gone:
        os.remove(f"{folder}/{name}")
    with pytest.raises(Exception, match="(?i)FileNotFound|no such file"):
        language_model.language_model_scores(docs, model).collect()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from runlore.llm import common

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
