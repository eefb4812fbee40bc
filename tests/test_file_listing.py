"""Files listed and read by tasks: what Spark's readers would list, without the driver holding names; many ranges in few tasks."""

import io
import random

import pytest
from pyspark.sql import functions as F

from runlore.operators import contracts
from runlore.sources import schemas, stores, traces

from .test_import import put


def test_listing_is_that_of_sparks_reader(spark, tmp_path):
    for name in ("run=a/x.txt", "run=a/y z.txt", "run=a/.hidden.txt", "run=b/x.txt", "run=b/_no.txt", "run=b/_a=b.txt", "run=c/e[1].txt", "run=c/empty.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"" if "empty" in name else b"abc")
    base = str(tmp_path / "in")
    for path in (base, f"{base}/*/*.txt", f"file:{base}/run=[ab]/?.txt", f"{base}/run={{a,c}}", f"{base}/run=b/x.txt", f"{base}/run=c/e\\[1\\]*"):
        reader = spark.read.format("binaryFile").load(path).select("path", "length").collect()
        empty = [(p, 0) for p in stores.empty_files(spark, path)]
        assert sorted(map(tuple, stores.listed_files(spark, path).collect())) == sorted([*map(tuple, reader), *empty]), path
    assert stores.listed_files(spark, [f"{base}/run=a", f"{base}/run=b"]).count() == 4
    for missing in (f"{base}/none", f"{base}/*/none*"):
        with pytest.raises(FileNotFoundError):
            stores.listed_files(spark, missing)


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_ranges_have_each_line_once(size):
    rng = random.Random(size)
    for _ in range(200):
        data = b"".join(rng.choice([b"\n", b"a", b"bc", b"\r\n", b"long line "]) for _ in range(rng.randrange(40)))
        want = data.split(b"\n") if data[-1:] != b"\n" else data.split(b"\n")[:-1]
        got = [x for at in range(0, len(data), size) for x in stores.lines_of(io.BytesIO(data), at, min(at + size, len(data)), rng.choice([1, 3, 1000]))]
        assert got == (want if data else [])


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    """Neither Spark's file index nor a walk of the driver's takes part, whatever the number of files."""
    path = put(tmp_path / "in", **{f"f{i}": b"{}\n" * i for i in range(20)})

    def no(*_):
        raise AssertionError("listed by the driver")

    monkeypatch.setattr(stores, "empty_files", no)
    monkeypatch.setattr(stores, "_listed_by_spark", no)
    read = traces.read_trace_files(spark, path)
    made = traces.import_files(read, spark.createDataFrame([], schemas.RUNS), keep=str(tmp_path / "kept"))
    for df in (read, traces.oversize_files(spark, path), contracts.manifest_files(spark, path), made.events, made.outcomes):
        assert not [f for f in df.inputFiles() if "/in/" in f]
    assert made.events.count() == 190 and made.outcomes.count() == 20 and contracts.manifest_files(spark, path).count() == 20


def test_what_is_kept_changes_nothing(spark, tmp_path):
    data = {f"f{i}": b'{"actor":"a"}\r\n  \nno json\n{"kind":4}\n' * i for i in range(6)}
    path, none, at = put(tmp_path / "in", **data), spark.createDataFrame([], schemas.RUNS), F.lit("2026-01-01").cast("timestamp")
    for limits in (traces.ImportLimits(), traces.ImportLimits(records=9)):
        files = traces.read_trace_files(spark, path, limits)
        frames = [traces.import_files(files, none, limits, at, keep) for keep in (None, str(tmp_path / f"kept{limits.records}"))]
        for name in ("outcomes", "runs", "events", "diagnostics"):
            a, b = ([str(r) for r in getattr(x, name).collect()] for x in frames)
            assert sorted(a) == sorted(b), name


def test_many_small_ranges_are_few_tasks(spark, tmp_path):
    path = put(tmp_path / "in", **{f"f{i}": b'{"kind":"Message"}\n' * 400 for i in range(10)})
    made = traces.import_paths(spark, path, spark.createDataFrame([], schemas.RUNS), str(tmp_path / "keep"), range_bytes=200)
    cut = spark.read.parquet(str(tmp_path / "keep" / "cut"))
    assert cut.filter("is_range").count() == 380 and len(list((tmp_path / "keep" / "cut").glob("part-*.parquet"))) <= 8
    told = made.events.groupBy("run_id").agg(F.count(F.lit(1)), F.max("sequence"), F.max("source.byte_offset")).collect()
    assert [tuple(r)[1:] for r in told] == [(400, 399, 399 * 19)]  # ten equal files are one run
