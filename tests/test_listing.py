"""Light-curve folders listed and read by the workers: the driver holds no list of the files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxfold.session import many_small_files, ship_package
from fluxfold.sources import convert
from fluxfold.sources.convert import ConversionError, compacted, convert_files, converted, target_files
from fluxfold.sources.fits import encode_file
from fluxfold.sources.listing import list_files, read_files, worker_uris

COLUMNS = ("TIME", "PDCSAP_FLUX", "MOM_CENTR1", "MOM_CENTR2")


def curve(target, quarter):
    values = {c: np.arange(3) + 10.0 * quarter + i for i, c in enumerate(COLUMNS)}
    return encode_file("LIGHTCURVE", values, {"KEPLERID": target, "QUARTER": quarter})


@pytest.fixture
def tree(spark, tmp_path):
    """Files in folders of three levels, with names that Spark's reader passes over or quotes."""
    ship_package(spark)
    top = tmp_path / "in put%"
    for folder in (".", "0000", "0000/a", "_hidden", ".git", "_k=1", "x.fits"):
        (top / folder).mkdir(parents=True, exist_ok=True)
        for name in ("kplr000000012-1_llc.fits", "kplr 12.fits", "_no.fits", ".no.fits", "a.fits._COPYING_", "50%#.fits", "other.txt"):
            (top / folder / name).write_bytes(f"{folder}/{name}".encode())
    return top


@pytest.mark.parametrize("glob", ["*.fits", "kplr????????[0-2]-*.fits", "*.{txt,fits}", "*"])
def test_same_files_as_sparks_reader(spark, tree, glob):
    uris = worker_uris(spark, str(tree))
    assert uris is not None
    seen = convert._files(spark, str(tree), glob).select("path", "content")
    listed = read_files(list_files(spark, uris, glob)).select("path", "content")
    # A path without a host has one slash or three.
    want = sorted((r.path.replace("file:/", "file:///"), bytes(r.content)) for r in seen.collect())
    assert want and sorted((r.path, bytes(r.content)) for r in listed.collect()) == want
    # Overlapping folders and a file by its name give every file once.
    more = worker_uris(spark, [str(tree), f"{tree}/0000", f"{tree}/0000/kplr000000012-1_llc.fits"])
    assert sorted(r.path for r in list_files(spark, more, glob).collect()) == [p for p, _ in want]


def test_inputs_only_spark_reaches(spark, tree):
    for inputs in (f"{tree}/*", f"{tree}/absent", [str(tree), f"{tree}/absent"], "nowhere://a/b"):
        assert worker_uris(spark, inputs) is None


def test_driver_holds_no_list_of_the_files(spark, tree):
    found = target_files(spark, str(tree))
    assert not [f for f in found.inputFiles() if f.endswith(".fits")]
    assert {r.target for r in found.collect()} == {"12"}


@pytest.mark.parametrize("reached", [True, False])
def test_conversion_through_both_readers(spark, tmp_path, monkeypatch, reached):
    ship_package(spark)
    if not reached:
        monkeypatch.setattr(convert, "worker_uris", lambda spark, inputs: None)
    for target in range(1, 8):
        folder = tmp_path / "in" / f"{target % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        for quarter in range(1, 4):
            data = curve(target, quarter) if (target, quarter) != (3, 2) else b"broken"
            (folder / f"kplr{target:09d}-{quarter}_llc.fits").write_bytes(data)
    paths = (f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress")
    with pytest.raises(ConversionError, match="1 files could not be read, first .*000000003-2"):
        convert_files(spark, *paths, batch_files=8, part_files=2)
    want = [(t, q, tuple(np.arange(3) + 10.0 * q)) for t in range(1, 8) if t != 3 for q in range(1, 4)]
    rows = converted(spark, f"{tmp_path}/out").where(F.col("target") == F.col("KEPLERID").cast("string"))
    assert sorted((r.KEPLERID, r.QUARTER, tuple(r.TIME)) for r in rows.collect()) == want
    done = spark.read.parquet(f"{tmp_path}/progress")
    assert sorted((r.target, r.n_files) for r in done.collect()) == [(str(t), 3) for t in range(1, 8) if t != 3]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_result_is_read_part_by_part(spark, tmp_path, monkeypatch, format):
    ship_package(spark)
    (tmp_path / "in").mkdir()
    for target in range(1, 8):
        for quarter in range(1, 3):
            (tmp_path / "in" / f"kplr{target:09d}-{quarter}_llc.fits").write_bytes(curve(target, quarter))
    paths = (f"{tmp_path}/in", f"{tmp_path}/out of it", f"{tmp_path}/progress")
    (tmp_path / "out of it").mkdir()
    assert compacted(spark, paths[1]).count() == 0
    assert convert_files(spark, *paths, format=format, listed=False) is None
    want = sorted(map(repr, converted(spark, paths[1], format=format).collect()))
    assert len(want) == 14 and all("target=" in r for r in want)
    for part_files in (3, 100):
        got = compacted(spark, paths[1], format=format, part_files=part_files)
        assert sorted(map(repr, got.collect())) == want
        assert not [f for f in got.inputFiles() if "target=" in f]
    monkeypatch.setattr(convert, "worker_uris", lambda spark, inputs: None)
    assert sorted(map(repr, compacted(spark, paths[1], format=format).collect())) == want


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.bin").write_bytes(b"x" * 100)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16m")
    keys = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    unset = [spark.conf.get(k, None) for k in keys]
    try:
        with many_small_files(spark):
            few = spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
        assert few <= spark.sparkContext.defaultParallelism + 1 < 200 // 4
    finally:
        spark.conf.set(size, before)
    assert [spark.conf.get(k, None) for k in keys] == unset
