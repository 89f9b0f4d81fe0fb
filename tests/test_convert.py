"""Conversion of light-curve files by target, and reads of a folder with a file per id."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.session import ship_package
from fluxfold.sources import tables as S
from fluxfold.sources.convert import (
    ConversionError,
    convert_files,
    converted,
    scan_file_by_id,
    scan_files_with_id,
)
from fluxfold.sources.fits import decode_files, encode_file, file_schema, scan_files

COLUMNS = ("TIME", "PDCSAP_FLUX", "MOM_CENTR1", "MOM_CENTR2")


def curve(target, quarter, n=3):
    values = {c: np.arange(n) + 10.0 * quarter + i for i, c in enumerate(COLUMNS)}
    return encode_file("LIGHTCURVE", values, {"KEPLERID": target, "QUARTER": quarter, "OBJECT": "it"})


@pytest.fixture
def folder(spark, tmp_path):
    ship_package(spark)
    source = tmp_path / "in"
    source.mkdir()

    def put(target, quarter, data=None):
        name = f"kplr{target:09d}-{quarter}_llc.fits"
        (source / name).write_bytes(curve(target, quarter) if data is None else data)

    return tmp_path, put


def pairs(df):
    return sorted((r.target, r.KEPLERID, r.QUARTER, tuple(r.TIME)) for r in df.collect())


def expected(*files):
    return sorted((str(t), t, q, tuple(np.arange(3) + 10.0 * q)) for t, q in files)


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_conversion_resumes_by_target(spark, folder, format):
    path, put = folder
    (path / "in" / "other.fits").write_bytes(b"no target in this name")
    put(12, 1), put(12, 2), put(3, 1)
    paths = (f"{path}/in", f"{path}/out", f"{path}/progress")
    assert pairs(convert_files(spark, *paths, format=format)) == expected((12, 1), (12, 2), (3, 1))
    # One file per target, recorded targets are skipped, new ones are added.
    assert len([f for f in (path / "out" / "target=12").iterdir() if f.name.startswith("part")]) == 1
    put(3, 2), put(700000001, 1)
    want = expected((12, 1), (12, 2), (3, 1), (700000001, 1))
    for _ in range(2):
        assert pairs(convert_files(spark, *paths, format=format)) == want


def test_broken_file_spares_the_other_targets(spark, folder):
    path, put = folder
    put(1, 1), put(2, 1), put(2, 2, b"broken"), put(4, 1)
    paths = (f"{path}/in", f"{path}/out", f"{path}/progress")
    with pytest.raises(ConversionError, match="1 files could not be read, first .*000000002-2"):
        convert_files(spark, *paths, batch_files=2)
    done = spark.read.parquet(f"{path}/progress")
    assert sorted((r.target, r.n_files) for r in done.collect()) == [("1", 1), ("4", 1)]
    assert pairs(converted(spark, f"{path}/out")) == expected((1, 1), (4, 1))
    put(2, 2)
    want = expected((1, 1), (2, 1), (2, 2), (4, 1))
    assert pairs(convert_files(spark, *paths, batch_files=2)) == want


def test_write_without_record_is_repeated_whole(spark, folder):
    path, put = folder
    put(1, 1), put(1, 2)
    convert_files(spark, f"{path}/in", f"{path}/out", f"{path}/lost")
    again = convert_files(spark, f"{path}/in", f"{path}/out", f"{path}/progress")
    assert pairs(again) == expected((1, 1), (1, 2))


def test_hot_target_is_split(spark, folder):
    path, put = folder
    for quarter in range(12):
        put(5, quarter)
    put(6, 1)
    paths = (f"{path}/in", f"{path}/out", f"{path}/progress")
    # Adaptive execution would put the small parts of this test together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = convert_files(spark, *paths, part_files=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pairs(got) == expected(*[(5, q) for q in range(12)], (6, 1))
    assert len(list((path / "out" / "target=5").glob("part*"))) > 1
    assert got.where("target = '6'").count() == 1


def test_conversion_of_nothing(spark, folder):
    path, put = folder
    with pytest.raises(ValueError):
        convert_files(spark, f"{path}/in", f"{path}/out", f"{path}/progress", format="csv")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        convert_files(spark, f"{path}/absent", f"{path}/out", f"{path}/progress")
    assert convert_files(spark, f"{path}/in", f"{path}/out", f"{path}/progress").count() == 0


def test_choice_of_columns(spark, folder):
    path, put = folder
    put(9, 2)
    file = f"{path}/in/kplr000000009-2_llc.fits"

    def read(columns, meta):
        schema = file_schema(spark, file, "LIGHTCURVE", columns, meta)
        return decode_files(scan_files(spark, file), "LIGHTCURVE", schema)

    every = read(None, [])
    assert every.columns == list(COLUMNS)
    some = read(["PDCSAP_FLUX", "TIME"], ["OBJECT", "KEPLERID"])
    assert some.columns == ["OBJECT", "KEPLERID", "TIME", "PDCSAP_FLUX"]
    assert tuple(some.first())[:2] == ("it", 9)
    assert [tuple(r) for r in read([], ["QUARTER"]).collect()] == [(2,)]
    for columns, meta in ((["ABSENT"], []), (None, ["ABSENT"])):
        with pytest.raises(KeyError):
            read(columns, meta)
    with pytest.raises(KeyError):
        file_schema(spark, file, "NOTHING")


def by_id_folder(spark, path):
    schema = T.StructType.fromDDL("a long, b string")
    for name, rows in {"id_1.parquet": [(1, "x"), (2, "y")], "id_22.parquet": [(3, "z")],
                       "other.parquet": [(4, "w")]}.items():
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}), path / name)
    return schema


def test_file_per_id(spark, tmp_path):
    schema = by_id_folder(spark, tmp_path)
    pattern = r"(?<=id_)\d+"
    read = lambda value, **more: scan_file_by_id(spark, str(tmp_path), value, schema, **more)
    assert sorted(map(tuple, read(1, pattern=pattern).collect())) == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in read("other").collect()] == [(4, "w")]
    assert [tuple(r) for r in read("id_22", columns=["b"]).collect()] == [("z",)]
    for unknown in (2, 222, "id_"):
        assert read(unknown, pattern=pattern).count() == 0
    with pytest.raises(ValueError):
        read("")
    with pytest.raises(ValueError):
        read(1, columns=["zz"])
    with pytest.raises(ValueError):
        read(1, pattern=r"id_(\d+)")
    every = scan_files_with_id(spark, str(tmp_path), schema, pattern)
    ids = spark.createDataFrame([("1",), ("9",)], "file_id string")
    assert {r.file_id for r in every.collect()} == {"1", "22"}
    assert sorted(r.a for r in every.join(ids, "file_id").collect()) == [1, 2]


def test_one_file_is_opened(spark, tmp_path):
    """Files of other ids are no Parquet at all: reading any of them would fail."""
    schema = by_id_folder(spark, tmp_path)
    for name in ("id_3.parquet", "id_4.parquet"):
        (tmp_path / name).write_bytes(b"not a table")
    one = scan_file_by_id(spark, str(tmp_path), "22", schema, pattern=r"(?<=id_)\d+")
    assert [tuple(r) for r in one.collect()] == [(3, "z")]
    assert one.rdd.getNumPartitions() == 1


def test_layout_by_bucket_has_few_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 16).withColumn("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")))
    S.write_by_id(rows, str(tmp_path / "t"), "id", 4, spread=2)
    files = list((tmp_path / "t").glob("_bucket=*/part*"))
    assert len(files) <= 4 * 2
    assert S.scan_by_id(spark, str(tmp_path / "t"), "id", 7, buckets=4).count() == 1334 + 1


def test_compressed_files(spark, folder):
    """Files compressed by gzip are converted like others; a broken one costs its target only."""
    path, _ = folder
    for target, quarter in ((1, 1), (1, 2), (3, 1)):
        data = gzip.compress(curve(target, quarter))
        assert len(data) * 8 < len(curve(target, quarter))
        data = data if target == 1 else data[:-20]
        (path / "in" / f"kplr{target:09d}-{quarter}_llc.fits.gz").write_bytes(data)
    paths = (f"{path}/in", f"{path}/out", f"{path}/progress")
    with pytest.raises(ConversionError, match="1 files could not be read, first .*000000003-1"):
        convert_files(spark, *paths, glob="*.fits.gz")
    assert pairs(converted(spark, f"{path}/out")) == expected((1, 1), (1, 2))
    file = f"{path}/in/kplr000000001-1_llc.fits.gz"
    assert file_schema(spark, file, "LIGHTCURVE", ["TIME"], ["OBJECT"]).names == ["OBJECT", "TIME"]
