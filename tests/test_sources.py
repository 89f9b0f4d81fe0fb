"""Sources, sinks, incremental ingestion and the manifest."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxfold.operators import labeling as L
from fluxfold.operators import lookups as K
from fluxfold.operators import mapping as M
from fluxfold.schemas import ARCHIVE_URL, CADENCE_PREFIXES, RAW_SERIES
from fluxfold.sources import tables as S
from fluxfold.sources.fits import decode_file, decode_files, encode_file, scan_files
from fluxfold.sources.sinks import (
    TrainingRecords,
    decode_example,
    encode_example,
    masked_checksums,
    write_feature_splits,
)
from fluxfold.streaming.ingest import ingest_available

SERIES_COLUMNS = {"TIME": [1.0, 2.0], "PDCSAP_FLUX": [3.0, np.nan], "MOM_CENTR1": [5.0, 6.0],
                  "MOM_CENTR2": [7.0, 8.0]}


def light_curve(target, quarter):
    return encode_file("LIGHTCURVE", {k: np.array(v) for k, v in SERIES_COLUMNS.items()},
                       {"KEPLERID": target, "QUARTER": quarter, "OBJECT": "it"})


def test_file_decoder():
    data = light_curve(7, 2)
    assert len(data) % 2880 == 0
    row = decode_file(data, "LIGHTCURVE", ["TIME"], ["KEPLERID", "OBJECT"])
    assert row["KEPLERID"] == 7 and row["OBJECT"] == "it"
    assert row["TIME"].tolist() == [1.0, 2.0]
    assert decode_file(data, 1, [], ["QUARTER"]) == {"QUARTER": 2}
    with pytest.raises(KeyError):
        decode_file(data, "NOTHING", [], [])
    with pytest.raises(KeyError):
        decode_file(data, 1, [], ["ABSENT"])


def test_file_ingestion(spark, tmp_path):
    for target, quarter in ((12, 1), (12, 2), (3, 1)):
        (tmp_path / f"kplr{target:09d}-{quarter}_llc.fits").write_bytes(light_curve(target, quarter))
    files = scan_files(spark, f"{tmp_path}/*.fits")
    counts = {r.target: r.n_files for r in S.files_per_target(S.file_target_ids(files)).collect()}
    assert counts == {"12": 2, "3": 1}
    rows = M.explode_series(M.map_series(decode_files(files)))
    assert rows.count() == 6
    missing = rows.where(F.col("flux").isNull())
    assert missing.count() == 3 and {r.time for r in missing.collect()} == {2.0}


def test_incremental_ingestion(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()

    def run():
        ingest_available(spark, f"{source}/*.fits", out, log, transform=decode_files)
        return sorted((r.KEPLERID, r.QUARTER)
                      for r in spark.read.schema(RAW_SERIES).parquet(out).collect())

    (tmp_path / "in" / "a.fits").write_bytes(light_curve(1, 1))
    assert run() == [(1, 1)]
    assert run() == [(1, 1)]
    (tmp_path / "in" / "b.fits").write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017 - whatever the stream reports
        run()
    (tmp_path / "in" / "b.fits").write_bytes(light_curve(2, 1))
    assert run() == [(1, 1), (2, 1)]


def test_csv_convert(spark, tmp_path):
    (tmp_path / "file1.csv").write_text("a,b\n1,2.0\n3,4.0\n")
    (tmp_path / "file2.csv").write_text("a,b\n5,6.0\n7,8.0\n")
    schema = T.StructType.fromDDL("a int, b double")
    source = f"{tmp_path}/file*.csv"
    for suffix in ("parquet", "json"):
        got = S.csv_convert(spark, source, f"{tmp_path}/out.{suffix}", schema)
        assert sorted(map(tuple, got.collect())) == [(1, 2.0), (3, 4.0), (5, 6.0), (7, 8.0)]
    assert S.csv_convert(spark, source, f"{tmp_path}/b.parquet", schema, ["b"]).columns == ["b"]
    with pytest.raises(ValueError):
        S.csv_convert(spark, source, f"{tmp_path}/out.xml", schema)
    with pytest.raises(ValueError):
        S.csv_convert(spark, source, f"{tmp_path}/c.parquet", schema, ["z"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.csv_convert(spark, f"{tmp_path}/none*.csv", f"{tmp_path}/d.parquet", schema)


def test_point_read_prunes_directories(spark, tmp_path):
    rows = spark.range(200).withColumn("v", F.col("id") * 2)
    S.write_by_id(rows, str(tmp_path / "t"), "id", 8)
    got = S.scan_by_id(spark, str(tmp_path / "t"), "id", 42, buckets=8)
    assert [tuple(r) for r in got.collect()] == [(42, 84)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "EqualTo(id,42)" in plan
    assert S.scan_by_id(spark, str(tmp_path / "t"), "id", 42, ["v"], 8).columns == ["v"]
    assert S.scan_by_id(spark, str(tmp_path / "t"), "id", 999, buckets=8).count() == 0


def test_manifest(spark):
    ids = spark.createDataFrame([(892376,), (892376,), (1234567890,)], "target_id long")
    none = spark.createDataFrame([], "url string")
    urls = {r.url for r in S.download_manifest(ids, none).collect()}
    assert len(urls) == 2 * len(CADENCE_PREFIXES["llc"])
    first = f"{ARCHIVE_URL}/0008/000892376//kplr000892376-2009166043257_llc.fits"
    assert first in urls and any("kplr1234567890-" in u for u in urls)
    done = spark.createDataFrame([(first,)], "url string")
    assert {r.url for r in S.download_manifest(ids, done).collect()} == urls - {first}
    assert S.download_manifest(ids, none, "slc").count() == 2 * len(CADENCE_PREFIXES["slc"])
    with pytest.raises(ValueError):
        S.download_manifest(ids, none, "x")


def test_checksums_and_examples():
    # Published check value of the polynomial: crc("123456789") = 0xE3069283.
    crc = 0xE3069283
    masked = ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert masked_checksums([b"", b"123456789", b"1"])[1] == masked
    schema = T.StructType.fromDDL("a long, b string, c array<double>, d double, e int")
    row = Row(-5, "ü", [1.5, 2.5], None, 3)
    assert decode_example(encode_example(row, schema), schema) == (-5, "ü", [1.5, 2.5], None, 3)


def test_training_records(spark, tmp_path):
    spark.dataSource.register(TrainingRecords)
    rows = spark.range(100).select("id", F.array(F.lit(0.5), F.col("id") / 4).alias("v"))
    out = str(tmp_path / "records")
    for _ in range(2):  # Overwrites.
        rows.repartition(3).write.format("tfrecord").mode("overwrite").save(out)
    back = spark.read.format("tfrecord").schema(rows.schema).load(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_feature_splits(spark, tmp_path):
    split = F.element_at(F.array(*map(F.lit, ("train", "test", "validation"))),
                         (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(30).withColumn("split", split)
    for name in ("parquet", "json", "tfrecord"):
        out = str(tmp_path / name)
        write_feature_splits(rows, out, name)
        part = spark.read.format(name).schema("id long").load(f"{out}/split=test")
        assert sorted(r.id for r in part.collect()) == list(range(1, 30, 3))
    with pytest.raises(ValueError):
        write_feature_splits(rows, str(tmp_path / "x"), "xml")


def test_lookups(spark):
    obs = spark.createDataFrame([(1, 1, 0, 1.0), (1, 2, 1, 4.0)],
                                "target_id long, quarter int, seq long, time double")
    assert [r.quarter for r in K.series_for_target(obs, 1).collect()] == [1, 2]
    assert [r.quarter for r in K.series_for_target(obs, 1, (1,)).collect()] == [1]
    asked = spark.createDataFrame([(1, 2), (1, 9)], "target_id long, quarter int")
    assert [tuple(r) for r in K.missing_periods(obs, asked).collect()] == [(1, 9)]
    tces = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")],
                                 "target_id long, tce_id long, name string")
    assert K.tce_count(tces).first().n == 3
    assert [r.target_id for r in K.unique_target_ids(tces).collect()] == [1, 2]
    assert K.tce_by_name(tces, " b ").first().target_id == 2
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            K.tce_by_name(tces, bad)
    texts = spark.createDataFrame([(" 7 ",), ("b",), ("",), ("zz",)], "text string")
    found = {r.text.strip(): r.target_id for r in K.search_targets(texts, tces).collect()}
    assert found == {"7": 7, "b": 2}


@pytest.mark.parametrize(
    ("labels", "want"),
    [
        ([], {}),
        (["AFP", "NTP"], {"AFP": 1, "NTP": 1, "FP": 2}),
        (["PC", "AFP", "NTP", "FP", "UNKNOWN"], dict.fromkeys("PC AFP NTP FP UNKNOWN".split(), 1)),
        (["test", "UNKNOWN"], {"UNKNOWN": 2}),
    ],
)
def test_label_counts(spark, labels, want):
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    counts = L.labels_distribution(df)
    got = {r.label: r.n for r in counts.collect()}
    assert got == dict.fromkeys("PC NTP AFP UNKNOWN FP".split(), 0) | want
    tree = {r.label: (r.parent, r.n) for r in L.label_hierarchy(counts).collect()}
    assert tree["KNOWN"] == ("", sum(got.values()) - got["FP"] - got["UNKNOWN"])


def test_mapping_helpers(spark):
    nested = spark.createDataFrame([Row(d=Row(b=1), e="test")])
    assert M.flatten_struct(nested).collect() == [Row(b=1, e="test")]
    assert M.flatten_struct(nested, ["e"]).columns == ["b"]
    with pytest.raises(ValueError):
        M.key_by(nested, [])
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        M.map_stellar(nested)
