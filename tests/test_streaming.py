"""Segments from a stream against those of the batch operator, with late and unordered files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxfold.operators.segments import split_at_gaps
from fluxfold.session import fresh_path
from fluxfold.streaming.ingest import gap_segments, stream_gap_segments

SCHEMA = "target_id long, quarter int, seq long, time double"


def by_batch(obs, gap):
    segments = split_at_gaps(obs, gap).groupBy("target_id", "quarter", "segment_id")
    rows = segments.agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("n_points"))
    return sorted(tuple(r) for r in rows.drop("segment_id").collect())


def as_rows(df):
    return sorted(tuple(r) for r in df.select("target_id", "quarter", "start", "end", "n_points").collect())


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    frames = []
    for target in range(1, 9):
        # Steps in 64ths of a day are exact; some gaps are exactly the limit.
        steps = rng.choice([1, 2, 20, 32, 33, 90], 60, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1])
        time = np.cumsum(steps) / 64
        frames.append(pd.DataFrame({"target_id": target, "quarter": 1 + target % 2, "time": time}))
    # Equal times belong together.
    frames.append(frames[0].head(3))
    data = pd.concat(frames, ignore_index=True)
    data.insert(2, "seq", np.arange(len(data)))
    return data


def write(spark, data, folder):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_segments_of_a_batch(spark, series):
    obs = spark.createDataFrame(series, SCHEMA)
    assert as_rows(gap_segments(obs, 0.5)) == by_batch(obs, 0.5)
    missing = obs.unionByName(obs.limit(2).withColumn("time", F.lit(None).cast("double")))
    assert as_rows(gap_segments(missing, 0.5)) == by_batch(obs, 0.5)
    assert gap_segments(obs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="gap"):
        gap_segments(obs, 0)


def test_segments_of_a_stream(spark, series):
    """Three runs over unordered files; an end mark far later closes all segments."""
    source, out, log = (fresh_path(spark, n) for n in ("source", "out", "log"))
    schema = spark.createDataFrame([], SCHEMA).schema
    parts = np.random.default_rng(6).integers(0, 3, len(series))
    for run in range(3):
        write(spark, series[parts == run], source)
        stream_gap_segments(spark, source, out, log, schema, 0.5, "400 days")
    # Nothing is final before observations beyond the delay.
    assert spark.read.parquet(out).count() == 0
    write(spark, pd.DataFrame([(0, 0, -1, 5000.0)], columns=series.columns), source)
    stream_gap_segments(spark, source, out, log, schema, 0.5, "400 days")
    want = by_batch(spark.createDataFrame(series, SCHEMA), 0.5)
    assert as_rows(spark.read.parquet(out)) == want
    # Rows behind the watermark add no segment, and a run without new files changes nothing.
    write(spark, series.head(5), source)
    stream_gap_segments(spark, source, out, log, schema, 0.5, "400 days")
    stream_gap_segments(spark, source, out, log, schema, 0.5, "400 days")
    assert as_rows(spark.read.parquet(out)) == want
