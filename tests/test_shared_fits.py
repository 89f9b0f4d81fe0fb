"""Fits that spacings share, made once and checked without moving a row once per spacing."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxfold.operators import detrend as D
from fluxfold.operators import segments as G
from fluxfold.operators.skew import find_hot_keys
from fluxfold.plans.catalog_series import _checked_fits


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Series with gaps, short segments, outliers, missing values and rows that come twice."""
    rng = np.random.default_rng(11)
    frames = []
    for target, n in ((1, 300), (2, 90), (3, 40), (4, 3), (5, 1)):
        time = np.sort(rng.uniform(0, n / 10, n))
        time[n // 2 :] += 1.0
        flux = 100 + 5 * np.sin(time) + rng.normal(0, 0.1, n)
        flux[::17] += 30.0
        frames.append(pd.DataFrame({"target_id": target, "quarter": 1, "seq": np.arange(n), "time": time, "flux": flux}))
    frames.append(frames[1].iloc[10:20])
    obs = spark.createDataFrame(pd.concat(frames, ignore_index=True)).withColumn("quarter", F.col("quarter").cast("int"))
    obs = obs.withColumn("flux", F.when(F.col("seq") % 23 != 5, F.col("flux")))
    path = str(tmp_path_factory.mktemp("shared") / "rows")
    G.split_at_gaps(obs).select(*G.SEGMENT, "seq", "time", "flux").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_shared_fits_are_the_fits(spark, rows, limit):
    fit = [*G.SEGMENT, "series", "spacing_id"]
    columns = [*fit, "spacing", "status", "n_knots", "low", "n_points", "ssr", "pieces"]
    fits, rejected = D.fit_and_reject(rows, ["flux"], segment_rows=limit)
    common, out = D.fit_and_reject(rows, ["flux"], segment_rows=limit, shared=True)
    assert common.count() < fits.count() or limit < 10**6
    knot = F.coalesce("first_knot", F.col("first") + F.col("spacing"))
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(D._spaced(common, D.SplineSpec()).select(*columns)) == text(fits.select(*columns))
    spaced = D._spaced(common, D.SplineSpec()).select(*fit, F.round(knot, 9))
    assert text(spaced) == text(fits.select(*fit, F.round("first_knot", 9).alias(spaced.columns[-1])))
    of = common.select(*G.SEGMENT, "series", F.col("spacing_ids")[0].alias("spacing_id"), "spacing_ids", "n_rejected")
    again = out.join(of, fit).select(*G.SEGMENT, "series", F.explode("spacing_ids").alias("spacing_id"), "seq")
    assert text(again.select(*fit, "seq")) == text(rejected.select(*fit, "seq")) != []
    assert of.agg(F.sum("n_rejected")).first()[0] == out.count()


def test_check_of_the_fits(spark, rows):
    """Every row accounted for, no imbalance; the same with long segments and with hot targets."""
    found = []
    for limit, hot_rows in ((10**6, None), (60, 100)):
        hot = find_hot_keys(rows, ["target_id"], "time", hot_rows)
        assert (hot is None) == (hot_rows is None)
        out = _checked_fits(rows, *D.fit_and_reject(rows, ["flux"], segment_rows=limit, shared=True), hot)
        found.append(out.toPandas().sort_values([*G.SEGMENT, "spacing_id"]).reset_index(drop=True))
    first = found[0]
    assert not first.duplicated([*G.SEGMENT, "spacing_id"]).any() and (first.imbalance == 0).all()
    assert set(first.status) == {"tried", "insufficient"} and first.n_knots.max() > 10
    counts = rows.groupBy(*G.SEGMENT).agg(F.count("*").alias("n")).toPandas()
    both = first.merge(counts, on=G.SEGMENT)
    assert (both.n_accounted == both.n).all()
    assert first.groupby(G.SEGMENT).size().eq(20).all()
    pd.testing.assert_frame_equal(first, found[1])


def test_no_exchange_of_rows_with_fits(spark, tmp_path):
    """The rows of a segment, once per fit, meet their fits and are added up in place."""
    from fluxfold.plans.catalog import QUERIES

    rng = np.random.default_rng(3)
    when = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.uniform(0, 20, 200)), unit="D")
    events = pd.DataFrame({"event_id": np.arange(200), "ts": when.astype("datetime64[us]"), "user_id": np.arange(200) % 4,
                           "event_type": "x", "value": rng.uniform(1, 2, 200), "props": '{"k": 1}'})
    spark.createDataFrame(events).write.parquet(f"{tmp_path}/events.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        checked = QUERIES["fit_segment_spline"](spark, str(tmp_path))
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(checked._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set(key, before)
    moved = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.MULTILINE)
    assert moved and not [m for m in moved if re.search(r"\bflux#", m) and re.search(r"\b(fit|pieces)#", m)]
    assert checked.where("imbalance <> 0").count() == 0
