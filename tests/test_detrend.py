"""Spline fits: golden cases, fits by sums against fits in a task, choice of spacing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxfold.functions.spline import fit_segment, interior_knots
from fluxfold.operators import detrend as D
from fluxfold.operators import segments as G
from fluxfold.operators.skew import find_hot_keys

X = np.arange(0, 10, 0.1)


def evaluate(x, pieces, knots, low):
    cell = np.searchsorted(knots, x, side="right")
    distance = x - np.concatenate([[low], knots])[cell]
    return sum(pieces[cell, p] * distance**p for p in range(pieces.shape[1]))


@pytest.mark.parametrize("kind", ["sine", "outliers", "cubic"])
def test_fit_golden(kind):
    y = X**3 - 2 * X if kind == "cubic" else np.sin(X)
    if kind == "outliers":
        y = y.copy()
        y[[20, 50, 80]] += 5
    fit = fit_segment(X, y, 0.5, 3, 5, 3.0)
    assert fit.status == "ok"
    assert (fit.ssr / fit.n_points) ** 0.5 < 1e-4
    # The cubic is met exactly, so what it rejects is rounding noise.
    if kind != "cubic":
        assert fit.rejected.tolist() == ([20, 50, 80] if kind == "outliers" else [])
    values = evaluate(X, fit.pieces, interior_knots(X[0], X[-1], 0.5), fit.low)
    kept = np.delete(np.arange(X.size), fit.rejected)
    assert np.abs(values - y)[kept].max() < 1e-3


@pytest.mark.parametrize(
    ("x", "y", "spacing", "status"),
    [
        (X[:2], X[:2], 0.5, "insufficient"),
        (X, X, 0.1, "bad_knots"),
        (X, X * np.nan, 0.5, "insufficient"),
        (X[:4], np.array([0, np.nan, 0, np.nan]), 0.5, "insufficient"),
    ],
)
def test_fit_fails(x, y, spacing, status):
    assert fit_segment(x, y, spacing, 3, 5, 3.0).status == status


@pytest.mark.parametrize(
    "bad", [{"spacings": ()}, {"spacings": (0.0,)}, {"max_iter": 0}, {"k": 0}, {"k": 6},
            {"sigma_cut": 0}],
)
def test_spec_errors(bad):
    with pytest.raises(ValueError):
        D.SplineSpec(**bad)


@pytest.fixture(scope="module")
def noisy(spark):
    """Two long segments and a short one; one has outliers."""
    rng = np.random.default_rng(3)
    frames = []
    for target, n in ((1, 900), (2, 700), (3, 60)):
        x = np.sort(rng.uniform(0, 12, n))
        y = 50 + 4 * np.sin(x) + rng.normal(0, 0.2, n)
        if target == 1:
            y[::97] += 30
        frames.append(pd.DataFrame({"target_id": target, "quarter": 1, "segment_id": 0,
                                    "time": x, "v": y}))
    data = pd.concat(frames, ignore_index=True)
    data.insert(3, "seq", np.arange(len(data)))
    schema = "target_id long, quarter int, segment_id long, seq long, time double, v double"
    return spark.createDataFrame(data, schema)


def test_fits_by_sums_equal_fits_in_a_task(noisy):
    spec = D.SplineSpec(spacings=(0.02, 0.7, 3.1, 20.0), max_iter=4)
    columns = ["target_id", "spacing_id", "status", "n_knots", "n_points", "ssr", "low", "pieces"]
    order = ["target_id", "spacing_id"]
    whole = D.fit_segment_splines(noisy, ["v"], spec).select(*columns).toPandas()
    split = D.fit_segment_splines(noisy, ["v"], spec, segment_rows=100).select(*columns).toPandas()
    whole, split = (d.sort_values(order).reset_index(drop=True) for d in (whole, split))
    assert len(whole) == len(split) == 12
    for a, b in zip(whole.itertuples(), split.itertuples(), strict=True):
        assert (a.target_id, a.spacing_id, a.status) == (b.target_id, b.spacing_id, b.status)
        if a.status == "ok":
            assert (a.n_knots, a.n_points) == (b.n_knots, b.n_points)
            assert np.isclose(a.ssr, b.ssr, rtol=1e-6)
            assert np.allclose(a.pieces, b.pieces, rtol=1e-5, atol=1e-5)
    assert set(whole.status) == {"ok", "bad_knots"}


def test_flatten(skewed):
    obs, events, local, _ = skewed
    spec = D.SplineSpec(spacings=(2.0, 5.0, 20.0), max_iter=2)
    hot = find_hot_keys(obs, ["target_id"], "time", 50)
    values = {"flat": "flux", "shift": "centroid_shift"}
    plain = D.flatten_series(obs, events, values, 1.5, spec).toPandas().sort_values("seq")
    cut = D.flatten_series(obs, events, values, 1.5, spec, hot=hot, hot_rows=50, segment_rows=80)
    cut = cut.toPandas().sort_values("seq")
    assert len(plain) == len(cut) == len(local)
    assert (plain.flat_status.to_numpy() == cut.flat_status.to_numpy()).all()
    for name in values:
        a, b = plain[name].to_numpy(float), cut[name].to_numpy(float)
        assert np.allclose(a, b, rtol=1e-6, equal_nan=True)
    part = plain[plain.target_id == 1]
    assert part.flat_status.eq("ok").all()
    # The slow wave is gone: the flat series scatters around 1.
    assert abs(np.nanmedian(part.flat) - 1) < 0.02


def test_best_spacing_ties_take_the_first(spark):
    rows = [(1, 0, 0, 2.0), (1, 0, 1, 1.0), (1, 0, 2, 1.0), (1, 1, 2, 5.0), (2, 0, 0, 3.0)]
    scores = spark.createDataFrame(rows, "target_id long, series int, spacing_id int, bic double")
    best = {(r.target_id, r.series): r.spacing_id for r in D.select_best_spacing(scores).collect()}
    assert best == {(1, 0): 1, (1, 1): 2, (2, 0): 0}


def test_user_trends(skewed):
    obs = G.split_at_gaps(skewed[0], 1.5)
    trend = D.segment_trend(lambda x, y: np.full(y.size, y.mean()))
    got = D.detrend_with(obs, "flux", trend, "flat").toPandas()
    want = got.flux / got.groupby(G.SEGMENT).flux.transform("mean")
    assert len(got) == len(skewed[2]) and np.allclose(got.flat, want)
    small = D.segment_trend(lambda x, y: y, segment_rows=10)
    with pytest.raises(Exception, match="more than 10 rows"):
        D.detrend_with(obs, "flux", small, "flat").agg(F.sum("flat")).collect()


def test_piecewise_trend(skewed):
    """Pieces see a bounded part; where the function is local, they give the whole trend."""
    obs = G.split_at_gaps(skewed[0], 1.5)
    obs = obs.withColumn("wave", 100 + F.col("time") * 3 + F.col("time") ** 2)

    def quadratic(x, y):
        assert x.size <= 40 + 2 * 10 + 2 and (np.diff(x) >= 0).all()
        return np.polyval(np.polyfit(x - x[0], y, min(2, x.size - 1)), x - x[0])

    hot = find_hot_keys(obs, ["target_id"], "time", 50)
    for given in (None, hot):
        trend = D.piecewise_trend(quadratic, piece_rows=40, halo=10, hot=given)
        got = D.detrend_with(obs, "wave", trend, "flat").toPandas()
        assert len(got) == len(skewed[2]) and np.allclose(got.flat, 1, rtol=1e-6)


def test_piecewise_trend_blends(skewed):
    """Against the definition, row by row; segments of at most a piece are whole."""
    obs = G.split_at_gaps(skewed[0], 1.5)
    size, halo = 24, 5
    mean = D.piecewise_trend(lambda x, y: np.full(y.size, y.mean()), size, halo)
    got = D.detrend_with(obs, "flux", mean, "flat").toPandas().sort_values(["time", "seq"])
    longest = 0
    for _, part in got.groupby(G.SEGMENT):
        y, n = part.flux.to_numpy(), len(part)
        parts = -(-n // size)
        longest = max(longest, parts)
        place, width = np.arange(n) + 0.5, n / parts
        total, weights = np.zeros(n), np.zeros(n)
        for p in range(parts):
            seen = (place >= p * width - halo) & (place < (p + 1) * width + halo)
            rise = (place - (p * width - halo)) / (2 * halo) if p else np.ones(n)
            fall = ((p + 1) * width + halo - place) / (2 * halo) if p < parts - 1 else np.ones(n)
            w = np.clip(np.minimum(rise, fall), 0, 1) * seen
            total, weights = total + w * y[seen].mean(), weights + w
        assert np.allclose(weights, 1) and np.allclose(part.flat, y / total)
    assert longest > 3
    with pytest.raises(ValueError, match="halo"):
        D.piecewise_trend(lambda x, y: y, 10, 5)


def test_trends_of_many_short_segments_share_a_frame():
    def segments(count):
        for i in range(count):
            yield (i, 1, None if i == 7 else i % 3), np.arange(8), np.arange(8.0), np.full(8, float(i))

    frames = list(D._trend_frames(segments(20_000), lambda x, y: y, list(D.SEGMENT), "trend"))
    assert len(frames) <= 1 + 20_000 * 8 // D.FRAME_ROWS
    rows = pd.concat(frames)
    assert (rows["trend"] == rows["target_id"]).all() and len(rows) == 160_000
    assert rows.loc[rows["target_id"] == 7, "segment_id"].isna().all()
    with pytest.raises(ValueError):
        list(D._trend_frames(segments(2), lambda x, y: y[:3], list(D.SEGMENT), "trend"))


def test_common_fits_are_one_row(spark):
    """Spacings wider than a segment share one fit, which is one row of the table the choice reads."""
    rng = np.random.default_rng(8)
    rows = [(t, 1, s, t * 1000 + s * 100 + i, s * 9.0 + i * 0.07, float(v), float(v * v))
            for t in range(4) for s in range(3) for i, v in enumerate(rng.normal(10, 1, 30))]
    df = spark.createDataFrame(
        rows, "target_id long, quarter int, segment_id long, seq long, time double, v double, w double"
    )
    spec = D.SplineSpec(spacings=(0.5, 1.0, 5.0, 7.0, 9.0))
    common = D.common_fits(df, ["v", "w"], spec)
    assert common.count() == 4 * 3 * 2 * 3
    columns = ["target_id", "segment_id", "series", "spacing_id", "spacing", "status", "n_knots", "n_points"]
    whole = D.fit_segment_splines(df, ["v", "w"], spec).select(*columns).collect()
    assert len(whole) == 4 * 3 * 2 * 5
    assert sorted(map(tuple, whole)) == sorted(map(tuple, D._spaced(common, spec).select(*columns).collect()))
    long = D.common_fits(df, ["v", "w"], spec, segment_rows=20)
    assert long.count() == len(whole) and set(long.columns) == set(common.columns)
