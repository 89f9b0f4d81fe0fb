"""Size limits choose between plans and never between results."""

import math
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxfold import session
from fluxfold.functions.spline import Frame, solve_banded
from fluxfold.operators import masking
from fluxfold.operators import segments as G
from fluxfold.operators.detrend import SplineSpec, fit_and_reject, fit_segment_splines
from fluxfold.operators.labeling import events_by_target
from fluxfold.operators.quantiles import group_quantiles
from fluxfold.operators.skew import find_hot_keys

INF, NAN = math.inf, math.nan


@pytest.mark.parametrize(
    "odd",
    [[-INF], [INF], [-INF, INF, INF], [NAN, NAN], [NAN, INF, -INF], [1.7e308, -1.7e308], [5e-324, 0.0, -5e-324], [None]],
)
def test_quantiles_with_odd_values(spark, odd):
    values = [float(v % 37) for v in range(100)] + odd
    frame = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    probs = {"low": 0.0, "mid": 0.5, "odd": 0.333, "high": 1.0}
    wanted = {name: ("v", p) for name, p in probs.items()}
    plain, hot = (
        {r.k: tuple(r[n] for n in probs) for r in group_quantiles(frame, ["k"], wanted, hot_rows=limit).collect()}
        for limit in (10**9, 10)
    )
    assert repr(sorted(plain.items())) == repr(sorted(hot.items()))


def test_marks_of_many_events(spark, monkeypatch):
    obs = spark.createDataFrame(
        [(1, 1, 0, 1.0, 5.0)] * 2 + [(1, 1, 1, 2.5, None), (2, 1, 0, 1.0, 3.0), (1, 2, 9, None, 1.0)],
        "target_id long, quarter int, seq long, time double, flux double",
    )
    events = spark.createDataFrame(
        [(1, 1, 1.0, 4.0, 0.5, "one"), (1, 2, 1.0, 1.5, 0.4, None), (1, 2, 1.0, 1.5, 0.6, "twin"), (3, 1, 1.0, 1.0, 1.0, "x")],
        "target_id long, tce_id long, epoch double, period double, duration double, name string",
    )
    rows = []
    for limit in (1000, 0):
        monkeypatch.setattr(masking, "EVENTS_PER_TARGET", limit)
        rows.append(sorted(map(repr, masking.mark_transits(obs, events).select(*obs.columns, "transit").collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 5


@pytest.mark.parametrize("cut", [0.001, 3.0])
def test_long_segments(spark, cut):
    # With the small cut no residual lies inside: a mask that keeps nothing is still a mask.
    values = [math.sin(i / 7) + 0.1 * math.sin(i * i) for i in range(60)]
    rows = spark.createDataFrame(
        [(1, 1, 0, i, i / 10, v) for i, v in enumerate(values)],
        "target_id long, quarter int, segment_id long, seq long, time double, v double",
    )
    spec = SplineSpec(spacings=(1.5, 2.5), sigma_cut=cut)
    plain, split = (
        sorted(tuple(r) for r in fit_segment_splines(rows, ["v"], spec, limit).select("spacing_id", "status", "n_points").collect())
        for limit in (1000, 20)
    )
    assert plain == split and [r[1] for r in plain] == ["insufficient" if cut < 1 else "ok"] * 2


def test_one_row_per_target(spark):
    events = spark.createDataFrame(
        [(7, i, 1.0, 1.0, 2.0, None) for i in (5000, 1, 1001)],
        "target_id long, tce_id long, epoch double, duration double, period double, secondary_phase double",
    )
    (row,) = events_by_target(events).collect()
    assert [e.tce_id for e in row.events] == [1, 1001, 5000] and row.n == 3


@pytest.mark.parametrize("master, ok", [("local[8]", True), ("local", True), ("local-cluster[3,2,900]", False), ("yarn", False)])
def test_no_local_folder_on_a_cluster(monkeypatch, tmp_path, master, ok):
    folders = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folders[-1] if folders else None)
    context.setCheckpointDir = folders.append
    faked = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    if ok:
        assert session.shared_dir(faked) == str(tmp_path)
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(faked)


@pytest.mark.parametrize("burst", [False, True])
def test_long_segments_in_all_columns(spark, burst):
    rng = np.random.default_rng(8)
    frames = []
    for target, n in ((1, 500), (2, 260), (3, 30)):
        # A burst: nearly all points within a hundredth of the time, and one far from all others.
        x = np.sort(np.concatenate([rng.uniform(0, 0.1 if burst else 9, n - 40), rng.uniform(0, 9, 39), [12.0]]) if n > 40 else rng.uniform(0, 9, n))
        y = 20 + np.sin(x) + rng.normal(0, 0.3, n)
        y[::41] += 9
        y[5] = np.nan
        frames.append(pd.DataFrame({"target_id": target, "quarter": 1, "segment_id": 0, "time": x, "v": y}))
    data = pd.concat(frames, ignore_index=True)
    data.insert(3, "seq", np.arange(len(data)) + 1000)
    schema = "target_id long, quarter int, segment_id long, seq long, time double, v double"
    rows = spark.createDataFrame(data, schema).withColumn("v", F.expr("if(isnan(v), null, v)"))
    spec = SplineSpec(spacings=(0.4, 1.7, 20.0), max_iter=4)
    found = []
    for limit in (10**6, 60):
        fits, rejected = fit_and_reject(rows, ["v"], spec, limit)
        out = {(r.target_id, r.spacing_id): r for r in fits.collect()}
        found.append((out, sorted((r.target_id, r.spacing_id, r.seq) for r in rejected.collect())))
    (whole, some), (split, others) = found
    assert whole.keys() == split.keys() and some == others and some
    for key, a in whole.items():
        b = split[key].asDict()
        assert b.keys() == a.asDict().keys()
        for name, x in a.asDict().items():
            same = x == b[name] if not isinstance(x, (float, list)) else np.allclose(x, b[name], rtol=1e-4, atol=1e-5, equal_nan=True)
            assert same, (key, name, x, b[name])
    assert {r.status for r in whole.values()} >= {"ok"}


@pytest.mark.parametrize("kind", ["burst", "outlier", "ties"])
def test_slices_follow_the_rows(spark, kind):
    n, limit = 2000, 100
    at = np.linspace(0, 1e-3, n)
    if kind == "outlier":
        at[-1] = 1e9
    elif kind == "ties":
        at[:] = np.repeat([1.0, 2.0], n // 2)
    flux = np.where(np.arange(n) % 7 == 3, np.nan, np.arange(n) % 50)
    data = pd.DataFrame({"target_id": 1, "quarter": 1, "seq": np.arange(n), "time": at, "flux": flux})
    data["masked"] = np.arange(n) % 11 < 4
    obs = spark.createDataFrame(data).withColumn("flux", F.expr("if(isnan(flux), null, flux)"))
    hot = find_hot_keys(obs, ["target_id"], "time", limit)
    sizes = [r["count"] for r in hot.attach(obs, None, ["time", "seq"]).groupBy("_piece").count().collect()]
    assert max(sizes) <= limit and sum(sizes) == n
    for gap in (1e-7, 0.5):
        plain, cut = G.split_at_gaps(obs, gap), G.split_at_gaps(obs, gap, hot)
        for make in (
            lambda rows, h: rows,
            lambda rows, h: G.scaled_diffs(rows, "flux", 2.0, h),
            lambda rows, h: G.interpolate_masked(rows, {"filled": "flux"}, hot=h),
        ):
            a, b = make(plain, None), make(cut, hot)
            names = sorted(a.columns)
            assert sorted(map(repr, a.select(*names).collect())) == sorted(map(repr, b.select(*names).collect()))


def test_banded_solution():
    rng = np.random.default_rng(9)
    for k, n, batch in ((1, 1, ()), (2, 7, ()), (3, 40, (5,)), (5, 9, (2, 3))):
        full = np.zeros((*batch, n, n))
        for d in range(k + 1):
            i = np.arange(max(0, n - d))
            full[..., i, i + d] = full[..., i + d, i] = rng.normal(0, 1, (*batch, i.size))
        full += 2 * (k + 1) * 4 * np.eye(n)
        band = np.zeros((*batch, k + 1, n))
        for d in range(min(k, n - 1) + 1):
            band[..., d, : n - d] = np.diagonal(full, d, -2, -1)
        x = rng.normal(0, 1, (*batch, n))
        assert np.allclose(solve_banded(band, (full @ x[..., None])[..., 0]), x)
    # A spline of a hundred thousand cells: seconds, and no matrix.
    cells, k = 100_000, 3
    x = np.sort(rng.uniform(0, cells, 8 * cells))
    knots = np.arange(1.0, cells)
    frame = Frame(x, knots, x[0], x[-1], k)
    start = time.perf_counter()
    coef = frame.coefficients(np.sin(x / 3), np.ones(x.size, bool))
    assert time.perf_counter() - start < 60
    assert np.abs(frame.values(coef) - np.sin(x / 3)).max() < 1e-3
