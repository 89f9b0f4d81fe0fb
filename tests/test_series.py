"""Series, mask, bin and normalisation operators against golden cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxfold.functions.periodic import width_fixed_durations
from fluxfold.operators import masking as M
from fluxfold.operators import normalize as N
from fluxfold.operators import segments as G
from fluxfold.operators import views as V
from fluxfold.operators.splitting import hash_split, ranked_split

SERIES = "target_id long, quarter int, seq long, time double, flux double"
EVENTS = ("target_id long, tce_id long, period double, duration double, epoch double, "
          "secondary_phase double, name string")  # fmt: skip


def series(spark, times, values=None, quarters=None):
    values = times if values is None else values
    quarters = [1] * len(times) if quarters is None else quarters
    rows = [(1, q, i, float(t), None if v is None else float(v))
            for i, (t, v, q) in enumerate(zip(times, values, quarters, strict=True))]
    return spark.createDataFrame(rows, SERIES)


def events(spark, *rows):
    return spark.createDataFrame([(1, i, float(p), float(d), float(e), None, n)
                                  for i, (p, d, e, n) in enumerate(rows, 1)], EVENTS)


def test_mask_events(spark):
    obs = series(spark, range(20), [10 * t for t in range(20)])
    width = width_fixed_durations(3)

    def kept(*rows):
        out = M.mask_events(obs, events(spark, *rows), width).orderBy("time").collect()
        return [r.time for r in out]

    assert kept((4, 1, 3, None)) == [1, 5, 9, 13, 17]
    assert kept((4, 1, 3, None), (7, 1, 6, None)) == [1, 9, 17]


def test_mask_empty_segments(spark):
    times = [*range(5), *range(10, 20)]
    obs = G.split_at_gaps(series(spark, times), 2)
    masked = M.mask_events(obs, events(spark, (10, 2, 2.5, None)), width_fixed_durations(3))
    rows = {r.segment_id: r.n_left for r in M.mask_segments(obs, masked).collect()}
    assert rows == {0: 0, 1: 4}
    assert [r.segment_id for r in M.mask_segments(obs, masked, False).collect()] == [1]


@pytest.mark.parametrize("name", [None, "star b"])
def test_mark_transits(spark, name):
    obs = series(spark, range(10))
    rows = M.mark_transits(obs, events(spark, (4, 1, 1, name))).orderBy("time").collect()
    mark = name or "1"
    none = M.NO_EVENT
    assert [r.transit for r in rows] == [mark] * 3 + [none] + [mark] * 3 + [none] + [mark] * 2


def test_later_events_win(spark):
    obs = series(spark, [1.0])
    found = M.mark_transits(obs, events(spark, (4, 1, 1, "a"), (5, 1, 1, "b"))).first()
    assert found.transit == "b"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 50), min_size=1, max_size=40), st.floats(0.1, 5))
def test_gaps_property(spark, times, gap):
    rows = G.split_at_gaps(series(spark, times), gap).orderBy("time", "seq").collect()
    want = np.concatenate([[0], np.cumsum(np.diff(sorted(times)) > gap)])
    assert [r.segment_id for r in rows] == want.tolist()


def test_gap_errors_and_edges(spark):
    obs = series(spark, [0, 0.75, 2], quarters=[1, 1, 2])
    assert [r.segment_id for r in G.split_at_gaps(obs).orderBy("time").collect()] == [0, 0, 0]
    for gap in (0, -1):
        with pytest.raises(ValueError):
            G.split_at_gaps(obs, gap)
    with pytest.raises(ValueError):
        G.scaled_diffs(obs, "flux", 0)


@pytest.mark.parametrize(
    ("values", "scale", "want"),
    [([1, 2, 3], 1, [1, 1]), ([1, 2, 3], 2, [0.5, 0.5]), ([3, 2, 1], 1, [-1, -1])],
)
def test_diffs(spark, values, scale, want):
    obs = series(spark, [0, 1, 2], values).withColumn("segment_id", F.lit(0))
    rows = G.scaled_diffs(obs, "flux", scale).orderBy("time").collect()
    assert [r["diff"] for r in rows] == want


def test_period_edges(spark):
    obs = series(spark, [1, 2, 3, 4, 5], quarters=[1, 1, 2, 2, 5])
    rows = G.period_edges(obs).orderBy("quarter").collect()
    assert [(r.quarter, r.edge_time) for r in rows] == [(1, 2.0), (2, 4.0)]


def test_normalize_by_median(spark):
    obs = series(spark, range(5), [1, 2, None, 4, 5])
    rows = N.normalize_by_median(obs, ["target_id"], "flux").orderBy("seq").collect()
    want = [1 / 3, 2 / 3, None, 4 / 3, 5 / 3]
    for r, w in zip(rows, want, strict=True):
        assert r.normalized is None if w is None else math.isclose(r.normalized, w)


@pytest.mark.parametrize(
    ("values", "cut", "mean", "std", "kept"),
    [
        ([1, 2, 9, 3, 9, 2, 2, 3], 2, 2.4, 0.21084829404535066, "01010111"),
        ([1, 2, 9, 3, 9, 2, 2, 3], 5, 2.1666666666666665, 0.25973124082465987, "11010111"),
        ([1, 1, 1, 1], 2, 1.0, 0.0, "1111"),
    ],
)
def test_robust_mean(spark, values, cut, mean, std, kept):
    rows, stats = N.robust_rows(series(spark, range(len(values)), values), ["target_id"], "flux",
                                cut)
    (found,) = stats.collect()
    assert math.isclose(found["mean"], mean) and math.isclose(found.mean_std, std)
    assert "".join(str(int(r.kept)) for r in rows.orderBy("seq").collect()) == kept


def bins_of(spark, xs, num_bins, **options):
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double")
    out = V.assign_bins(rows, [], "x", num_bins, **options).collect()
    found = [[] for _ in range(num_bins)]
    for r in sorted(out):
        found[r.bin].append(round(r.x, 1))
    return found


def test_bins_follow_the_interval_rule(spark):
    xs = [i / 10 for i in range(11)]
    for n, w in ((4, 0.2), (4, 0.3), (5, None)):
        width = w or 1.0 / n
        step = (1.0 - width) / (n - 1)
        want = [[x for x in xs if i * step <= x < width + i * step] for i in range(n)]
        options = {} if w is None else {"bin_width": w}
        assert bins_of(spark, xs, n, **options) == want
    assert bins_of(spark, xs, 4, bin_width=0.2)[0] == [0.0, 0.1]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-2, 2), min_size=1, max_size=50), st.integers(2, 40),
       st.floats(0.01, 3.9))
def test_bins_property(spark, xs, n, width):
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i long, x double")
    out = V.assign_bins(rows, [], "x", n, bin_width=width, x_min=-2.0, x_max=2.0).collect()
    step = (4.0 - width) / (n - 1)
    want = {(i, b) for i, x in enumerate(xs) for b in range(n)
            if x < 2 and -2.0 + b * step <= x < -2.0 + width + b * step}
    assert {(r.i, r.bin) for r in out} == want


def test_bin_errors(spark):
    rows = spark.createDataFrame([(1.0,)], "x double")
    for args in ({"num_bins": 1}, {"num_bins": 4, "bin_width": 0.0},
                 {"num_bins": 4, "x_min": 1.0, "x_max": 1.0},
                 {"num_bins": 4, "x_min": 0.0, "x_max": 1.0, "bin_width": 1.0}):
        with pytest.raises(ValueError):
            V.assign_bins(rows, [], "x", **args)
    with pytest.raises(ValueError):
        V.ViewSpec(1, V.global_bounds, V.global_bin_width(31))


def test_view_against_brute_force(skewed):
    obs, evs, local, local_events = skewed
    got = V.folded_view(obs, evs, V.LOCAL_VIEW, {"value": "flux"}).toPandas()
    assert len(got) == 31 * len(local_events)
    table = got.set_index(["target_id", "tce_id", "bin"]).value
    for e in local_events.itertuples():
        part = local[local.target_id == e.target_id]
        half = e.period / 2
        x = np.mod(part.time.to_numpy() + half - e.epoch, e.period) - half
        lo, hi = max(-half, -2.5 * e.duration), min(half, 2.5 * e.duration)
        w = 0.16 * e.duration
        s = (hi - lo - w) / 30
        for b in range(31):
            inside = (x >= lo + b * s) & (x < lo + w + b * s)
            want = np.median(part.flux[inside]) if inside.any() else np.median(part.flux)
            assert math.isclose(table[(e.target_id, e.tce_id, b)], want, rel_tol=1e-12)


def test_view_defaults_and_missing(spark):
    obs = series(spark, [0.05, 0.15, 0.35], [1.0, 3.0, None])
    event = events(spark, (1.0, 0.4, 0.5, None))
    spec = V.ViewSpec(5, V.global_bounds, lambda p, d: F.lit(0.2), None, 10.0)
    rows = V.folded_view(obs, event, spec, {"v": "flux"}).orderBy("bin").collect()
    # A bin of missing values stays missing; a bin without rows gets the default.
    assert [r.v for r in rows] == [2.0, None, 10.0, 10.0, 10.0]


def test_parity_without_rows_has_no_view(spark):
    obs = series(spark, [0.4, 0.5, 0.6], [1.0, 2.0, 3.0])
    rows = V.odd_even_views(obs, events(spark, (1.0, 0.2, 0.5, None)), V.LOCAL_VIEW, "flux")
    assert {r.even for r in rows.collect()} == {False}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60),
       st.sampled_from([(0.0, 0.0), (0.1, 0.1), (0.33, 0.33), (0.5, 0.5), (1.0, 0.0)]))
def test_ranked_split(spark, ids, sizes):
    rows = spark.createDataFrame([(i,) for i in ids], "target_id long")
    got = {r.target_id: r.split for r in ranked_split(rows, *sizes).collect()}
    assert set(got) == set(ids)
    unique, counts = np.unique(ids, return_counts=True)
    total = np.cumsum(counts)
    edges = [np.argmax(total >= share * len(ids)) for share in (sizes[0], sum(sizes))]
    want = {int(u): "test" if i < edges[0] else "validation" if i < edges[1] else "train"
            for i, u in enumerate(unique)}
    assert got == want


def test_hash_split(spark):
    ids = spark.range(5000).withColumnRenamed("id", "target_id")
    split = hash_split(F.col("target_id"), 0.2, 0.3, 1).alias("split")
    counts = {r.split: r["count"] for r in ids.groupBy(split).count().collect()}
    assert abs(counts["test"] - 1000) < 150 and abs(counts["validation"] - 1500) < 150
    for sizes in ((-0.1, 0.1), (0.1, 1.1), (0.6, 0.5)):
        with pytest.raises(ValueError):
            hash_split(F.col("target_id"), *sizes)
