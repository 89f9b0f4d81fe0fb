"""Hot groups: every split plan gives the rows of the plain plan, and those of brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxfold.functions.periodic import width_secondary
from fluxfold.operators import lookups as K
from fluxfold.operators import masking as M
from fluxfold.operators import normalize as N
from fluxfold.operators import segments as G
from fluxfold.operators import views as V
from fluxfold.operators.quantiles import group_quantiles
from fluxfold.operators.skew import find_hot_keys
from fluxfold.operators.splitting import ranked_split

LIMIT = 50


@pytest.fixture(scope="module")
def hot(skewed):
    found = find_hot_keys(skewed[0], ["target_id"], "time", LIMIT)
    assert found is not None and found.rows == 1
    assert [r.target_id for r in found.table.collect()] == [1]
    return found


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def same(a, b, *order):
    a, b = frame(a, *order), frame(b, *order)
    assert len(a) and sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(a, b[list(a.columns)], check_dtype=False, rtol=1e-9)


def test_no_hot_keys(skewed):
    assert find_hot_keys(skewed[0], ["target_id"], "time") is None
    assert find_hot_keys(skewed[0], ["target_id"], "time", 500) is None


def test_slices_are_small(skewed, hot):
    sizes = hot.attach(skewed[0]).groupBy("target_id", "_piece").count().toPandas()
    assert sizes["count"].max() <= LIMIT
    assert (sizes.target_id == 1).sum() > 8


def test_quantiles(skewed):
    obs, _, local, _ = skewed
    wanted = {"low": ("flux", 0.0), "q": ("flux", 0.3), "mid": ("time", 0.5), "top": ("flux", 1.0)}
    got = frame(group_quantiles(obs, ["target_id"], wanted, hot_rows=LIMIT), "target_id")
    for row in got.itertuples():
        part = local[local.target_id == row.target_id]
        assert np.allclose([row.low, row.q, row.top], np.quantile(part.flux, [0, 0.3, 1]))
        assert np.isclose(row.mid, np.median(part.time))
    whole = group_quantiles(obs, [], {"m": ("flux", 0.5)}, hot_rows=LIMIT).toPandas()
    assert np.isclose(whole.m[0], np.median(local.flux))


def test_quantiles_ties_and_nulls(spark):
    values = [5.0] * 300 + [1.0] * 100 + [9.0] * 101 + [None] * 50
    df = spark.createDataFrame([(1, v) for v in values] + [(2, None)], "k int, v double")
    got = group_quantiles(df, ["k"], {"m": ("v", 0.5), "q": ("v", 0.1)}, hot_rows=20)
    rows = {r.k: (r.m, r.q) for r in got.collect()}
    assert rows == {1: (5.0, 1.0), 2: (None, None)}


def test_ordered(skewed, hot):
    obs, events, local, _ = skewed
    plain, cut = G.split_at_gaps(obs, 0.5), G.split_at_gaps(obs, 0.5, hot)
    same(plain, cut, "seq")
    got = frame(plain, "seq")
    for _, part in got.sort_values(["time", "seq"]).groupby(["target_id", "quarter"]):
        want = np.concatenate([[0], np.cumsum(np.diff(part.time) > 0.5)])
        assert (part.segment_id.to_numpy() == want).all()
    same(G.scaled_diffs(plain, "flux", 2.0), G.scaled_diffs(cut, "flux", 2.0, hot), "seq")
    flagged = M.flag_events(plain, events)
    same(flagged, M.flag_events(cut, events, hot=hot), "seq")
    values = {"interpolated": "flux", "second": "centroid_x"}
    split = G.interpolate_masked(flagged, values, hot=hot)
    same(G.interpolate_masked(flagged, values), split, "seq")
    filled = frame(split, "time", "seq")
    for _, part in filled.groupby(["target_id", "quarter", "segment_id"]):
        known = part[~part.masked]
        if len(known):
            want = np.interp(part.time, known.time, known.flux)
            assert np.allclose(part.interpolated.to_numpy(float), want)
        else:
            assert part.interpolated.isna().all()


def test_masks(skewed, hot):
    obs, events, local, local_events = skewed
    same(M.mask_events(obs, events), M.mask_events(obs, events, hot=hot), "seq")
    same(M.mark_transits(obs, events), M.mark_transits(obs, events, hot=hot), "seq")
    same(M.join_series_events(obs, events), M.join_series_events(obs, events, hot),
         "seq", "tce_id")
    same(M.split_odd_even(obs, events), M.split_odd_even(obs, events, hot), "seq", "tce_id")
    kept = set(frame(M.mask_events(obs, events, hot=hot), "seq").seq)
    for row in local.itertuples():
        clear = True
        for e in local_events[local_events.target_id == row.target_id].itertuples():
            half = e.period / 2
            folded = np.mod(row.time + half - e.epoch, e.period) - half
            width = min(3 * e.duration, e.secondary_phase, e.period)
            clear &= abs(folded) > width / 2
        assert (row.seq in kept) == clear


def test_statistics(skewed, hot):
    obs = skewed[0]
    keys = ["target_id"]
    same(N.normalize_by_median(obs, keys, "flux"),
         N.normalize_by_median(obs, keys, "flux", hot=hot, hot_rows=LIMIT), "seq")
    a_rows, a = N.robust_rows(obs, keys, "flux", 2.0)
    b_rows, b = N.robust_rows(obs, keys, "flux", 2.0, hot, LIMIT)
    same(a, b, "target_id")
    same(a_rows, b_rows, "seq")
    cut = obs.withColumnRenamed("flux", "diff")
    same(N.mad_sigma(cut, keys), N.mad_sigma(cut, keys, hot=hot, hot_rows=LIMIT), "target_id")


def test_views(skewed, hot):
    obs, events, _, _ = skewed
    values = {"a": "flux", "b": "centroid_shift"}
    order = ("target_id", "tce_id", "bin")
    same(V.folded_view(obs, events, V.LOCAL_VIEW, values),
         V.folded_view(obs, events, V.LOCAL_VIEW, values, hot, LIMIT), *order)
    same(V.odd_even_views(obs, events, V.LOCAL_VIEW, "flux"),
         V.odd_even_views(obs, events, V.LOCAL_VIEW, "flux", hot, LIMIT), "even", *order)
    same(V.secondary_views(obs, events, V.LOCAL_VIEW, "flux"),
         V.secondary_views(obs, events, V.LOCAL_VIEW, "flux", hot, LIMIT), *order)
    same(V.secondary_rows(obs, events, "flux", width_secondary),
         V.secondary_rows(obs, events, "flux", width_secondary, hot), "tce_id", "time")


def test_ranked_split_of_many_targets(spark):
    ids = spark.range(1000).select(F.col("id").alias("target_id"))
    same(ranked_split(ids, 0.2, 0.3), ranked_split(ids, 0.2, 0.3, hot_rows=40), "target_id")
    counts = ranked_split(ids, 0.2, 0.3, hot_rows=40).groupBy("split").count()
    # The boundary id opens the next split, so a split holds one id less than its share.
    assert {r.split: r["count"] for r in counts.collect()} == {
        "test": 199, "validation": 300, "train": 501,
    }


def test_bundle_and_bins(spark, skewed, hot):
    obs, events, _, _ = skewed
    stars = spark.createDataFrame([(1, 5.0), (3, 6.0)], "id long, radius double")
    same(K.target_bundle(obs, events, stars), K.target_bundle(obs, events, stars, hot), "seq")
    same(V.assign_bins(obs, ["target_id"], "time", 7),
         V.assign_bins(obs, ["target_id"], "time", 7, hot=hot), "seq", "bin")


def test_many_events_per_target_take_the_join(skewed, monkeypatch):
    obs, events, _, _ = skewed
    one = M.flag_events(obs, events), M.mark_transits(obs, events)
    plain = [frame(d, "seq") for d in one]
    monkeypatch.setattr(M, "EVENTS_PER_TARGET", 1)
    for want, df in zip(plain, (M.flag_events(obs, events), M.mark_transits(obs, events)),
                        strict=True):
        assert "exists(" not in df._jdf.queryExecution().toString()
        pd.testing.assert_frame_equal(frame(df, "seq")[list(want.columns)], want)


def test_many_events_are_not_broadcast(skewed, monkeypatch):
    obs, events, _, _ = skewed
    values = {"a": "flux"}
    small = V.folded_view(obs, events, V.LOCAL_VIEW, values)
    monkeypatch.setattr(V, "BROADCAST_ROWS", 3)
    same(small, V.folded_view(obs, events, V.LOCAL_VIEW, values), "target_id", "tce_id", "bin")
