"""Scalar expressions against their golden cases."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxfold.functions import labels as B
from fluxfold.functions import periodic as P


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_phase_fold_range_and_error(spark):
    rows = [(t / 7.0, 0.3, 2.5) for t in range(-50, 50)]
    folded = values(spark, rows, "t double, e double, p double",
                    P.phase_fold(F.col("t"), F.col("e"), F.col("p")))
    for (t, e, p), (x,) in zip(rows, folded, strict=True):
        assert -p / 2 <= x <= p / 2
        turns = (t - e - x) / p
        assert abs(turns - round(turns)) < 1e-9
    for period in (-1, 0):
        with pytest.raises(ValueError):
            P.phase_fold(F.col("t"), 0.0, period)
    assert values(spark, [(1.0, 0.0, 0.0)], "t double, e double, p double",
                  P.phase_fold(F.col("t"), F.col("e"), F.col("p"))) == [(None,)]


@settings(max_examples=15, deadline=None)
@given(st.floats(0, 1e6), st.floats(1e-3, 1e3), st.floats(0, 1e4))
def test_phase_fold_property(spark, t, p, e):
    ((x,),) = values(spark, [(t,)], "t double", P.phase_fold(F.col("t"), e, p))
    assert -p / 2 <= x <= p / 2


def test_distance(spark):
    rows = [(1.0, 6.0), (2.0, None), (3.0, 8.0), (None, 9.0), (5.0, 10.0)]
    got = values(spark, rows, "x double, y double", P.centroid_distance(F.col("x"), F.col("y")))
    want = [6.08276253, None, 8.54400375, None, 11.18033989]
    for (g,), w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or math.isclose(g, w, rel_tol=1e-8))


def test_widths(spark):
    rows = [(1.0, 0.5, 1.2), (1.0, 0.3, 1.2), (1.0, 0.5, 0.3), (1.0, 0.5, -0.3), (1.0, 0.5, None)]
    got = values(spark, rows, "p double, d double, s double",
                 P.width_adjusted(F.col("p"), F.col("d"), F.col("s")))
    assert [round(g[0], 9) for g in got] == [1.0, 0.9, 0.3, 0.3, 1.0]
    got = values(spark, [(1.0, 0.2, -0.5), (1.0, 0.5, 0.3)], "p double, d double, s double",
                 P.width_secondary(F.col("p"), F.col("d"), F.col("s")))
    assert [round(g[0], 9) for g in got] == [0.6, 0.8]


@pytest.mark.parametrize(
    ("period", "duration", "n", "want"),
    [(2, 1, 3, (-1, 1)), (4, 1, 1, (-1, 1)), (2, 1, 1, (-1, 1)), (1.99, 0.99, 1, (-0.99, 0.99))],
)
def test_local_bounds(spark, period, duration, n, want):
    bounds = P.local_bounds(n)(F.lit(float(period)), F.lit(float(duration)))
    assert values(spark, [(1,)], "a int", *bounds) == [want]


def test_global_bounds_and_bin_widths(spark):
    assert values(spark, [(2.2,)], "p double", *P.global_bounds(F.col("p"), F.col("p"))) == [
        (-1.1, 1.1)
    ]
    ((w,),) = values(spark, [(2.2,)], "d double", P.local_bin_width(0.16)(F.col("d"), F.col("d")))
    assert math.isclose(w, 0.352)
    for p, d, f, n, want in [(3, 1, 0.16, 2, 1.5), (2, 2, 1.16, 2, 2.32), (1.4, 2, 0.35, 2, 0.7)]:
        width = P.global_bin_width(n, f)(F.lit(float(p)), F.lit(float(d)))
        ((w,),) = values(spark, [(1,)], "a int", width)
        assert math.isclose(w, want)
    for bad in (lambda: P.global_bin_width(1), lambda: P.local_bin_width(0),
                lambda: P.local_bounds(0)):
        with pytest.raises(ValueError):
            bad()


def test_bic(spark):
    ((score,),) = values(spark, [(1,)], "a int", P.bic(1, 1, 1, 1, 1))
    assert math.isclose(score, 2.8378770664113455)
    for args in ((-1, 1, 1, 1), (1, 0, 1, 1), (1, 1, -1, 1), (1, 1, 1, -1)):
        with pytest.raises(ValueError):
            P.bic(*args)


def test_labels(spark):
    texts = ["PC", "PLANET_CANDIDATE", "FP", "FALSE_POSITIVE", "AFP",
             "ASTROPHYSICAL_FALSE_POSITIVE", "NTP", "NON_TRANSITING_PHENOMENA", "UNKNOWN",
             "TEST", None]
    got = values(spark, [(t,) for t in texts], "l string", B.map_label(F.col("l")),
                 B.label_to_int(B.map_label(F.col("l"))))
    want = ["PC", "PC", "FP", "FP", "AFP", "AFP", "NTP", "NTP", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert got == [(w, int(w == "PC")) for w in want]


def test_valid_ids(spark):
    ids = [-1, 0, 1, 999_999_999, 1_000_000_000, None]
    got = values(spark, [(i,) for i in ids], "i long", B.is_valid_target_id(F.col("i")))
    assert [g[0] for g in got] == [False, False, True, True, False, False]
    rows = spark.createDataFrame([(0,)], "i long")
    with pytest.raises(Exception, match="target id"):
        rows.select(B.require_target_id(F.col("i"))).collect()
