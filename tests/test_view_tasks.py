"""A view's rows are dealt to as many tasks as they need, whatever the bytes of a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxfold.operators import normalize as N
from fluxfold.operators import views as V
from fluxfold.operators.views import known_or_nan, view_arrays

SPEC = V.ViewSpec(21, V.global_bounds, V.global_bin_width(21, 0.16))


@pytest.fixture
def tables(spark):
    series = spark.range(4_000).select(
        (F.col("id") % 40).alias("target_id"), (F.col("id") / 97.0).alias("time"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 31 % 101).cast("double")).alias("flux"),
    )
    events = spark.range(90).select(
        F.when(F.col("id") < 88, F.col("id") % 44).alias("target_id"),
        F.when(F.col("id") != 3, F.col("id")).alias("tce_id"),
        F.lit(0.4).alias("epoch"), (F.col("id") % 7 + 2.0).alias("period"),
        F.lit(0.3).alias("duration"), F.lit(0.7).alias("secondary_phase"),
    )
    return series, events


def found(series, events):
    made = [
        V.folded_view(series, events, SPEC, {"value": "flux"}),
        V.odd_even_views(series, events, SPEC, "flux"),
        V.secondary_views(series, events, SPEC, "flux"),
    ]
    return [(df, sorted(map(tuple, df.collect()), key=repr)) for df in made]


@pytest.mark.parametrize("limit", [V.BROADCAST_ROWS, 1])
def test_tasks_follow_the_rows_of_the_views(spark, tables, monkeypatch, limit):
    want = [rows for _, rows in found(*tables)]
    # The event without an id has a view of its own and no half views, one of no target has none.
    assert [len(rows) for rows in want] == [80 * 21, 79 * 2 * 21, 79 * 21]
    monkeypatch.setattr(V, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(V, "TASK_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if limit == 1 else "10MB")
    try:
        for (df, rows), expected in zip(found(*tables), want, strict=True):
            assert rows == expected
            assert df.rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_arrays_are_normalised_as_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t, n in ((1, 31), (2, 30), (3, 1), (4, 7), (5, 4), (6, 2)):
        for b in range(n):
            rows.append((t, 1, b, None if t == 4 or b == 3 else float("nan") if b == 5 and t == 2 else float(rng.normal())))
    raw = spark.createDataFrame(rows, "target_id long, tce_id int, bin int, value double")
    other = raw.withColumn("value", F.col("value") * 2 - 1)
    stats = N.view_stats(other, "value")
    wanted = [
        N.normalize_view(raw, "value", N.view_stats(raw, "value"), "value"),
        N.normalize_view_by_reference(raw, "value", stats, N.EVENT_KEY, "value"),
        N.normalize_view_by_std(raw, ["value"], spark.sql("SELECT 3.5D AS value")),
    ]
    value, given = F.col("value"), F.col("stats")
    arrays = view_arrays(raw, N.EVENT_KEY, ["value"], missing=True)
    reference = view_arrays(other, N.EVENT_KEY, ["value"], missing=True)
    both = arrays.join(reference.select(*N.EVENT_KEY, N.array_stats(value).alias("stats")), N.EVENT_KEY)
    got = [
        arrays.select(*N.EVENT_KEY, N.normalize_array(value, N.array_stats(value)).alias("value")),
        both.select(*N.EVENT_KEY, N.normalize_array_by_reference(value, given).alias("value")),
        arrays.select(*N.EVENT_KEY, N.scale_array(value, N.array_median(value), F.lit(3.5)).alias("value")),
    ]
    for a, b in zip(wanted, got, strict=True):
        a = view_arrays(a, N.EVENT_KEY, ["value"])
        b = b.withColumn("value", known_or_nan(value))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
