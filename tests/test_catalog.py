"""Every registered query against its reference SQL, and the feature table."""

import json
import math

import pytest
from compare import difference, oracle_connection
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from fluxfold.operators.detrend import SplineSpec
from fluxfold.plans import adapters as A
from fluxfold.plans.catalog import ORACLES, QUERIES
from fluxfold.plans.features import FeatureSpec, create_features
from fluxfold.schemas import FEATURES, VIEW_NAMES

ROWS_ONLY = {"select_best_spline", "create_features"}
# Spline fits, binary codecs and the record format have no expression form.
PYTHON_QUERIES = ROWS_ONLY | {
    "fit_segment_spline", "flatten_series", "ingest_light_curve_files", "export_tfrecord_shards",
    "pluggable_detrender_pieces",
}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


def test_entry_points():
    assert set(entry_points.queries()) >= set(QUERIES)
    assert set(QUERIES) - set(entry_points.oracle_sql()) == ROWS_ONLY
    json.dumps(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in text
    assert "NestedLoop" not in text and "Cartesian" not in text
    if name not in PYTHON_QUERIES:
        assert "Python" not in text and "InPandas" not in text
    got = df.toPandas()
    if name in ORACLES:
        assert difference(got, oracle.execute(ORACLES[name]).df()) is None
    else:
        assert len(got)


def test_features(spark):
    obs, tces, stars = (f(spark, SMALL) for f in (A.observations, A.tces, A.stellar))
    spec = FeatureSpec(spline=SplineSpec(spacings=(2.0, 20.0), max_iter=2))
    df = create_features(obs, tces, stars, spec)
    assert [f.name for f in df.schema] == [*FEATURES.names, "split"]
    types = {f.name: f.dataType for f in df.schema}
    assert all(types[f.name] == f.dataType for f in FEATURES)
    rows = df.collect()
    assert len(rows) == tces.count()
    assert len({r.id for r in rows}) == len(rows)
    sizes = {"global_flux": 301, "global_centroid_shift": 301}
    for row in rows:
        assert all(len(row[v]) == sizes.get(v, 31) for v in VIEW_NAMES)
        # The local view is scaled to a minimum of -1 around a median of 0.
        known = [x for x in row.local_flux if not math.isnan(x)]
        assert math.isclose(min(known), -1, rel_tol=1e-9)
    by_target = {}
    for row in rows:
        by_target.setdefault(row.tce_target_id, set()).add(row.split)
    assert all(len(s) == 1 for s in by_target.values())
    assert df.where(F.col("tce_period").isNull()).count() == 0


def test_features_with_given_splits(spark):
    obs, tces, stars = (f(spark, SMALL) for f in (A.observations, A.tces, A.stellar))
    spec = FeatureSpec(detrend=False)
    place = F.element_at(F.array(*map(F.lit, ("train", "test", "validation", "other"))),
                         (F.col("target_id") % 4 + 1).cast("int"))
    given = tces.select("target_id", place.alias("split"))  # One row per event: repeated.
    nulls = spark.createDataFrame([(None, "train"), (5, None)], "target_id long, split string")
    rows = create_features(obs, tces, stars, spec, splits=given.unionByName(nulls))
    assert [f.name for f in rows.schema] == [*FEATURES.names, "split"]
    got = {(r.tce_target_id, r.id): r.split for r in rows.select("tce_target_id", "id", "split").collect()}
    assert len(got) == tces.where("target_id % 4 <> 3").count() == rows.count()
    names = ("train", "test", "validation")
    assert all(split == names[target % 4] for (target, _), split in got.items())
