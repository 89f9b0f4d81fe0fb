"""Plan shape: pushdown, pruning, no Python in built-in paths, no nested loops."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fluxfold.operators import lookups as K
from fluxfold.operators import masking as M
from fluxfold.operators import segments as G
from fluxfold.operators import views as V
from fluxfold.plans import adapters as A
from fluxfold.sources.tables import scan_parquet_table

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_filter_and_columns(spark):
    df = scan_parquet_table(
        spark, f"{SMALL}/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 45
    )
    text = plan(df)
    assert "GreaterThan(l_quantity,45.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_lookup_filter_reaches_the_scan(spark):
    text = plan(K.series_for_target(A.observations(spark, SMALL), 8).select("target_id", "flux"))
    assert "EqualTo(user_id,8)" in text
    text = plan(K.tce_by_id(A.tces(spark, SMALL), 8, 1))
    assert "EqualTo(user_id,8)" in text


def test_view_reads_only_its_columns(spark):
    obs, tces = A.observations(spark, SMALL), A.tces(spark, SMALL)
    text = plan(V.folded_view(obs, tces, V.LOCAL_VIEW, {"v": "flux"}))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert all("props" not in s and "event_type" not in s for s in schemas)


def test_segments_take_one_exchange(spark):
    text = plan(G.scaled_diffs(G.split_at_gaps(A.observations(spark, SMALL)), "flux"))
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_masks_never_nest_loops(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        obs, tces = A.observations(spark, SMALL), A.tces(spark, SMALL)
        for df in (M.mask_events(obs, tces), M.mark_transits(obs, tces),
                   V.folded_view(obs, tces, V.LOCAL_VIEW, {"v": "flux"})):
            text = plan(df)
            assert "NestedLoop" not in text and "Cartesian" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
