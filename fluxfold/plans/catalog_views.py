"""Views of folded series, their normalisation, and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxfold.operators import normalize as N
from fluxfold.operators import views as V
from fluxfold.operators.skew import find_hot_keys
from fluxfold.operators.splitting import ranked_split
from fluxfold.plans import adapters as A
from fluxfold.plans.features import combine_views, create_features, join_features
from fluxfold.plans.registry import fold, query, tidy
from fluxfold.plans.sqltext import (
    GLOBAL,
    GLOBAL_VIEW_SQL,
    LOCAL,
    LOCAL_VIEW_SQL,
    RANKED_SPLIT_SQL,
    view_sql,
)
from fluxfold.schemas import FEATURES, VIEW_NAMES
from fluxfold.session import materialize

KEY = V.EVENT_KEY
_FOLD = fold('o."time"', "t.epoch", "t.period")


def _inputs(spark, sf):
    obs = A.observations(spark, sf)
    return obs, A.tces(spark, sf), find_hot_keys(obs, ["target_id"], "time")


@query(
    "assign_bins",
    f"""
    WITH spread AS (
      SELECT seq, flux, target_id, min("time") OVER (PARTITION BY target_id) AS lo,
             max("time") OVER (PARTITION BY target_id) AS hi, "time" AS x FROM obs
    ),
    framed AS (SELECT *, 4.0::DOUBLE AS w, (hi - lo - 4.0::DOUBLE) / 9.0::DOUBLE AS s FROM spread)
    SELECT target_id, seq, CAST(bin AS BIGINT) AS bin
    FROM framed, (SELECT unnest(range(10)) AS bin)
    WHERE x >= lo AND x < hi AND x >= lo + bin * s AND x < lo + w + bin * s AND s > 0
    """,
    "obs",
)
def assign_bins(spark, sf):
    obs, _, hot = _inputs(spark, sf)
    rows = V.assign_bins(obs, ["target_id"], "time", 10, bin_width=4.0, hot=hot)
    return tidy(rows.select("target_id", "seq", "bin"))


@query(
    "bin_aggregate",
    """
    WITH spread AS (
      SELECT target_id, flux, "time" AS x, 0.0::DOUBLE AS lo, 30.0::DOUBLE AS hi FROM obs
    ),
    framed AS (SELECT *, 3.0::DOUBLE AS w, (hi - lo - 3.0::DOUBLE) / 9.0::DOUBLE AS s FROM spread)
    SELECT target_id, CAST(bin AS BIGINT) AS bin, round(median(flux), 6) AS value
    FROM framed, (SELECT unnest(range(10)) AS bin)
    WHERE x >= lo AND x < hi AND x >= lo + bin * s AND x < lo + w + bin * s
    GROUP BY ALL
    """,
    "obs",
)
def bin_aggregate(spark, sf):
    obs, _, hot = _inputs(spark, sf)
    rows = V.assign_bins(obs, ["target_id"], "time", 10, bin_width=3.0, x_min=0.0, x_max=30.0)
    return tidy(
        V.group_medians(
            rows, ["target_id", "bin"], {"value": "flux"}, may_be_hot=hot is not None
        )
    )


def _view(name: str, spec: V.ViewSpec, sql: str, **values: str) -> None:
    columns = ", ".join(f"round({c}, 6) AS {c}" for c in values)

    @query(name, f"WITH {sql} SELECT target_id, tce_id, CAST(bin AS BIGINT) AS bin, {columns} "
                 f"FROM {name}_out", "obs tces")  # fmt: skip
    def run(spark, sf):
        obs, tces, hot = _inputs(spark, sf)
        return tidy(V.folded_view(obs, tces, spec, values, hot))


_OUT = ", {n}_out AS (SELECT * FROM {v})"
_view("folded_view", V.ViewSpec(51, V.global_bounds, V.global_bin_width(51, 0.16)),
      view_sql("v", 51, "-(period / 2.0::DOUBLE)", "period / 2.0::DOUBLE",
               "greatest(period / 51.0::DOUBLE, duration * 0.16::DOUBLE)")
      + _OUT.format(n="folded_view", v="v"), value="flux")
_view("local_view", V.LOCAL_VIEW, view_sql("v", *LOCAL) + _OUT.format(n="local_view", v="v"),
      value="flux")
_view("global_view", V.GLOBAL_VIEW, view_sql("v", *GLOBAL) + _OUT.format(n="global_view", v="v"),
      value="flux")


@query(
    "sort_folded",
    f"""
    SELECT o.target_id, t.tce_id, o.seq, row_number() OVER (
             PARTITION BY o.target_id, t.tce_id ORDER BY {_FOLD}, o.seq) AS rank
    FROM obs o JOIN tces t ON t.target_id = o.target_id
    """,
    "obs tces",
)
def sort_folded(spark, sf):
    obs, tces, hot = _inputs(spark, sf)
    rows = V.fold_rows(obs.select("target_id", "seq", "time"), tces, hot)
    order = ["target_id", "tce_id", "folded", "seq"]
    ranked = V.rank_folded(rows.select(*order), KEY, ["folded", "seq"])
    return tidy(ranked.drop("folded"))


@query(
    "pluggable_column_functions",
    "WITH "
    + view_sql("v", 21, "-duration", "duration", "duration * 0.2::DOUBLE",
               aggregate="avg", default="0.0::DOUBLE")
    + " SELECT target_id, tce_id, CAST(bin AS BIGINT) AS bin, round(value, 6) AS value FROM v",
    "obs tces",
)
def pluggable_column_functions(spark, sf):
    obs, tces, hot = _inputs(spark, sf)
    spec = V.ViewSpec(
        21,
        bounds=lambda period, duration: (-duration, duration),
        bin_width=lambda period, duration: duration * F.lit(0.2),
        aggregate=F.avg,
        default=0.0,
    )
    return tidy(V.folded_view(obs, tces, spec, {"value": "flux"}, hot))


def _stats_sql(view: str, name: str) -> str:
    return f"""
    {name}_m AS (SELECT target_id, tce_id, median(value) AS m, min(value) AS lo
                 FROM {view} GROUP BY ALL),
    {name} AS (SELECT target_id, tce_id, m, abs(lo - m) AS a FROM {name}_m)"""


def _normal_views(kind: str, value: str, sql_value: str, spec, shape) -> None:
    name = f"{kind}_views"
    sql = f"""
    WITH {view_sql("v", *shape, value=sql_value)}, {_stats_sql("v", "st")}
    SELECT v.target_id, v.tce_id, CAST(v.bin AS BIGINT) AS bin,
           round((v.value - st.m) / nullif(st.a, 0), 6) AS value
    FROM v JOIN st ON st.target_id = v.target_id AND st.tce_id = v.tce_id
    """

    @query(name, sql, "obs tces")
    def run(spark, sf):
        obs, tces, hot = _inputs(spark, sf)
        raw = materialize(V.folded_view(obs, tces, spec, {"value": value}, hot), "views")
        return tidy(N.normalize_view(raw, "value", N.view_stats(raw, "value"), "value"))


_normal_views("flux", "flux", "flux", V.LOCAL_VIEW, LOCAL)
_normal_views("centroid", "centroid_x", "centroid_x", V.LOCAL_VIEW, LOCAL)


@query(
    "view_median_absmin",
    f"""
    WITH {LOCAL_VIEW_SQL}, {_stats_sql("local_view", "st")}
    SELECT target_id, tce_id, round(m, 6) AS median, round(a, 6) AS abs_min FROM st
    """,
    "obs tces",
)
def view_median_absmin(spark, sf):
    obs, tces, hot = _inputs(spark, sf)
    raw = V.folded_view(obs, tces, V.LOCAL_VIEW, {"value": "flux"}, hot)
    return tidy(N.view_stats(raw, "value"))


_PARITY_ROWS = f"""
    parity_rows AS (
      SELECT o.target_id, t.tce_id, {_FOLD} AS x, o.flux AS v,
             greatest(0, CAST(floor((o."time" - (t.epoch + t.period / 2.0::DOUBLE)) / t.period)
                              AS BIGINT) + 1) % 2 = 1 AS even
      FROM obs o JOIN tces t ON t.target_id = o.target_id
    ),"""


def _by_reference(view: str, key: str = "") -> str:
    extra = f", {key}" if key else ""
    pick = f", v.{key}" if key else ""
    same = f" AND l.{key} = v.{key}" if key else ""
    return f"""
    SELECT v.target_id, v.tce_id{pick}, CAST(v.bin AS BIGINT) AS bin,
           round((v.value - st.m) / nullif(greatest(st.a, l.lo - st.m), 0), 6) AS value
    FROM {view} v
    JOIN st ON st.target_id = v.target_id AND st.tce_id = v.tce_id
    JOIN (SELECT target_id, tce_id{extra}, min(value) AS lo FROM {view} GROUP BY ALL) l
      ON l.target_id = v.target_id AND l.tce_id = v.tce_id{same}
    """


_ODD_EVEN_SQL = f"""
    WITH {LOCAL_VIEW_SQL}, {_stats_sql("local_view", "st")}, {_PARITY_ROWS}
    {view_sql("p", *LOCAL, rows="parity_rows", key="even")}
    {_by_reference("p", "even")}"""


def _reference_stats(obs, tces, hot):
    raw = V.folded_view(obs, tces, V.LOCAL_VIEW, {"value": "flux"}, hot)
    return N.view_stats(raw, "value")


@query("odd_even_views", _ODD_EVEN_SQL, "obs tces")
def odd_even_views(spark, sf):
    obs, tces, hot = _inputs(spark, sf)
    raw = materialize(V.odd_even_views(obs, tces, V.LOCAL_VIEW, "flux", hot), "parity")
    keys = [*KEY, "even"]
    rows = N.normalize_view_by_reference(
        raw, "value", _reference_stats(obs, tces, hot), keys, "value"
    )
    return tidy(rows.select(*keys, "bin", "value"))


_SECONDARY_ROWS = f"""
    moved AS (SELECT target_id, tce_id, epoch + secondary_phase AS epoch, duration, period
              FROM tces WHERE secondary_phase IS NOT NULL),
    second_rows AS (
      SELECT o.target_id, t.tce_id,
             {fold('o."time"', "(t.epoch + t.secondary_phase)", "t.period")} AS x, o.flux AS v
      FROM obs o JOIN tces t ON t.target_id = o.target_id
      WHERE abs({_FOLD}) > 0.5 * CASE WHEN t.duration < abs(t.secondary_phase)
        THEN t.duration * 3.0::DOUBLE ELSE abs(t.secondary_phase) + t.duration END
    ),"""


@query(
    "secondary_views",
    f"""
    WITH {LOCAL_VIEW_SQL}, {_stats_sql("local_view", "st")}, {_SECONDARY_ROWS}
    {view_sql("p", *LOCAL, rows="second_rows", events="moved")}
    {_by_reference("p")}
    """,
    "obs tces",
)
def secondary_views(spark, sf):
    obs, tces, hot = _inputs(spark, sf)
    raw = materialize(V.secondary_views(obs, tces, V.LOCAL_VIEW, "flux", hot), "secondary")
    rows = N.normalize_view_by_reference(
        raw, "value", _reference_stats(obs, tces, hot), KEY, "value"
    )
    return tidy(rows.select(*KEY, "bin", "value"))


@query(
    "normalize_view_median_absmin",
    f"""
    WITH {GLOBAL_VIEW_SQL}, {LOCAL_VIEW_SQL}, {_stats_sql("local_view", "st")}
    {_by_reference("global_view")}
    """,
    "obs tces",
)
def normalize_view_median_absmin(spark, sf):
    obs, tces, hot = _inputs(spark, sf)
    raw = materialize(V.folded_view(obs, tces, V.GLOBAL_VIEW, {"value": "flux"}, hot), "views")
    rows = N.normalize_view_by_reference(
        raw, "value", _reference_stats(obs, tces, hot), KEY, "value"
    )
    return tidy(rows.select(*KEY, "bin", "value"))


_CENTROID_SQL = f"""
    WITH {view_sql("v", *LOCAL, value="centroid_x")}, {RANKED_SPLIT_SQL},
    spread AS (SELECT stddev_pop(value) AS std FROM v WHERE target_id IN (
                 SELECT target_id FROM splits WHERE split = 'train'))"""


def _centroid(spark, sf):
    obs, tces, hot = _inputs(spark, sf)
    raw = materialize(V.folded_view(obs, tces, V.LOCAL_VIEW, {"value": "centroid_x"}, hot), "views")
    splits = ranked_split(tces.select("target_id").distinct(), 0.2, 0.3)
    return raw, N.views_std(raw, ["value"], splits.where(F.col("split") == "train"))


@query(
    "views_global_std",
    f"{_CENTROID_SQL} SELECT round(std, 6) AS value FROM spread",
    "obs tces",
)
def views_global_std(spark, sf):
    return tidy(_centroid(spark, sf)[1])


@query(
    "normalize_view_median_std",
    f"""
    {_CENTROID_SQL}
    SELECT target_id, tce_id, CAST(bin AS BIGINT) AS bin, round((value - median(value) OVER (
             PARTITION BY target_id, tce_id)) / std, 6) AS value
    FROM v, spread
    """,
    "obs tces",
)
def normalize_view_median_std(spark, sf):
    raw, std = _centroid(spark, sf)
    return tidy(N.normalize_view_by_std(raw, ["value"], std))


#: Views of one value, as (name, shape, SQL shape, column).
_PLAIN_VIEWS = (
    ("local_flux", V.LOCAL_VIEW, LOCAL, "flux"),
    ("global_flux", V.GLOBAL_VIEW, GLOBAL, "flux"),
    ("local_centroid_shift", V.LOCAL_VIEW, LOCAL, "centroid_x"),
    ("global_centroid_shift", V.GLOBAL_VIEW, GLOBAL, "centroid_x"),
)


def _named_views(spark, sf, names):
    """The raw views as (target_id, tce_id, view_name, view) rows."""
    obs, tces, hot = _inputs(spark, sf)
    parts = []
    for name, spec, _, column in _PLAIN_VIEWS:
        if name in names:
            rows = V.folded_view(obs, tces, spec, {"view": column}, hot)
            parts.append(V.view_arrays(rows, KEY, ["view"]).withColumn("view_name", F.lit(name)))
    if "odd_flux" in names:
        rows = V.odd_even_views(obs, tces, V.LOCAL_VIEW, "flux", hot).withColumnRenamed("value", "view")
        name = F.when(F.col("even"), "even_flux").otherwise("odd_flux")
        arrays = V.view_arrays(rows, [*KEY, "even"], ["view"])
        parts.append(arrays.select(*KEY, "view", name.alias("view_name")))
    if "secondary_flux" in names:
        rows = V.secondary_views(obs, tces, V.LOCAL_VIEW, "flux", hot).withColumnRenamed("value", "view")
        parts.append(V.view_arrays(rows, KEY, ["view"]).withColumn("view_name", F.lit("secondary_flux")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, tces


def _total_sql(view: str, name: str, where: str = "TRUE") -> str:
    # A missing bin is NaN in the arrays, and so is the total.
    value = "sum(coalesce(value, 'nan'::DOUBLE))"
    return f"{name}_t AS (SELECT target_id, tce_id, count(*) AS n, round({value}, 6) AS total FROM {view} WHERE {where} GROUP BY ALL)"


_PLAIN_SQL = ", ".join(
    f"{view_sql(name, *shape, value=column)}, {_total_sql(name, name)}" for name, _, shape, column in _PLAIN_VIEWS
)


def _total(name: str) -> F.Column:
    return F.round(F.aggregate(name, F.lit(0.0), lambda a, x: a + x), 6)


@query(
    "combine_views",
    f"""
    WITH {_PLAIN_SQL}
    SELECT l.target_id, l.tce_id, l.n AS n_local, g.n AS n_global, l.total AS local_total,
           g.total AS global_total, c.total AS centroid_total
    FROM local_flux_t l JOIN global_flux_t g USING (target_id, tce_id)
    JOIN local_centroid_shift_t c USING (target_id, tce_id)
    """,
    "obs tces",
)
def combine_views_query(spark, sf):
    names = ("global_flux", "local_centroid_shift", "local_flux")
    wide = combine_views(_named_views(spark, sf, names)[0], names)
    return wide.select(
        *KEY,
        F.size("local_flux").cast("long").alias("n_local"),
        F.size("global_flux").cast("long").alias("n_global"),
        _total("local_flux").alias("local_total"),
        _total("global_flux").alias("global_total"),
        _total("local_centroid_shift").alias("centroid_total"),
    )


_FEATURE_SCALARS = [f.name for f in FEATURES if f.name not in (*VIEW_NAMES, "id")]


def _feature_sql() -> str:
    special = {"tce_id": "t.tce_id", "tce_target_id": "t.target_id",
               "tce_label": "CAST(t.label = 'PC' AS BIGINT)", "tce_name": "t.name",
               "stellar_id": "s.id"}
    picks = [
        special.get(n)
        or ("round(" + n.replace("tce_", "t.", 1).replace("stellar_", "s.", 1) + ", 6)")
        for n in _FEATURE_SCALARS
    ]
    columns = ", ".join(f"{p} AS {n}" for p, n in zip(picks, _FEATURE_SCALARS, strict=True))
    totals = ", ".join(f"{n}_t.total AS {n}" for n in VIEW_NAMES)
    joins = " ".join(f"JOIN {n}_t ON {n}_t.target_id = t.target_id AND {n}_t.tce_id = t.tce_id" for n in VIEW_NAMES)
    return f"""
    WITH {_PLAIN_SQL}, {_PARITY_ROWS} {view_sql("p", *LOCAL, rows="parity_rows", key="even")},
    {_total_sql("p", "odd_flux", "NOT even")}, {_total_sql("p", "even_flux", "even")},
    {_SECONDARY_ROWS} {view_sql("q", *LOCAL, rows="second_rows", events="moved")}, {_total_sql("q", "secondary_flux")}
    SELECT t.target_id || '-' || t.tce_id AS id, {columns}, {totals}
    FROM tces t JOIN stellar s ON s.id = t.target_id {joins}
    """


@query("join_features", _feature_sql(), "obs tces stellar")
def join_features_query(spark, sf):
    named, tces = _named_views(spark, sf, VIEW_NAMES)
    rows = join_features(combine_views(named), tces, A.stellar(spark, sf))
    return tidy(rows.select("id", *_FEATURE_SCALARS, *[_total(n).alias(n) for n in VIEW_NAMES]))


@query("create_features")
def create_features_query(spark, sf):
    # The event table is a small table of its own, not a query over the observations.
    tces = materialize(A.tces(spark, sf), "tces")
    return create_features(A.observations(spark, sf), tces, A.stellar(spark, sf))
