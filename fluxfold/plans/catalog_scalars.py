"""Projections, mapping and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxfold.functions import periodic as P
from fluxfold.functions.labels import is_valid_target_id, label_to_int, map_label
from fluxfold.operators import mapping as M
from fluxfold.operators.lookups import table_request
from fluxfold.operators.masking import join_series_events
from fluxfold.operators.normalize import normalize_by_median
from fluxfold.plans import adapters as A
from fluxfold.plans.registry import cols, fold, query, tidy
from fluxfold.schemas import PLANET_UNITS, STELLAR_UNITS

_ALL_TCE = (
    "tce_id target_id name label ~epoch ~duration ~period ~secondary_phase "
    "~opt_ghost_core_aperture_corr ~opt_ghost_halo_aperture_corr ~bootstrap_false_alarm_proba "
    "~fitted_period ~radius ~rolling_band_fgt ~transit_depth ~secondary_transit_depth"
)
_ALL_STAR = (
    "id ~effective_temperature ~radius ~mass ~density ~surface_gravity ~metallicity"
)
_EVENT = ["target_id", "tce_id"]


@query(
    "map_time_series",
    f"SELECT {cols('target_id quarter ~time ~flux ~centroid_x ~centroid_y')} FROM obs",
    "obs",
)
def map_time_series(spark, sf):
    return tidy(M.explode_series(M.map_series(A.raw_series(spark, sf))).drop("seq"))


@query("map_stellar_parameters", f"SELECT {cols(_ALL_STAR)} FROM stellar", "stellar")
def map_stellar_parameters(spark, sf):
    return tidy(M.map_stellar(A.raw_stellar(spark, sf)))


@query("map_tce", f"SELECT {cols(_ALL_TCE)} FROM tces", "tces")
def map_tce(spark, sf):
    return tidy(M.map_tces(A.raw_tces(spark, sf)))


@query("map_tce_label", "SELECT target_id, tce_id, label FROM tces", "tces")
def map_tce_label(spark, sf):
    raw = A.raw_tces(spark, sf)
    return raw.select(
        F.col("kepid").alias("target_id"),
        F.col("tce_plnt_num").alias("tce_id"),
        map_label(F.col("label")).alias("label"),
    )


@query(
    "label_to_int",
    "SELECT target_id, tce_id, CAST(label = 'PC' AS BIGINT) AS label FROM tces",
    "tces",
)
def label_to_int_query(spark, sf):
    tces = A.tces(spark, sf)
    return tidy(tces.select(*_EVENT, label_to_int(F.col("label")).alias("label")))


@query("flatten_struct", f"SELECT {cols(_ALL_TCE.replace(' name', ''))} FROM tces", "tces")
def flatten_struct(spark, sf):
    return tidy(M.flatten_struct(M.map_tces_nested(A.raw_tces(spark, sf)), ["name"]))


@query(
    "key_by_columns",
    """
    SELECT a.target_id, a.tce_id, round(a.period, 6) AS period, b.label
    FROM tces a JOIN tces b ON a.target_id = b.target_id AND a.tce_id = b.tce_id
    """,
    "tces",
)
def key_by_columns(spark, sf):
    left = M.key_by(A.tces(spark, sf), _EVENT).select("key", *_EVENT, "period")
    right = M.key_by(A.tces(spark, sf), _EVENT).select("key", "label")
    return tidy(left.join(right, "key").drop("key"))


@query(
    "prefix_columns",
    """
    SELECT target_id || '-' || tce_id AS id, target_id AS tce_target_id, tce_id AS tce_tce_id,
           round(period, 6) AS tce_period, label AS tce_label
    FROM tces
    """,
    "tces",
)
def prefix_columns(spark, sf):
    rows = A.tces(spark, sf).select(*_EVENT, "period", "label")
    named = M.prefix_columns(rows, "tce")
    return tidy(named.withColumn("id", F.concat_ws("-", "tce_target_id", "tce_tce_id")))


@query(
    "valid_target_id",
    "SELECT user_id >= 1 AND user_id <= 999999999 AS valid, CAST(count(*) AS BIGINT) AS n "
    "FROM events GROUP BY 1",
)
def valid_target_id(spark, sf):
    rows = A.observations(spark, sf).select(is_valid_target_id(F.col("target_id")).alias("valid"))
    return rows.groupBy("valid").agg(F.count("*").alias("n"))


_DISTANCE = "sqrt(centroid_x * centroid_x + centroid_y * centroid_y)"
_SHIFTED = f"""
    SELECT *, {_DISTANCE} / median({_DISTANCE}) OVER (PARTITION BY target_id, quarter) AS shift
    FROM obs"""


@query(
    "compose_transforms",
    f"SELECT {cols('target_id quarter seq ~shift')} FROM ({_SHIFTED})",
    "obs",
)
def compose_transforms(spark, sf):
    steps = M.compose(
        lambda df: df.withColumn("d", P.centroid_distance(F.col("centroid_x"),
                                                          F.col("centroid_y"))),
        lambda df: normalize_by_median(df, ["target_id", "quarter"], "d", "shift"),
    )
    return tidy(
        A.observations(spark, sf).transform(steps).select("target_id", "quarter", "seq", "shift")
    )


@query(
    "pluggable_transforms",
    """
    SELECT target_id, quarter, CAST(count(*) AS BIGINT) AS n, round(max(flux), 6) AS top
    FROM obs WHERE flux > 10 GROUP BY ALL
    """,
    "obs",
)
def pluggable_transforms(spark, sf):
    def bright(df):
        return df.where(F.col("flux") > 10)

    def summary(df):
        return df.groupBy("target_id", "quarter").agg(
            F.count("*").alias("n"), F.max("flux").alias("top")
        )

    return tidy(A.observations(spark, sf).transform(M.compose(bright, summary)))


def _card_sql(table: str, key: str, fields: list[str], units: dict[str, str]) -> str:
    parts = []
    for field in fields:
        unit = f"'{units[field]}'" if field in units else "CAST(NULL AS VARCHAR)"
        # Through text, so that the shortest decimal form is what gets rounded.
        exact = f"CAST(CAST({field} AS VARCHAR) AS DECIMAL(38, 18))"
        parts.append(
            f"SELECT {key}, '{field}' AS field, CAST(round({exact}, 4) AS DOUBLE) AS value, "
            f"{unit} AS unit FROM {table}"
        )
    return " UNION ALL ".join(parts)


_PLANET_FIELDS = ["epoch", "duration", "period", "radius", "fitted_period", "transit_depth",
                  "secondary_phase"]
_CARD = (
    "SELECT 'star' AS kind, CAST(id AS VARCHAR) AS entity, field, value, unit FROM ("
    + _card_sql("stellar", "id", list(STELLAR_UNITS), STELLAR_UNITS)
    + ") UNION ALL SELECT 'planet', entity, field, value, unit FROM ("
    + _card_sql("named", "entity", _PLANET_FIELDS, PLANET_UNITS)
    + ")"
)


@query(
    "parameter_card",
    "WITH named AS (SELECT *, target_id || '-' || tce_id AS entity FROM tces) " + _CARD,
    "stellar tces",
)
def parameter_card(spark, sf):
    stars = M.parameter_card(A.stellar(spark, sf), "id", STELLAR_UNITS)
    planets = A.tces(spark, sf).select(
        F.concat_ws("-", *_EVENT).alias("entity"), *_PLANET_FIELDS
    )
    cards = M.parameter_card(planets, "entity", PLANET_UNITS)
    star_rows = stars.select(F.lit("star").alias("kind"),
                             F.col("id").cast("string").alias("entity"),
                             "field", "value", "unit")
    return star_rows.unionByName(cards.withColumn("kind", F.lit("planet")))


@query(
    "table_request",
    "SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM customer "
    "WHERE c_mktsegment = 'BUILDING'",
)
def table_request_query(spark, sf):
    request = {
        "columns": [" c_custkey", "c_name ", "c_acctbal"],
        "query": " c_mktsegment = 'BUILDING' ",
        "order": ["c_acctbal", "c_custkey"],
    }
    return tidy(table_request(A.table(spark, sf, "customer"), **request))


@query(
    "euclidean_distance",
    f"SELECT target_id, seq, round({_DISTANCE}, 6) AS distance FROM obs",
    "obs",
)
def euclidean_distance(spark, sf):
    distance = P.centroid_distance(F.col("centroid_x"), F.col("centroid_y"))
    return tidy(
        A.observations(spark, sf).select("target_id", "seq", distance.alias("distance"))
    )


@query(
    "centroid_shift",
    f"""
    SELECT target_id, quarter, round(avg({_DISTANCE}), 6) AS mean_shift,
           round(max({_DISTANCE}), 6) AS max_shift
    FROM obs GROUP BY ALL
    """,
    "obs",
)
def centroid_shift(spark, sf):
    shift = P.centroid_distance(F.col("centroid_x"), F.col("centroid_y"))
    rows = A.observations(spark, sf).withColumn("shift", shift)
    return tidy(
        rows.groupBy("target_id", "quarter").agg(
            F.avg("shift").alias("mean_shift"), F.max("shift").alias("max_shift")
        )
    )


@query(
    "phase_fold",
    f"""
    SELECT o.target_id, t.tce_id, o.seq,
           round({fold('o."time"', "t.epoch", "t.period")}, 6) AS folded
    FROM obs o JOIN tces t ON t.target_id = o.target_id
    """,
    "obs tces",
)
def phase_fold(spark, sf):
    rows = join_series_events(A.observations(spark, sf), A.tces(spark, sf))
    folded = P.phase_fold(F.col("time"), F.col("epoch"), F.col("period"))
    return tidy(rows.select(*_EVENT, "seq", folded.alias("folded")))


def _per_event(name: str, sql: str, expressions) -> None:
    """Register a query of expressions over the event table."""

    @query(name, f"SELECT target_id, tce_id, {sql} FROM tces", "tces")
    def run(spark, sf):
        args = [F.col(c) for c in ("period", "duration", "secondary_phase")]
        return tidy(A.tces(spark, sf).select(*_EVENT, *expressions(*args)))


_per_event(
    "event_width_adjusted",
    "round(least(3 * duration, abs(secondary_phase), period), 6) AS width",
    lambda p, d, s: [P.width_adjusted(p, d, s).alias("width")],
)
_per_event(
    "event_width_secondary",
    "round(CASE WHEN duration < abs(secondary_phase - 2) THEN 3 * duration "
    "ELSE abs(secondary_phase - 2) + duration END, 6) AS width",
    lambda p, d, s: [P.width_secondary(p, d, s - F.lit(2.0)).alias("width")],
)
_per_event(
    "local_view_bounds",
    "round(greatest(-period / 2, -duration * 2.5), 6) AS low, "
    "round(least(period / 2, duration * 2.5), 6) AS high",
    lambda p, d, s: [c.alias(n) for n, c in zip(("low", "high"), P.local_bounds(2.5)(p, d))],
)
_per_event(
    "global_view_bounds",
    "round(-period / 2, 6) AS low, round(period / 2, 6) AS high",
    lambda p, d, s: [c.alias(n) for n, c in zip(("low", "high"), P.global_bounds(p, d))],
)
_per_event(
    "local_view_bin_width",
    "round(duration * 0.16, 6) AS width",
    lambda p, d, s: [P.local_bin_width(0.16)(p, d).alias("width")],
)
_per_event(
    "global_view_bin_width",
    "round(greatest(period / 301, duration * 0.16), 6) AS width",
    lambda p, d, s: [P.global_bin_width(301, 0.16)(p, d).alias("width")],
)


@query(
    "secondary_events",
    """
    SELECT target_id, tce_id, round(epoch + secondary_phase, 6) AS epoch,
           round(duration, 6) AS duration, round(period, 6) AS period,
           CAST(NULL AS DOUBLE) AS secondary_phase
    FROM tces
    """,
    "tces",
)
def secondary_events(spark, sf):
    moved = M.secondary_events(A.tces(spark, sf))
    return tidy(moved.select(*_EVENT, "epoch", "duration", "period", "secondary_phase"))


@query(
    "bic_score",
    """
    SELECT target_id, quarter,
           round(n * ln(2 * pi() * (sigma + 1e-6) * (sigma + 1e-6))
                 + ssr / ((sigma + 1e-6) * (sigma + 1e-6)) + 0.5 * 3 * ln(n), 4) AS score
    FROM (SELECT target_id, quarter, count(*) AS n, stddev_pop(flux) AS sigma,
                 var_pop(flux) * count(*) AS ssr
          FROM obs GROUP BY ALL) WHERE sigma > 0
    """,
    "obs",
)
def bic_score(spark, sf):
    stats = A.observations(spark, sf).groupBy("target_id", "quarter").agg(
        F.count("*").alias("n"),
        F.stddev_pop("flux").alias("sigma"),
        (F.var_pop("flux") * F.count("*")).alias("ssr"),
    )
    score = P.bic(3, F.col("n"), F.col("sigma"), F.col("ssr"), 0.5)
    return stats.where(F.col("sigma") > 0).select(
        "target_id", F.col("quarter").cast("long").alias("quarter"), F.round(score, 4)
        .alias("score")
    )
