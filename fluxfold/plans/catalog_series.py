"""Series operators: masks, gaps, windows, robust statistics and detrending."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fluxfold.operators import detrend as D
from fluxfold.operators import normalize as N
from fluxfold.operators import segments as G
from fluxfold.operators.masking import (
    flag_events,
    mark_transits,
    mask_events,
    mask_segments,
    split_odd_even,
)
from fluxfold.operators.skew import find_hot_keys, join_per_key
from fluxfold.operators.views import secondary_rows
from fluxfold.plans import adapters as A
from fluxfold.plans.catalog_tables import MARKS_SQL
from fluxfold.plans.registry import cols, fold, query, tidy
from fluxfold.plans.sqltext import COVERED, SEGMENTS_SQL
from fluxfold.schemas import KNOT_SPACINGS
from fluxfold.session import materialize

_KEY = ["target_id", "quarter", "seq"]
_FOLD = fold('o."time"', "t.epoch", "t.period")


def _obs(spark, sf):
    obs = A.observations(spark, sf)
    return obs, find_hot_keys(obs, ["target_id"], "time")


@query(
    "mask_events",
    f"SELECT target_id, quarter, seq, round(flux, 6) AS flux FROM obs o WHERE NOT {COVERED}",
    "obs tces",
)
def mask_events_query(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = mask_events(obs, A.tces(spark, sf), hot=hot)
    return tidy(rows.select(*_KEY, "flux"))


@query(
    "mask_events_segments",
    f"""
    WITH {SEGMENTS_SQL}
    SELECT target_id, quarter, segment_id,
           CAST(count(*) FILTER (NOT {COVERED}) AS BIGINT) AS n_left
    FROM segments o GROUP BY ALL
    """,
    "obs tces",
)
def mask_events_segments(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = G.split_at_gaps(obs, hot=hot)
    return tidy(mask_segments(rows, mask_events(rows, A.tces(spark, sf), hot=hot)))


@query(
    "split_at_gaps",
    f"WITH {SEGMENTS_SQL} SELECT target_id, quarter, seq, segment_id FROM segments",
    "obs",
)
def split_at_gaps(spark, sf):
    obs, hot = _obs(spark, sf)
    return tidy(G.split_at_gaps(obs, 0.75, hot).select(*_KEY, "segment_id"))


_DIFFS_SQL = f"""{SEGMENTS_SQL},
    diffs AS (
      SELECT target_id, quarter, segment_id, seq,
             (flux - lag(flux) OVER w) / 1.4142135623730951::DOUBLE AS diff,
             row_number() OVER w AS rn
      FROM segments
      WINDOW w AS (PARTITION BY target_id, quarter, segment_id ORDER BY "time", seq)
    )"""


@query(
    "scaled_diffs",
    f"WITH {_DIFFS_SQL} SELECT target_id, quarter, seq, round(diff, 6) AS diff FROM diffs "
    "WHERE rn > 1",
    "obs",
)
def scaled_diffs(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = G.scaled_diffs(G.split_at_gaps(obs, hot=hot), "flux", D.SQRT_2, hot)
    return tidy(rows.select(*_KEY, "diff"))


@query(
    "mad_sigma",
    f"""
    WITH {_DIFFS_SQL},
    centred AS (SELECT target_id, abs(diff - median(diff) OVER (PARTITION BY target_id)) AS dev
                FROM diffs WHERE rn > 1)
    SELECT target_id, round(median(dev) / 0.6744897501960817::DOUBLE, 6) AS sigma
    FROM centred GROUP BY 1
    """,
    "obs",
)
def mad_sigma(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = G.scaled_diffs(G.split_at_gaps(obs, hot=hot), "flux", D.SQRT_2, hot)
    return tidy(N.mad_sigma(rows, ["target_id"], hot=hot))


@query(
    "interpolate_masked",
    f"""
    WITH {SEGMENTS_SQL},
    flagged AS (SELECT *, {COVERED} AS masked FROM segments o),
    near AS (
      SELECT *,
        max(CASE WHEN NOT masked THEN struct_pack(t := "time", s := seq, v := flux) END) OVER (
          w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
        min(CASE WHEN NOT masked THEN struct_pack(t := "time", s := seq, v := flux) END) OVER (
          w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
      FROM flagged
      WINDOW w AS (PARTITION BY target_id, quarter, segment_id ORDER BY "time", seq)
    )
    SELECT target_id, quarter, seq, round(CASE
        WHEN NOT masked THEN flux WHEN l IS NULL THEN r.v WHEN r IS NULL THEN l.v
        WHEN r.t = l.t THEN l.v
        ELSE l.v + (r.v - l.v) / (r.t - l.t) * ("time" - l.t) END, 6) AS interpolated
    FROM near
    """,
    "obs tces",
)
def interpolate_masked(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = G.split_at_gaps(flag_events(obs, A.tces(spark, sf), hot=hot), hot=hot)
    filled = G.interpolate_masked(rows, {"interpolated": "flux"}, hot=hot)
    return tidy(filled.select(*_KEY, "interpolated"))


@query(
    "mark_transits",
    f"WITH {MARKS_SQL} SELECT target_id, quarter, seq, transit FROM marks",
    "obs tces",
)
def mark_transits_query(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = mark_transits(obs.select(*_KEY, "time"), A.tces(spark, sf), hot=hot)
    return tidy(rows.select(*_KEY, "transit"))


@query(
    "period_edges",
    """
    WITH e AS (
      SELECT target_id, quarter, "time",
             lead(quarter) OVER (PARTITION BY target_id ORDER BY quarter, "time", seq) AS next
      FROM obs
    )
    SELECT target_id, quarter, round("time", 6) AS edge_time, next AS next_quarter
    FROM e WHERE next <> quarter
    """,
    "obs",
)
def period_edges(spark, sf):
    return tidy(G.period_edges(A.observations(spark, sf)))


@query(
    "split_odd_even",
    """
    SELECT o.target_id, t.tce_id, o.seq,
           greatest(0, CAST(floor((o."time" - (t.epoch + t.period / 2.0::DOUBLE)) / t.period)
                            AS BIGINT) + 1) % 2 = 1 AS even
    FROM obs o JOIN tces t ON t.target_id = o.target_id
    """,
    "obs tces",
)
def split_odd_even_query(spark, sf):
    obs, hot = _obs(spark, sf)
    return split_odd_even(obs, A.tces(spark, sf), hot).select("target_id", "tce_id", "seq", "even")


@query(
    "secondary_series",
    f"""
    SELECT o.target_id, t.tce_id, round(o."time", 6) AS "time", round(o.flux, 6) AS flux
    FROM obs o JOIN tces t ON t.target_id = o.target_id
    WHERE abs({_FOLD}) > 0.5 * CASE WHEN t.duration < abs(t.secondary_phase)
      THEN t.duration * 3.0::DOUBLE ELSE abs(t.secondary_phase) + t.duration END
    """,
    "obs tces",
)
def secondary_series(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = secondary_rows(obs, A.tces(spark, sf), "flux", hot=hot)
    return tidy(rows.select("target_id", "tce_id", "time", "flux"))


@query(
    "normalize_by_median",
    """
    SELECT target_id, quarter, seq,
           round(flux / median(flux) OVER (PARTITION BY target_id, quarter), 6) AS normalized
    FROM obs
    """,
    "obs",
)
def normalize_by_median(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = N.normalize_by_median(obs, ["target_id", "quarter"], "flux", hot=hot)
    return tidy(rows.select(*_KEY, "normalized"))


_ROBUST_SQL = """
    r1 AS (SELECT *, abs(flux - median(flux) OVER (PARTITION BY target_id)) AS dev FROM obs),
    r2 AS (
      SELECT *, CASE WHEN abs(mad / 0.67449::DOUBLE) <= 1e-8 THEN mean_dev * 1.253::DOUBLE
                     ELSE mad / 0.67449::DOUBLE END AS sigma0
      FROM (SELECT *, median(dev) OVER (PARTITION BY target_id) AS mad,
                   avg(dev) OVER (PARTITION BY target_id) AS mean_dev FROM r1)
    ),
    r3 AS (SELECT *, stddev_pop(CASE WHEN dev <= sigma0 * 2 THEN flux END)
                       OVER (PARTITION BY target_id) / {c} AS sigma1 FROM r2),
    robust AS (
      SELECT target_id, avg(flux) FILTER (dev <= sigma1 * 2) AS mean,
             stddev_pop(flux) FILTER (dev <= sigma1 * 2) / {c} / sqrt(count(*) - 1.0) AS mean_std,
             CAST(count(*) FILTER (dev <= sigma1 * 2) AS BIGINT) AS n_kept
      FROM r3 GROUP BY target_id
    )""".format(c="(-0.15405 + 0.90723 * 2 - 0.23584 * 4 + 0.020142 * 8)::DOUBLE")


@query(
    "robust_mean",
    f"WITH {_ROBUST_SQL} SELECT target_id, round(mean, 9) AS mean, round(mean_std, 9) AS mean_std, "
    "n_kept FROM robust",
    "obs",
)
def robust_mean(spark, sf):
    obs, hot = _obs(spark, sf)
    _, stats = N.robust_rows(obs, ["target_id"], "flux", 2.0, hot)
    # Nine digits: a mean of cents over 32 values ends in a tie at six.
    rounded = [F.round(c, 9).alias(c) for c in ("mean", "mean_std")]
    return stats.select("target_id", *rounded, "n_kept")


_SPACING_ROWS = ", ".join(f"({i}, {float(s)!r}::DOUBLE)" for i, s in enumerate(KNOT_SPACINGS))


@query(
    "fit_segment_spline",
    f"""
    WITH {SEGMENTS_SQL},
    spans AS (
      SELECT target_id, quarter, segment_id, count(*) AS n_rows, min("time") AS low, max("time") AS high
      FROM segments GROUP BY ALL
    )
    SELECT target_id, quarter, segment_id, CAST(id AS BIGINT) AS spacing_id,
           CASE WHEN n_rows <= 3 THEN 'insufficient' ELSE 'tried' END AS status,
           CAST(greatest(0, ceil((high - (low + spacing)) / spacing)) AS BIGINT) AS n_knots,
           n_rows AS n_accounted, 0.0::DOUBLE AS imbalance
    FROM spans, (VALUES {_SPACING_ROWS}) v(id, spacing)
    """,
    "obs",
)
def fit_segment_spline(spark, sf):
    """What SQL can state of the fits: which segments are too short, how many knots there are, that
    every row is used or rejected, and that the residuals meet the normal equations - their sums
    with 1, t, t^2, t^3 and with the cubes behind the first and the last knot are zero."""
    obs, hot = _obs(spark, sf)
    rows = materialize(G.split_at_gaps(obs, hot=hot).select(*G.SEGMENT, "seq", "time", "flux"), "segments")
    return _checked_fits(rows, *D.fit_and_reject(rows, ["flux"], shared=True), hot)


def _checked_fits(rows, fits, rejected, hot):
    """A row per fit and spacing. A fit that spacings share is checked once: its sums and what they
    are compared with scale alike. Rows carry the numbers of the fits that reject them, so a row
    meets all fits of its segment in one join, and the sums need no further exchange."""
    out = rejected.groupBy(*G.SEGMENT, "seq").agg(F.collect_set("spacing_id").alias("out"))
    marked = rows.join(out, [*G.SEGMENT, "seq"], "left")
    number = F.element_at("spacing_ids", 1)
    spacing = D.spacing_of(number)
    knot = F.coalesce(F.col("first_knot"), F.col("first") + spacing)
    piece = F.struct(spacing.alias("spacing"), "n_knots", "low", knot.alias("first_knot"), "pieces").alias("fit")
    kept = ["spacing_ids", "status", "n_knots", "first", "first_knot", "n_points", "n_rejected"]
    each = join_per_key(marked, fits.select(*G.SEGMENT, *kept, piece), G.SEGMENT, hot)
    used = (F.col("status") == "ok") & ~F.coalesce(F.array_contains("out", number), F.lit(False))
    each = each.withColumn("residual", F.when(used, F.col("flux") - D.fit_value(F.col("fit"), 3)))
    at = (F.col("time") - F.col("fit.low")) / F.col("fit.spacing")
    knot = (F.col("fit.first_knot") - F.col("fit.low")) / F.col("fit.spacing")
    last = knot + F.col("fit.n_knots") - 1
    # Powers of the part of a knot grid, by the largest of them, so sums of long segments compare.
    terms = [at**p for p in range(4)]
    terms += [F.when((F.col("fit.n_knots") > 0) & (at > k), (at - k) ** 3).otherwise(0.0) for k in (knot, last)]
    sums = each.groupBy(*G.SEGMENT, *kept).agg(
        F.count("*").alias("n_rows"),
        F.max("time").alias("high"),
        F.greatest(*[
            F.abs(F.sum(F.col("residual") * t))
            / F.greatest(F.sum(F.when(used, F.abs(F.col("flux") * t))), F.lit(1e-300))
            for t in terms
        ]).alias("imbalance"),
    )
    spaced = sums.withColumn("spacing_id", F.explode("spacing_ids"))
    spaced = spaced.withColumn("spacing", D.spacing_of(F.col("spacing_id")))
    first_knot = F.coalesce(F.col("first_knot"), F.col("first") + F.col("spacing"))
    expected = F.greatest(F.lit(0), F.ceil((F.col("high") - first_knot) / F.col("spacing")))
    ok = F.col("status") == "ok"
    return spaced.select(
        *[F.col(c).cast("long").alias(c) for c in (*G.SEGMENT, "spacing_id")],
        F.when(F.col("n_rows") <= 3, F.col("status")).otherwise("tried").alias("status"),
        F.when(F.col("status") == "insufficient", expected).otherwise(F.col("n_knots")).cast("long").alias("n_knots"),
        F.when(ok, F.col("n_points") + F.col("n_rejected")).otherwise(F.col("n_rows")).alias("n_accounted"),
        F.round(F.coalesce("imbalance", F.lit(0.0)), 4).alias("imbalance"),
    )


@query("select_best_spline")
def select_best_spline(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = G.split_at_gaps(obs, hot=hot)
    sigma = D.noise_levels(G.scaled_diffs(rows, "flux", D.SQRT_2, hot), ["diff"], hot)
    scores = D.score_spacings(D.fit_segment_splines(rows, ["flux"]), sigma)
    return tidy(D.select_best_spacing(scores))


@query(
    "flatten_series",
    "SELECT target_id, quarter, seq, round(flux, 6) AS flux, TRUE AS divided FROM obs",
    "obs",
)
def flatten_series(spark, sf):
    """Every row once, and its flux again as the flat value times the trend; a row without a flat
    value is of a target that no spacing fits, or lies in a segment too short for a fit."""
    obs, hot = _obs(spark, sf)
    rows = D.flatten_series(obs, A.tces(spark, sf), {"flat_flux": "flux"}, hot=hot, trends=True)
    back = F.coalesce(F.col("flat_flux") * F.col("flat_flux_trend"), F.col("flux"))
    missing = F.col("flat_flux").isNull() & (F.col("flat_flux_trend") != 0)
    divided = F.coalesce(~missing, F.lit(True)) & F.col("flat_flux_status").isin("ok", "no_fit")
    return tidy(rows.select(*_KEY, back.alias("flux"), divided.alias("divided")))


def _segment_mean(rows, value):
    # The values are cents: a decimal sum is exact, whatever the order of partial sums.
    exact = F.sum(F.col(value).cast("decimal(28,2)")).cast("double")
    means = rows.groupBy(*G.SEGMENT).agg((exact / F.count(value)).alias("trend"))
    return rows.join(means, G.SEGMENT)


@query(
    "pluggable_detrender",
    f"""
    WITH {SEGMENTS_SQL}
    SELECT target_id, quarter, seq, round(flux / (
             CAST(sum(CAST(flux AS DECIMAL(28, 2))) OVER w AS DOUBLE) / count(flux) OVER w), 6) AS flat
    FROM segments
    WINDOW w AS (PARTITION BY target_id, quarter, segment_id)
    """,
    "obs",
)
def pluggable_detrender(spark, sf):
    obs, hot = _obs(spark, sf)
    rows = D.detrend_with(G.split_at_gaps(obs, hot=hot), "flux", _segment_mean, "flat")
    return tidy(rows.select(*_KEY, "flat"))


_PIECE, _HALO = 8, 2


def _cents_mean(x, y):
    # The values are cents: whole numbers add up exactly in any order.
    return np.full(y.size, np.rint(y * 100).sum() / 100 / y.size)


@query(
    "pluggable_detrender_pieces",
    f"""
    WITH {SEGMENTS_SQL},
    numbered AS (
      SELECT target_id, quarter, segment_id, seq, flux, row_number() OVER s - 0.5::DOUBLE AS place,
             count(*) OVER (PARTITION BY target_id, quarter, segment_id) AS n
      FROM segments
      WINDOW s AS (PARTITION BY target_id, quarter, segment_id ORDER BY "time", seq)
    ),
    cut AS (SELECT *, CAST(ceil(n / {_PIECE}::DOUBLE) AS BIGINT) AS parts FROM numbered),
    sized AS (SELECT *, n / CAST(parts AS DOUBLE) AS width FROM cut),
    seen AS (
      SELECT *, unnest(range(
               greatest(0, CAST(floor((place - {_HALO}) / width) AS BIGINT)),
               least(parts - 1, CAST(floor((place + {_HALO}) / width) AS BIGINT)) + 1)) AS part
      FROM sized
    ),
    fitted AS (
      SELECT *, CAST(sum(CAST(flux AS DECIMAL(28, 2))) OVER p AS DOUBLE) / count(*) OVER p AS trend,
             least(1, greatest(0, least(
               CASE WHEN part > 0 THEN (place - part * width + {_HALO}) / {2.0 * _HALO} ELSE 1 END,
               CASE WHEN part < parts - 1 THEN ((part + 1) * width + {_HALO} - place) / {2.0 * _HALO}
                    ELSE 1 END))) AS w
      FROM seen
      WINDOW p AS (PARTITION BY target_id, quarter, segment_id, part)
    )
    SELECT target_id, quarter, seq, round(max(flux) / (sum(w * trend) / sum(w)), 6) AS flat
    FROM fitted GROUP BY target_id, quarter, seq
    """,
    "obs",
)
def pluggable_detrender_pieces(spark, sf):
    """The same by a numpy function that sees one bounded, overlapping piece at a time."""
    obs, hot = _obs(spark, sf)
    trend = D.piecewise_trend(_cents_mean, _PIECE, _HALO, hot)
    rows = D.detrend_with(G.split_at_gaps(obs, hot=hot), "flux", trend, "flat")
    return tidy(rows.select(*_KEY, "flat"))
