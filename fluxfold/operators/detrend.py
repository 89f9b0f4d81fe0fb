"""Detrending: spline fits per segment, choice of the knot spacing per target, flattening.

The fit of a segment is the only step outside the JVM: rows stream through Arrow sorted by
segment, so a task holds one long segment or a group of short ones, fitted in one stack, at a
time. Everything else - the noise level, the choice
among the spacings, the evaluation of the chosen spline - is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxfold.functions.batched import fit_segments
from fluxfold.functions.periodic import EventWidth, bic, width_adjusted
from fluxfold.functions.spline import (
    SegmentFit,
    cell_distance,
    cell_value,
    fit_segment,
    piece_cell,
    piecewise_value,
)
from fluxfold.operators.large_segments import fit_large_segments
from fluxfold.operators.masking import flag_events
from fluxfold.operators.normalize import mad_sigma
from fluxfold.operators.ordered import with_previous, with_running_sum
from fluxfold.operators.segments import (
    ORDER,
    SEGMENT,
    interpolate_masked,
    split_at_gaps,
)
from fluxfold.operators.skew import HotKeys, join_per_key, maybe_broadcast
from fluxfold.schemas import KNOT_SPACINGS
from fluxfold.session import materialize

SQRT_2 = 1.4142135623730951
# Rows of a segment that one task may hold.
SEGMENT_ROWS = 500_000
# Segments of at most so many rows are fitted together, about this many rows at a time.
SHORT_ROWS = 200
TOGETHER_ROWS = 25_000
# Rows of the trends that are handed on as one frame, about.
FRAME_ROWS = 50_000

# A fit is one row, also where several spacings have it in common.
FIT_SCHEMA = (
    "target_id long, quarter int, segment_id long, series int, spacing_ids array<int>, status string, "
    "n_knots int, low double, first double, n_points long, ssr double, "
    "pieces array<double>, rejected array<long>"
)


@dataclass(frozen=True)
class SplineSpec:
    spacings: tuple[float, ...] = KNOT_SPACINGS
    k: int = 3
    max_iter: int = 5
    sigma_cut: float = 3.0
    penalty: float = 1.0

    def __post_init__(self) -> None:
        if not self.spacings:
            raise ValueError("at least one knot spacing is needed")
        if min(self.spacings) <= 0:
            raise ValueError("knot spacings must be > 0")
        if self.max_iter < 1:
            raise ValueError(f"max_iter must be >= 1, got {self.max_iter}")
        if not 1 <= self.k <= 5:
            raise ValueError(f"k must be in [1, 5], got {self.k}")
        if self.sigma_cut <= 0:
            raise ValueError(f"sigma_cut must be > 0, got {self.sigma_cut}")


def _segments(
    batches: Iterator[pd.DataFrame], limit: int = SEGMENT_ROWS, by: list[str] = SEGMENT
) -> Iterator[tuple]:
    """Whole segments (key, seq, time, values...) from sorted batches; holds the last one only."""
    key, parts = None, []

    def whole() -> tuple:
        return (key, *(np.concatenate(column) for column in zip(*parts, strict=True)))

    for batch in batches:
        if batch.empty:
            continue
        keys = batch[by].to_numpy()
        values = [batch[c].to_numpy(float) for c in batch.columns if c.startswith("_y")]
        columns = [batch["seq"].to_numpy(), batch["time"].to_numpy(float), *values]
        starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        bounds = [0, *starts.tolist(), len(keys)]
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            here = tuple(keys[begin].tolist())
            if key is not None and here != key:
                yield whole()
                parts = []
            key = here
            parts.append([c[begin:end] for c in columns])
            if sum(len(p[0]) for p in parts) > limit:
                raise ValueError(f"segment {key} has more than {limit} rows")
    if key is not None:
        yield whole()


def _fitter(spec: SplineSpec, listed: bool = True) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The fits of sorted rows; ``listed`` with the rows they reject."""
    names = [c.split()[0] for c in FIT_SCHEMA.split(", ")]

    def fits_of(curves: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
        """For each curve (times, values) its different fits with the numbers of their spacings."""
        out: list[list[tuple]] = [[] for _ in curves]
        flat: dict[int, list[int]] = {}
        for number, spacing in enumerate(spec.spacings):
            # All spacings wider than a segment give the same knot-free fit.
            wide = [x[0] + spacing >= x[-1] for x, _ in curves]
            todo = []
            for i, w in enumerate(wide):
                if w and i in flat:
                    flat[i].append(number)
                else:
                    todo.append(i)
            some = [curves[i] for i in todo]
            if len(some) > 1:
                new = fit_segments(some, spacing, spec.k, spec.max_iter, spec.sigma_cut)
            else:
                new = [fit_segment(x, y, spacing, spec.k, spec.max_iter, spec.sigma_cut) for x, y in some]
            for i, fit in zip(todo, new, strict=True):
                out[i].append(([number], fit))
                if wide[i]:
                    flat[i] = out[i][-1][0]
        return out

    def rows_of(group: list[tuple]) -> pd.DataFrame:
        """All fits of some segments (key, seq, times, values...); their series go together."""
        count = len(group[0]) - 3
        members = [(segment, series) for segment in group for series in range(count)]
        found = fits_of([(segment[2], segment[3 + series]) for segment, series in members])
        rows = [
            (*segment[0], series, ids, fit.status, fit.n_knots, fit.low, segment[2][0], fit.n_points, fit.ssr,
             None if fit.pieces is None else fit.pieces.ravel(),
             None if fit.rejected is None or not listed else segment[1][fit.rejected])
            for (segment, series), fits in zip(members, found, strict=True) for ids, fit in fits
        ]
        return pd.DataFrame(rows, columns=names)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        rows = 0
        for segment in _segments(batches):
            if len(segment[1]) > SHORT_ROWS:
                yield rows_of([segment])
                continue
            group.append(segment)
            rows += len(segment[1])
            if rows >= TOGETHER_ROWS:
                yield rows_of(group)
                group, rows = [], 0
        if group:
            yield rows_of(group)

    return fit


def _by_segment(named: DataFrame) -> DataFrame:
    # A fixed number of partitions: few bytes per row, but much work, so no coalescing.
    tasks = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(tasks, *SEGMENT).sortWithinPartitions(*SEGMENT, *ORDER)


def spacing_of(number: Column, spec: SplineSpec = SplineSpec()) -> Column:
    """The knot spacing of a number."""
    return F.element_at(F.array(*[F.lit(float(d)) for d in spec.spacings]), number + 1)


def _spaced(fits: DataFrame, spec: SplineSpec) -> DataFrame:
    """One row per fit and spacing."""
    each = fits.withColumn("spacing_id", F.explode("spacing_ids"))
    return each.withColumn("spacing", spacing_of(F.col("spacing_id"), spec)).drop("spacing_ids")


def _exploded(fits: DataFrame, spec: SplineSpec) -> tuple[DataFrame, DataFrame]:
    """Fits, and their rejected rows one by one; an in-task list is no longer than its segment."""
    spaced = _spaced(fits, spec).withColumn("first_knot", F.col("first") + F.col("spacing"))
    rows = spaced.select(*SEGMENT, "series", "spacing_id", F.explode("rejected").alias("seq"))
    columns = [*SEGMENT, "series", "spacing_id", "spacing", "status", "n_knots", "low", "first_knot", "n_points", "ssr", "pieces"]
    return spaced.select(*columns), rows


def _named(rows: DataFrame, values: list[str]) -> DataFrame:
    columns = [F.col(v).cast("double").alias(f"_y{i}") for i, v in enumerate(values)]
    return rows.select(*SEGMENT, *ORDER, *columns)


def _long_segments(rows: DataFrame, segment_rows: int) -> DataFrame | None:
    """The segments of more than ``segment_rows`` rows; None if there are none."""
    if rows.count() <= segment_rows:
        return None
    large = materialize(
        rows.groupBy(*SEGMENT)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > segment_rows),
        "long_segment_keys",
    )
    # At most (rows / segment_rows) keys.
    return None if large.isEmpty() else large


def _fits(
    rows: DataFrame, values: list[str], spec: SplineSpec, segment_rows: int, listed: bool = True
) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The fits of the segments that a task may hold, and for each series those of the longer ones
    with the rows they reject."""
    named = _named(rows, values)
    large = _long_segments(rows, segment_rows)
    if large is None:
        return _by_segment(named).mapInPandas(_fitter(spec, listed), FIT_SCHEMA), []
    keys = maybe_broadcast(large.select(*SEGMENT), large.count())
    short = named.join(keys, SEGMENT, "left_anti")
    long = []
    for i in range(len(values)):
        one = named.select(*SEGMENT, "seq", "time", F.col(f"_y{i}").alias("_y"))
        found = fit_large_segments(one, large, spec, segment_rows)
        long.append(tuple(part.withColumn("series", F.lit(i)) for part in found))
    return _by_segment(short).mapInPandas(_fitter(spec, listed), FIT_SCHEMA), long


def common_fits(
    rows: DataFrame, values: list[str], spec: SplineSpec, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """The fits of ``fit_and_reject``; one that several spacings have in common is one row.

    ``spacing_ids`` has the numbers of the spacings, and ``first_knot`` is NULL where it is the
    spacing after ``first``, the first time of the segment.
    """
    short, long = _fits(rows, values, spec, segment_rows, listed=False)
    fits = short.drop("rejected").withColumn("first_knot", F.lit(None).cast("double"))
    for split, _ in long:
        fits = fits.unionByName(_alone(split))
    return fits


def _alone(split: DataFrame) -> DataFrame:
    """Fits of long segments, which no spacings have in common, in the shape of the shared ones."""
    alone = split.withColumn("spacing_ids", F.array("spacing_id")).drop("spacing_id", "spacing")
    return alone.withColumn("first", F.lit(None).cast("double"))


def fit_segment_splines(
    rows: DataFrame, values: list[str], spec: SplineSpec = SplineSpec(),
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The fits of ``fit_and_reject`` alone."""
    return fit_and_reject(rows, values, spec, segment_rows)[0]


def fit_and_reject(
    rows: DataFrame, values: list[str], spec: SplineSpec = SplineSpec(),
    segment_rows: int = SEGMENT_ROWS, shared: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One row per segment, value column (``series``: its position) and knot spacing: fit status,
    points, squares and spline pieces; and one row (SEGMENT, series, spacing_id, seq) for each row
    a good fit rejects.

    Segments of at most ``segment_rows`` rows are fitted in one task each; longer ones by sums
    that no task gathers. Both give the same.

    With ``shared`` a fit that several spacings have in common is one row, as in ``common_fits``,
    with the number ``n_rejected`` of the rows it rejects; these name it by the first of its
    ``spacing_ids``. The fits are then made once for both tables, and written.
    """
    short, long = _fits(rows, values, spec, segment_rows)
    if shared:
        return _shared(short, long)
    fits, rejected = _exploded(short, spec)
    for split, out in long:
        fits, rejected = fits.unionByName(split), rejected.unionByName(out)
    return fits, rejected


def _shared(short: DataFrame, long: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    fit = [*SEGMENT, "series", "spacing_id"]
    short = materialize(short, "fits")
    lost = F.coalesce(F.array_size("rejected"), F.lit(0)).cast("long")
    fits = short.withColumn("first_knot", F.lit(None).cast("double")).withColumn("n_rejected", lost).drop("rejected")
    first = F.element_at("spacing_ids", 1).alias("spacing_id")
    rejected = short.select(*SEGMENT, "series", first, F.explode("rejected").alias("seq"))
    for split, out in long:
        out = materialize(out.select(*fit, "seq"), "rejected")
        counts = out.groupBy(*fit).agg(F.count("*").alias("n_rejected"))
        fits = fits.unionByName(_alone(split.join(counts, fit, "left").fillna(0, ["n_rejected"])))
        rejected = rejected.unionByName(out)
    return fits, rejected


def detrend_with(
    rows: DataFrame, value: str, trend: Callable[[DataFrame, str], DataFrame], out: str
) -> DataFrame:
    """Divide ``value`` by a trend of the user's own.

    ``trend(rows, value)`` returns the rows with a column ``trend``, by whatever DataFrame
    operations it needs.
    """
    fitted = trend(rows, value)
    return fitted.withColumn(out, F.try_divide(F.col(value), F.col("trend"))).drop("trend")


def _trend_frames(
    segments: Iterator[tuple], function: Callable[[np.ndarray, np.ndarray], np.ndarray],
    by: list[str], name: str,
) -> Iterator[pd.DataFrame]:
    """``by``, seq and the trend ``name`` of segments (key, seq, time, values); the trends of many
    segments make one frame, as a frame costs far more than a short segment."""
    keys: list[tuple] = []
    seqs: list[np.ndarray] = []
    trends: list[np.ndarray] = []
    rows = 0

    def frame() -> pd.DataFrame:
        sizes = [len(s) for s in seqs]
        columns = {c: pd.array(column, "Int64").repeat(sizes)
                   for c, column in zip(by, zip(*keys, strict=True), strict=True)}
        return pd.DataFrame({**columns, "seq": np.concatenate(seqs), name: np.concatenate(trends)})

    for key, seq, x, y in segments:
        found = np.asarray(function(x, y), float)
        if found.ndim and found.shape != seq.shape:
            raise ValueError(f"the trend of segment {key} has shape {found.shape}, not {seq.shape}")
        keys.append(key)
        seqs.append(seq)
        trends.append(np.broadcast_to(found, seq.shape))
        rows += len(seq)
        if rows >= FRAME_ROWS:
            yield frame()
            keys, seqs, trends, rows = [], [], [], 0
    if keys:
        yield frame()


def segment_trend(
    function: Callable[[np.ndarray, np.ndarray], np.ndarray], segment_rows: int = SEGMENT_ROWS
) -> Callable[[DataFrame, str], DataFrame]:
    """A trend for ``detrend_with`` from a numpy function ``(time, values) -> trend`` of a whole
    segment. The function needs its segment in one task, so a longer one is an error."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _trend_frames(_segments(batches, segment_rows), function, SEGMENT, "trend")

    schema = "target_id long, quarter int, segment_id long, seq long, trend double"

    def trend(rows: DataFrame, value: str) -> DataFrame:
        named = rows.select(*SEGMENT, *ORDER, F.col(value).cast("double").alias("_y0"))
        return rows.join(_by_segment(named).mapInPandas(fit, schema), [*SEGMENT, "seq"])

    return trend


def piecewise_trend(
    function: Callable[[np.ndarray, np.ndarray], np.ndarray],
    piece_rows: int = 50_000,
    halo: int = 500,
    hot: HotKeys | None = None,
) -> Callable[[DataFrame, str], DataFrame]:
    """A trend for ``detrend_with`` from a numpy function ``(time, values) -> trend`` that sees a
    bounded part of a segment, however long that is.

    A segment of ``n`` rows is cut by row number into ``ceil(n / piece_rows)`` pieces of equal
    counts, so bursts do not fill one piece. The function gets a piece with ``halo`` rows of each
    neighbour; over these the trends of two pieces change linearly into each other. A segment of at
    most ``piece_rows`` rows is one piece, as in ``segment_trend``. Where one piece has no trend
    (NaN), the other's is taken.
    """
    if piece_rows < 1 or not 0 <= 4 * halo <= piece_rows:
        raise ValueError(f"halo must be in [0, piece_rows / 4], got {halo} of {piece_rows}")
    by = [*SEGMENT, "part"]
    schema = "target_id long, quarter int, segment_id long, part long, seq long, piece_trend double"

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _segments(batches, piece_rows + 2 * halo + 2, by)
        yield from _trend_frames(pieces, function, by, "piece_trend")

    def trend(rows: DataFrame, value: str) -> DataFrame:
        named = rows.select(*SEGMENT, *ORDER, F.col(value).cast("double").alias("_y0"))
        numbered = with_running_sum(
            named.withColumn("_one", F.lit(1).cast("long")), SEGMENT, ORDER, "_one", "_row", hot
        )
        counts = named.groupBy(*SEGMENT).agg(F.count("*").alias("_n"))
        spots = join_per_key(numbered.drop("_one"), counts, SEGMENT, hot)
        parts = F.ceil(F.col("_n") / F.lit(piece_rows))
        width, place = F.col("_n") / parts, F.col("_row") - F.lit(0.5)
        first = F.greatest(F.lit(0).cast("long"), F.floor((place - halo) / width))
        last = F.least(parts - 1, F.floor((place + halo) / width))
        shared = materialize(
            spots.select(
                *SEGMENT, *ORDER, "_y0", place.alias("_place"), width.alias("_width"),
                parts.alias("_parts"), F.explode(F.sequence(first, last)).alias("part"),
            ),
            "trend_pieces",
        )
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = shared.select(*by, *ORDER, "_y0").repartition(tasks, *by)
        fitted = pieces.sortWithinPartitions(*by, *ORDER).mapInPandas(fit, schema)
        blended = shared.join(fitted, [*by, "seq"]).withColumn("_w", _share(halo))
        known = F.col("piece_trend").isNotNull() & ~F.isnan("piece_trend") & (F.col("_w") > 0)
        whole = blended.groupBy(*SEGMENT, "seq").agg(
            F.try_divide(
                F.sum(F.when(known, F.col("_w") * F.col("piece_trend"))),
                F.sum(F.when(known, F.col("_w"))),
            ).alias("trend")
        )
        return rows.join(whole, [*SEGMENT, "seq"])

    return trend


def _share(halo: int) -> Column:
    """Weight of a piece at a row: 1 inside, linear over the halo; all pieces' weights add to 1."""
    if not halo:
        return F.lit(1.0)
    place, part, width = F.col("_place"), F.col("part"), F.col("_width")
    rise = (place - (part * width - halo)) / (2.0 * halo)
    fall = ((part + 1) * width + halo - place) / (2.0 * halo)
    rise = F.when(part > 0, rise).otherwise(1.0)
    fall = F.when(part < F.col("_parts") - 1, fall).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(rise, fall)))


def score_spacings(fits: DataFrame, sigma: DataFrame, spec: SplineSpec = SplineSpec()) -> DataFrame:
    """BIC of every usable spacing of a target's series; one bad segment rules a spacing out."""
    used = F.col("status") == "ok"
    per_spacing = fits.groupBy("target_id", "series", "spacing_id", "spacing").agg(
        F.sum(F.when(used, F.col("n_knots") + F.lit(spec.k - 1)).otherwise(0)).alias("n_params"),
        F.sum("n_points").alias("n_points"),
        F.sum("ssr").alias("ssr"),
        F.max((F.col("status") == "bad_knots").cast("int")).alias("bad"),
    )
    score = bic(
        F.col("n_params"), F.col("n_points"), F.col("sigma"), F.col("ssr"), spec.penalty
    )
    return (
        per_spacing.where((F.col("bad") == 0) & (F.col("n_points") > 0))
        .drop("bad")
        .join(sigma, ["target_id", "series"])
        .withColumn("bic", score)
    )


def select_best_spacing(scores: DataFrame) -> DataFrame:
    """The spacing with the smallest BIC of each target's series; the first wins ties."""
    order = W.partitionBy("target_id", "series").orderBy(
        F.col("bic").asc_nulls_last(), "spacing_id"
    )
    ranked = scores.withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def noise_levels(
    diffs: DataFrame, columns: list[str], hot: HotKeys | None = None, hot_rows: int | None = None
) -> DataFrame:
    """(target_id, series, sigma) from the difference columns of the series."""
    pairs = F.array(*[F.struct(F.lit(i).alias("series"), F.col(c).alias("diff"))
                      for i, c in enumerate(columns)])
    long = diffs.select("target_id", F.inline(pairs)).where(F.col("diff").isNotNull())
    return mad_sigma(long, ["target_id", "series"], hot=hot, hot_rows=hot_rows)


def chosen_fits(fits: DataFrame, best: DataFrame, count: int) -> DataFrame:
    """One row per segment: the chosen fit of series ``i`` as ``fit<i>`` (NULL where the segment
    has none) and its target's ``status<i>``. ``fits`` are those of ``common_fits``."""
    winners = best.select("target_id", "series", F.col("spacing_id").alias("_best"), "spacing")
    marked = fits.join(winners, ["target_id", "series"], "left")
    # Of a segment's fits only the chosen ones go on with their pieces; its first one, as every
    # segment has a row, without.
    wins = (F.col("status") == "ok") & F.array_contains("spacing_ids", F.col("_best"))
    knot = F.coalesce(F.col("first_knot"), F.col("first") + F.col("spacing"))
    piece = F.struct("spacing", "n_knots", "low", knot.alias("first_knot"), "pieces")
    marked = marked.where(wins | F.array_contains("spacing_ids", F.lit(0))).select(
        *SEGMENT, "series", "_best", F.when(wins, piece).alias("_fit")
    )
    columns = []
    for i in range(count):
        here = F.col("series") == i
        columns += [
            F.first(F.when(here, F.col("_fit")), ignorenulls=True).alias(f"fit{i}"),
            F.coalesce(
                F.max(F.when(here & F.col("_best").isNotNull(), F.lit("ok"))), F.lit("no_fit")
            ).alias(f"status{i}"),
        ]
    return marked.groupBy(*SEGMENT).agg(*columns)


def fit_value(fit: Column, k: int) -> Column:
    """Value of a chosen fit at the row's time; NULL where there is none."""
    parts = [fit.getField(c) for c in ("pieces", "low", "first_knot", "spacing", "n_knots")]
    return F.when(fit.isNotNull(), piecewise_value(F.col("time"), *parts, k))


def prepare_segments(
    obs: DataFrame, events: DataFrame, gap: float, width: EventWidth = width_adjusted,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Observations with ``masked`` (near an event) and ``segment_id``."""
    return split_at_gaps(flag_events(obs, events, width, hot), gap, hot)


def flatten_series(
    obs: DataFrame,
    events: DataFrame,
    values: dict[str, str],
    gap: float = 0.75,
    spec: SplineSpec = SplineSpec(),
    width: EventWidth = width_adjusted,
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
    segment_rows: int = SEGMENT_ROWS,
    trends: bool = False,
) -> DataFrame:
    """Divide each series by its best spline; the events do not take part in the fit.

    ``values`` maps an output column to a series column. Adds ``<out>`` and ``<out>_status``:
    "ok", or "no_fit" for a target no spacing fits (its output is NULL), and with ``trends`` the
    value of the spline as ``<out>_trend``.
    """
    columns = ["target_id", "quarter", "seq", "time", *dict.fromkeys(values.values())]
    rows = prepare_segments(obs.select(*columns), events, gap, width, hot)
    count = len(values)
    ys, diffs = [f"_y{i}" for i in range(count)], [f"_d{i}" for i in range(count)]
    # One exchange serves the gaps, the interpolation and the differences of all series.
    rows = interpolate_masked(rows, dict(zip(ys, values.values(), strict=True)), hot=hot)
    rows = with_previous(rows, SEGMENT, ORDER, ys, hot)
    steps = {d: (F.col(y) - F.col(f"prev_{y}")) / F.lit(SQRT_2)
             for d, y in zip(diffs, ys, strict=True)}
    rows = rows.withColumns(steps).drop(*[f"prev_{y}" for y in ys])
    # Read by the noise level, the fit and the evaluation: written once, not computed thrice.
    rows = materialize(rows, "segments")
    sigma = noise_levels(rows, diffs, hot, hot_rows)
    fits = materialize(common_fits(rows, ys, spec, segment_rows), "fits")
    best = select_best_spacing(score_spacings(_spaced(fits, spec), sigma, spec))
    chosen = chosen_fits(fits, best, count)
    out = join_per_key(rows.drop(*ys, *diffs), chosen, SEGMENT, hot, "left")
    # Columns of their own: inside one expression they would be computed anew at every mention.
    fits_of = [F.col(f"fit{i}") for i in range(count)]
    out = out.withColumns({
        f"_cell{i}": piece_cell(F.col("time"), *(fit[c] for c in ("first_knot", "spacing", "n_knots")))
        for i, fit in enumerate(fits_of)
    }).withColumns({
        f"_at{i}": cell_distance(F.col("time"), F.col(f"_cell{i}"), *(fit[c] for c in ("low", "first_knot", "spacing")))
        for i, fit in enumerate(fits_of)
    })
    trends_of = {
        f"_trend{i}": F.when(fit.isNotNull(), cell_value(F.col(f"_cell{i}"), F.col(f"_at{i}"), fit["pieces"], spec.k))
        for i, fit in enumerate(fits_of)
    }
    out = out.withColumns(trends_of)
    results = {}
    for i, (name, value) in enumerate(values.items()):
        trend = F.col(f"_trend{i}")
        results[name] = F.try_divide(F.col(value), trend)
        if trends:
            results[f"{name}_trend"] = trend
        results[f"{name}_status"] = F.col(f"status{i}")
    extra = [f"{c}{i}" for i in range(count) for c in ("fit", "status", "_cell", "_at", "_trend")]
    return out.withColumns(results).drop(*extra)
