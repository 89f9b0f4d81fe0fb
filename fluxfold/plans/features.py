"""The feature table: one row per event with seven views and the normalised scalars."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfold.functions.labels import label_to_int
from fluxfold.functions.periodic import centroid_distance
from fluxfold.operators.detrend import SplineSpec, flatten_series
from fluxfold.operators.mapping import prefix_columns
from fluxfold.operators.normalize import (
    array_median,
    array_stats,
    normalize_array,
    normalize_array_by_reference,
    normalize_scalars,
    scale_array,
    views_std,
)
from fluxfold.operators.skew import HotKeys, find_hot_keys
from fluxfold.operators.splitting import SPLITS, hash_split
from fluxfold.operators.views import (
    EVENT_KEY,
    GLOBAL_VIEW,
    LOCAL_VIEW,
    ViewSpec,
    folded_view,
    known_or_nan,
    odd_even_views,
    secondary_views,
    view_arrays,
)
from fluxfold.schemas import FEATURES, VIEW_NAMES
from fluxfold.session import materialize


@dataclass(frozen=True)
class FeatureSpec:
    """Parameters of the feature table; the defaults are the usual mission settings."""

    test_size: float = 0.33
    validation_size: float = 0.33
    seed: int = 42
    sigma_cut: float = 20.0
    gap: float = 0.75
    spline: SplineSpec = field(default_factory=SplineSpec)
    local: ViewSpec = LOCAL_VIEW
    overview: ViewSpec = GLOBAL_VIEW
    detrend: bool = True


def split_targets(tces: DataFrame, spec: FeatureSpec) -> DataFrame:
    split = hash_split(F.col("target_id"), spec.test_size, spec.validation_size, spec.seed)
    return tces.select("target_id").distinct().withColumn("split", split)


def combine_views(named: DataFrame, names: tuple[str, ...] = VIEW_NAMES) -> DataFrame:
    """(target_id, tce_id, view_name, view) rows to one row per event with one array per name.

    Events that lack any of the views are left out.
    """
    wide = named.groupBy(*EVENT_KEY).agg(
        *[
            F.first(F.when(F.col("view_name") == n, F.col("view")), ignorenulls=True).alias(n)
            for n in names
        ]
    )
    return wide.dropna(subset=list(names))


def join_features(views: DataFrame, tces: DataFrame, stellar: DataFrame) -> DataFrame:
    """Views with the scalars of their event and star, in the order of the output schema."""
    scalars = prefix_columns(
        tces.withColumn("label", label_to_int(F.col("label"))).withColumnRenamed("tce_id", "id"),
        "tce",
    )
    stars = prefix_columns(stellar, "stellar")
    joined = (
        views.withColumnsRenamed({"target_id": "tce_target_id", "tce_id": "tce_id"})
        .join(scalars, ["tce_target_id", "tce_id"])
        .join(stars, F.col("tce_target_id") == F.col("stellar_id"))
        .withColumn("id", F.concat_ws("-", "tce_target_id", "tce_id"))
    )
    return joined.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURES])


def series_views(
    flat: DataFrame,
    tces: DataFrame,
    train: DataFrame,
    spec: FeatureSpec,
    hot: HotKeys | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """The seven normalised views as (target_id, tce_id, view_name, view) rows.

    ``flat`` has target_id, time, flux and centroid_shift. Each kind of view is one pass over
    the series; flux and centroid share it. A view is one array from then on, so its
    normalisation needs no further shuffle of bins.
    """
    pairs = {"flux": "flux", "centroid_shift": "centroid_shift"}
    known = F.col("target_id").isNotNull() & F.col("tce_id").isNotNull()
    parts: list[DataFrame] = []

    def arrays(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        return view_arrays(rows.where(known), keys, values, missing=True)

    def emit(rows: DataFrame, name: Column, view: Column) -> None:
        parts.append(rows.select(*EVENT_KEY, name.alias("view_name"), known_or_nan(view).alias("view")))

    reference = None
    for prefix, view in (("local", spec.local), ("global", spec.overview)):
        raw = arrays(folded_view(flat, tces, view, pairs, hot, hot_rows), EVENT_KEY, [*pairs])
        # The centroid views are scaled twice: by their own minimum, then by the training spread.
        shift = normalize_array(F.col("centroid_shift"), array_stats(F.col("centroid_shift")))
        raw = materialize(
            raw.select(
                *EVENT_KEY, "flux", array_stats(F.col("flux")).alias("stats"),
                shift.alias("centroid_shift"),
            ),
            f"{prefix}_views",
        )
        if prefix == "local":
            reference = raw.select(*EVENT_KEY, "stats")
        emit(raw, F.lit(f"{prefix}_flux"), normalize_array(F.col("flux"), F.col("stats")))
        points = raw.select("target_id", F.explode("centroid_shift").alias("centroid_shift"))
        std = views_std(points, ["centroid_shift"], train).scalar()
        scaled = scale_array(
            F.col("centroid_shift"), array_median(F.col("centroid_shift")), F.col("_std")
        )
        emit(raw.withColumn("_std", std), F.lit(f"{prefix}_centroid_shift"), scaled)

    parity = odd_even_views(flat, tces, spec.local, "flux", hot, hot_rows)
    parity = materialize(arrays(parity, [*EVENT_KEY, "even"], ["value"]), "parity_views")
    second = secondary_views(flat, tces, spec.local, "flux", hot, hot_rows)
    second = materialize(arrays(second, EVENT_KEY, ["value"]), "secondary_views")
    scaled = normalize_array_by_reference(F.col("value"), F.col("stats"))
    parity_name = F.when(F.col("even"), "even_flux").otherwise("odd_flux")
    emit(parity.join(reference, EVENT_KEY), parity_name, scaled)
    emit(second.join(reference, EVENT_KEY), F.lit("secondary_flux"), scaled)

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def create_features(
    obs: DataFrame,
    tces: DataFrame,
    stellar: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    hot_rows: int | None = None,
    splits: DataFrame | None = None,
) -> DataFrame:
    """Feature rows plus their ``split``. Nothing passes through the driver but row counts.

    ``splits`` (target_id, split) gives the split of each target instead of the hash of its id:
    events of targets it does not name are left out, a target in two splits has rows in both;
    repeated rows, NULLs and other names of splits
    count for nothing.
    """
    obs = obs.withColumn("centroid_shift", centroid_distance(F.col("centroid_x"),
                                                             F.col("centroid_y")))
    hot = find_hot_keys(obs, ["target_id"], "time", hot_rows)
    given = splits is not None
    if given:
        splits = splits.select("target_id", "split").dropna().distinct()
        known = splits.where(F.col("split").isin(*SPLITS))
        splits = materialize(known, "splits")
        tces = tces.join(splits, "target_id", "left_semi")
    else:
        splits = split_targets(tces, spec)
    train = splits.where(F.col("split") == "train")
    if spec.detrend:
        # Read by every view below: written once, so no fit runs twice.
        flat = flatten_series(
            obs, tces, {"flat_flux": "flux", "flat_shift": "centroid_shift"}, spec.gap,
            spec.spline, hot=hot, hot_rows=hot_rows,
        )
        flat = materialize(
            flat.select(
                "target_id", "time", F.col("flat_flux").alias("flux"),
                F.col("flat_shift").alias("centroid_shift"),
            ),
            "flat_series",
        )
    else:
        flat = obs.select("target_id", "time", "flux", "centroid_shift")
    views = combine_views(series_views(flat, tces, train, spec, hot, hot_rows))
    scalars = normalize_scalars(
        tces, train, "target_id", ["label", "name", "tce_id", "target_id"], spec.sigma_cut
    )
    stars = normalize_scalars(stellar, train, "id", ["id"], spec.sigma_cut)
    rows = join_features(views, scalars, stars)
    if given:
        named = splits.select(F.col("target_id").alias("tce_target_id"), "split")
        return rows.join(named, "tce_target_id").select(*rows.columns, "split")
    split = hash_split(F.col("tce_target_id"), spec.test_size, spec.validation_size, spec.seed)
    return rows.withColumn("split", split)
