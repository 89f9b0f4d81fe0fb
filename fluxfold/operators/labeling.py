"""Event labels: merge of the catalogues, label counts and event distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.functions.labels import map_label
from fluxfold.operators.quantiles import group_quantiles
from fluxfold.operators.skew import HotKeys, join_per_key
from fluxfold.schemas import LABELS


def merge_and_label(
    tce: DataFrame, koi: DataFrame, positives: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Events with their catalogue entry, if any, and the label derived from both catalogues.

    The small catalogues are joined first: the event table is shuffled at most once, and events
    without an entry never meet on a NULL key.
    """
    verdicts = positives.select("kepoi_name", "fpwg_disp_status")
    entries = (
        koi.join(verdicts, "kepoi_name", "left")
        .withColumn("kepid_koi", F.col("kepid"))
        .withColumn("tce_plnt_num", F.col("koi_tce_plnt_num"))
    )
    merged = join_per_key(tce, entries, ["kepid", "tce_plnt_num"], hot, "left")
    status = F.col("fpwg_disp_status")
    label = (
        F.when(F.col("koi_disposition") == "CONFIRMED", "PC")
        .when(status == "CERTIFIED FP", "AFP")
        .when((status == "CERTIFIED FA") | F.col("kepid_koi").isNull(), "NTP")
        .otherwise("UNKNOWN")
    )
    return merged.withColumn("label", label).drop("fpwg_disp_status")


def labels_distribution(labels: DataFrame, column: str = "label") -> DataFrame:
    """Count of every label, zeros included. Without generic false positives, FP is NTP + AFP."""
    code = map_label(F.col(column))
    one_row = labels.select(code.alias("_label")).agg(
        *[F.count_if(F.col("_label") == name).alias(name) for name in LABELS]
    )
    derived = F.when(F.col("FP") > 0, F.col("FP")).otherwise(F.col("NTP") + F.col("AFP"))
    return one_row.withColumn("FP", derived).unpivot([], list(LABELS), "label", "n")


def label_hierarchy(distribution: DataFrame) -> DataFrame:
    """Two-level (label, parent, n): UNKNOWN and KNOWN, KNOWN into PC and FP, FP into AFP, NTP."""
    sums = distribution.agg(
        *[F.sum(F.when(F.col("label") == name, F.col("n"))).alias(name) for name in LABELS]
    )
    # The total leaves FP out, as its parts are counted already.
    total = sum((F.col(name) for name in LABELS if name != "FP"), F.lit(0))
    parents = {"UNKNOWN": "", "KNOWN": "", "PC": "KNOWN", "FP": "KNOWN", "AFP": "FP", "NTP": "FP"}
    wide = sums.withColumn("KNOWN", total - F.col("UNKNOWN"))
    parent = F.create_map(*[F.lit(x) for pair in parents.items() for x in pair])
    return wide.unpivot([], list(parents), "label", "n").select(
        "label", parent[F.col("label")].alias("parent"), "n"
    )


def log_histogram(df: DataFrame, columns: list[str], width: float = 0.1) -> DataFrame:
    """Counts per bin of log10 of each column; values that have no logarithm are left out."""
    if width <= 0:
        raise ValueError(f"width must be > 0, got {width}")
    long = df.select(*columns).unpivot([], columns, "field", "value").where(F.col("value") > 0)
    bin_ = F.floor(F.log10("value") / F.lit(float(width))).alias("bin")
    return long.groupBy("field", bin_).agg(F.count("*").alias("n"))


def box_summary(
    df: DataFrame, columns: list[str], hot_rows: int | None = None
) -> DataFrame:
    """Minimum, quartiles and maximum of log10 of each column."""
    long = df.select(*columns).unpivot([], columns, "field", "value").where(F.col("value") > 0)
    logs = long.select("field", F.log10("value").alias("x"))
    quartiles = {"q1": ("x", 0.25), "median": ("x", 0.5), "q3": ("x", 0.75)}
    limits = {"min": F.min("x"), "max": F.max("x")}
    return group_quantiles(logs, ["field"], quartiles, extra=limits, hot_rows=hot_rows)


def events_by_target(tces: DataFrame) -> DataFrame:
    """One row per target: its events as an array ordered by event id, and their number."""
    event = F.struct("tce_id", "epoch", "duration", "period", "secondary_phase")
    return tces.groupBy("target_id").agg(
        F.array_sort(F.collect_list(event)).alias("events"), F.count("*").alias("n")
    )
