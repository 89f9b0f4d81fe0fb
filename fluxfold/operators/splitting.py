"""Leak-free train / test / validation splits: all rows of a target land in one split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfold.operators.quantiles import group_quantiles

SLOTS = 10_000
SPLITS = ("train", "test", "validation")


def _check(test_size: float, validation_size: float) -> None:
    for name, size in (("test_size", test_size), ("validation_size", validation_size)):
        if not 0 <= size <= 1:
            raise ValueError(f"{name} must be in [0, 1], got {size}")
    if test_size + validation_size > 1:
        raise ValueError("test_size + validation_size must be <= 1")


def ranked_split(
    rows: DataFrame, test_size: float = 0.1, validation_size: float = 0.1, *,
    hot_rows: int | None = None,
) -> DataFrame:
    """(target_id, split): the smallest ids are test, the next validation, the rest train.

    The two boundary ids are the values at the rank where the running row count reaches the
    wanted share; they are rank-selected, so no task orders the whole id list.
    """
    _check(test_size, validation_size)

    def rank(share: float):
        return lambda n: F.greatest(F.ceil(F.lit(share) * n) - 1, F.lit(0).cast("long"))

    edges = group_quantiles(
        rows.select("target_id"),
        [],
        {
            "test": ("target_id", rank(test_size)),
            "validation": ("target_id", rank(test_size + validation_size)),
        },
        hot_rows=hot_rows,
    )
    edge = F.col("_edge")
    split = (
        F.when(F.col("target_id") < edge["test"], "test")
        .when(F.col("target_id") < edge["validation"], "validation")
        .otherwise("train")
    )
    targets = rows.select("target_id").distinct()
    bounded = targets.withColumn("_edge", edges.select(F.struct("test", "validation")).scalar())
    return bounded.select("target_id", split.alias("split"))


def hash_split(
    target_id: Column, test_size: float = 0.1, validation_size: float = 0.1, seed: int = 42
) -> Column:
    """Split name of a target from a seeded hash: no shuffle, stable when targets are added."""
    _check(test_size, validation_size)
    slot = F.pmod(F.xxhash64(F.lit(seed), target_id), F.lit(SLOTS))
    test = round(test_size * SLOTS)
    validation = test + round(validation_size * SLOTS)
    return (
        F.when(slot < test, "test").when(slot < validation, "validation").otherwise("train")
    )


def split_membership(rows: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Rows whose target belongs to ``split``."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, got {split}")
    members = splits.where(F.col("split") == split)
    return rows.join(members, "target_id", "left_semi")
