"""Column expressions of event labels and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxfold.schemas import LABELS


def map_label(label: Column) -> Column:
    """Short label code of a short or long label text; anything else is UNKNOWN."""
    out = F.lit("UNKNOWN")
    for short, long in LABELS.items():
        out = F.when(label.isin(short, long), F.lit(short)).otherwise(out)
    return out


def label_to_int(label: Column) -> Column:
    """1 for a planet candidate, 0 for everything else."""
    return F.coalesce((label == "PC").cast("int"), F.lit(0))


def is_valid_target_id(target_id: Column) -> Column:
    """Identifiers have one to nine digits and are positive."""
    return F.coalesce(target_id.between(1, 999_999_999), F.lit(False))


def require_target_id(target_id: Column) -> Column:
    """The identifier itself; the job fails on an invalid one."""
    message = F.concat(F.lit("invalid target id: "), F.coalesce(target_id.cast("string"),
                                                                F.lit("NULL")))
    return F.when(is_valid_target_id(target_id), target_id).otherwise(F.raise_error(message))
