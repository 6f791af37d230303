"""Aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolated_percentile(value: Column, fraction: float) -> Column:
    """Exact percentile with linear interpolation; 0 for an empty group."""
    return F.coalesce(F.percentile(value, fraction), F.lit(0.0))


def ordered_text(content: Column, position: Column, separator: str = " ") -> Column:
    """Texts of a group joined in the order of `position`."""
    parts = F.array_sort(F.collect_list(F.struct(position.alias("p"), content.alias("c"))))
    return F.array_join(F.transform(parts, lambda part: part["c"]), separator)
