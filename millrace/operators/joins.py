"""Inner equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame


def inner_equi(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """All pairs of rows with equal keys; null keys match nothing. The optimizer chooses the
    strategy from sizes; skewed keys are split at run time. Columns of the right side whose
    names the left side has get the suffix ``_right``."""
    taken = set(left.columns)
    for c in right.columns:
        if c in taken:
            right = right.withColumnRenamed(c, f"{c}_right")
            right_key = f"{c}_right" if right_key == c else right_key
    return left.join(right, left[left_key] == right[right_key], "inner")
