"""Submission assembly.

The reference aligns predictions with the template by row position; here every
alignment is a key join.  Per-label outputs are stacked long and pivoted in
one shuffle instead of L successive joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_template(template: DataFrame, preds: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Template keys left-joined with the prediction columns (template order of columns)."""
    return template.select(key).join(preds.select(key, *labels), key, "left").select(key, *labels)


def stack_labels(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Per-label `(key, value)` frames -> one long `(key, label, value)` frame."""
    out = None
    for label, df in frames.items():
        part = df.select(key, F.lit(label).alias("label"), F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def combine_labels(long: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Long `(key, label, value)` -> wide, one column per label, one shuffle (pivot with
    the label values given, so Spark does not scan for them)."""
    return long.groupBy(key).pivot("label", list(labels)).agg(F.first("value"))


def to_long(wide: DataFrame, key: str, labels: Sequence[str], value: str = "value") -> DataFrame:
    """Wide label columns -> `(key, label, value)` via `unpivot`."""
    return wide.unpivot([key], list(labels), "label", value)
