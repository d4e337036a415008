"""Exact global ranks and running sums without an un-partitioned window.

A global `row_number()` / running `sum()` over an un-partitioned window sends
every row to one task.  Here the ordering is cut into buckets by a *monotone
coarsening* of the sort key (a hash prefix, a quantile bucket, a
(frequency, token-prefix) pair):

1. count / sum per bucket (partial + final hash aggregate; tiny output),
2. prefix-sum the bucket table (its size is bounded by the bucketer),
   a bucket table that grows with the data is itself summed by a coarser bucket (`coarse`), so
   no window sorts it in one task,
3. join the offsets back (AQE picks the join from the runtime size),
4. finish with a window partitioned by bucket, so each task sorts one bucket.

Buckets from a hash prefix or from quantile bounds hold about N / n_buckets
rows each, so no task sees a hot group even when one key value repeats.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4096
MAX_BUCKETS = 4096
ACCURACY = 40_000        # of the quantile sketch: ranks to within one part in so many
STRING_SAMPLE = 65_536   # string keys that reach the driver for their bounds, at most


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in (cs or [])]


def running_sum(
    df: DataFrame,
    bucket: Column,
    order: Sequence[Column | str],
    value: Column | str | None = None,
    out: str = "rank",
    partition: Sequence[str] = (),
    total: str | None = None,
    how: str = "sum",
    coarse: Column | None = None,
) -> DataFrame:
    """Inclusive running aggregate (`how` = sum | min | max) of `value`; the
    default (sum of 1) is the exact 1-based row rank.

    `bucket` must be non-decreasing along `order` within each `partition`
    group; `order` must be a total order (end with a unique key) when the
    result is a rank.  Adds `out` and, optionally, the group total as `total`.
    `coarse`, an expression over the bucket column `__bk` and non-decreasing with it, cuts the
    bucket table itself into few parts.
    """
    part = list(partition)
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    combine = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}[how]
    val = F.lit(1) if value is None else (F.col(value) if isinstance(value, str) else value)
    b = df.withColumn("__bk", bucket).withColumn("__v", val.cast("long") if value is None else val)
    per_bucket = b.groupBy(*part, "__bk").agg(agg("__v").alias("__s"))
    before = Window.partitionBy(*part).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    running = agg("__s").over(before)
    if coarse is not None:
        per_bucket = per_bucket.withColumn("__ck", coarse)
        tops = per_bucket.groupBy(*part, "__ck").agg(agg("__s").alias("__cs"))
        above = Window.partitionBy(*part).orderBy("__ck").rowsBetween(Window.unboundedPreceding, -1)
        tops = tops.select(*part, "__ck", agg("__cs").over(above).alias("__coff"))
        per_bucket = per_bucket.join(tops, [*part, "__ck"])
        within = Window.partitionBy(*part, "__ck").orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
        inner = agg("__s").over(within)
        running = F.when(inner.isNull(), F.col("__coff")).otherwise(combine(F.col("__coff"), inner))
    offsets = per_bucket.select(
        *part,
        "__bk",
        running.alias("__off"),
        *([F.sum("__s").over(Window.partitionBy(*part)).alias(total)] if total else []),
    )
    joined = b.join(offsets, [*part, "__bk"])
    inside = Window.partitionBy(*part, "__bk").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, combine(F.col("__off"), agg("__v").over(inside))).drop("__bk", "__v", "__off")


def hash_prefix_bucket(hex_key: Column, digits: int = 3) -> Column:
    """Monotone bucket for an ordering led by a hex digest: its first digits."""
    return F.substring(hex_key, 1, digits)


def bucket_count(rows: int) -> int:
    """Buckets for so many rows: one for each `ROWS_PER_BUCKET`, up to `MAX_BUCKETS`."""
    return max(1, min(MAX_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def _thinned(bounds: list, n: int) -> list:
    """At most n - 1 of the sorted bounds, evenly spaced, without repeats."""
    n = min(n, len(bounds) + 1)
    return sorted({bounds[i * (len(bounds) + 1) // n - 1] for i in range(1, n)})


def quantile_bounds(df: DataFrame, key: str, n: int | None = None) -> list[float]:
    """Approximate quantile bounds of a numeric column: n buckets, or by the row count if n is not given.

    One aggregate job over a mergeable sketch; only the bounds (fewer than `MAX_BUCKETS`) reach the driver.
    """
    most = n or MAX_BUCKETS
    probs = F.from_json(F.lit(json.dumps([i / most for i in range(1, most)])), "array<double>")
    row = df.agg(F.count(key).alias("rows"), F.percentile_approx(F.col(key).cast("double"), probs, ACCURACY).alias("q")).first() if most > 1 else None
    if row is None or row["q"] is None:
        return []
    bounds = sorted(float(q) for q in row["q"] if not math.isnan(q))
    return _thinned(bounds, n or bucket_count(row["rows"]))


def string_bounds(df: DataFrame, key: str, n: int | None = None) -> list[str]:
    """Quantile bounds of a string column, from `STRING_SAMPLE` of its rows drawn at random: whatever the keys look
    like, a bucket between two bounds holds about its share.  The bounds decide balance only, never a result."""
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    rows = keys.count()
    sample = [r["k"] for r in keys.withColumn("r", F.rand(17)).orderBy("r").limit(STRING_SAMPLE).collect()]
    sample.sort(key=lambda k: k.encode())
    n = min(n or bucket_count(rows), len(sample))
    picked = {sample[i * len(sample) // n] for i in range(1, n)} if n else set()
    return sorted(picked, key=lambda k: k.encode())


def with_bound_bucket(df: DataFrame, key: str, bounds: Sequence, out: str) -> DataFrame:
    """Add `out` = number of bounds <= key, by binary search over one constant array.

    One projection per halving step (log2 of the bound count), so every step
    stays a small codegen'd expression instead of one exponentially nested tree.
    """
    if not bounds:  # one bucket; not a constant, as a join on one is a nested loop
        return df.withColumn(out, F.pmod(F.hash(key), F.lit(1)))
    size = 1
    while size < len(bounds) + 1:
        size *= 2
    kind = "string" if isinstance(bounds[0], str) else "double"
    padded = list(bounds) + [None] * (size - 1 - len(bounds))  # no key reaches a missing bound
    arr = F.from_json(F.lit(json.dumps(padded)), f"array<{kind}>")
    k = F.col(key).cast(kind)
    df = df.withColumn(out, F.lit(0))
    step = size // 2
    while step >= 1:
        # element_at is 1-based: position idx + step holds the bound just above idx
        df = df.withColumn(
            out, F.col(out) + F.when(k >= F.element_at(arr, F.col(out) + F.lit(step)), F.lit(step)).otherwise(F.lit(0))
        )
        step //= 2
    return df


def with_quantile_bucket(df: DataFrame, key: str, out: str, n: int | None = None) -> tuple[DataFrame, int]:
    """Add a bucket column from approximate quantile bounds, n of them or by the row count; returns (df, bucket count bound)."""
    bounds = string_bounds(df, key, n) if dict(df.dtypes)[key] == "string" else quantile_bounds(df, key, n)
    return with_bound_bucket(df, key, bounds, out), len(bounds) + 1


def exact_rank(df: DataFrame, bucket: Column, order: Sequence[Column | str], out: str = "rank",
               total: str | None = None, partition: Sequence[str] = (), coarse: Column | None = None) -> DataFrame:
    """1-based exact row number along `order` (see module doc)."""
    return running_sum(df, bucket, order, None, out, partition, total, coarse=coarse)
