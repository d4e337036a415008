"""Metric-history operators: best checkpoint (W03) and early stopping.

Input: a long history `(run, epoch, metric)` with dense 0-based epochs.

Early stopping follows the stopping rule: the first value is the best and
never stops; a NaN stops at once; a value strictly better than best by more
than `min_delta` (absolute, or percent of best) resets the bad-epoch count
and becomes the best; otherwise the count grows, and the run stops when it
reaches `patience` (patience 0 switches the rule off: no best, no stop).

With `min_delta == 0` "better" means "a new strict running minimum" (maximum
in max mode), so the rule has a parallel form: running min / max scans over
epoch buckets (no run is ever one task).  With `min_delta > 0` the best moves
only on big enough steps, which is inherently sequential; that case folds the
run's epochs in order with SQL `aggregate()` (bounded by the epoch count of
one run, which is a training-length series, not a table-length one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.rank import running_sum
from textloom.sources.committed import append_part, committed_parts, read_parts

EPOCH_BUCKET = 1024
HISTORY = "run long, epoch long, metric double"
BEST = "run long, n_epochs long, best_epoch long, best_metric double"


def best_checkpoint(hist: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """Lowest metric per run, earliest epoch on ties (strict `<` when scanning)."""
    valid = F.when(~F.isnan(metric), F.struct(F.col(metric).alias("m"), F.col(epoch).alias("e")))
    return hist.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.min(valid).alias("__b"),
    ).select(run, "n_epochs", F.col("__b.e").alias("best_epoch"), F.col("__b.m").alias("best_metric"))


def append_history(part: DataFrame, path: str, name: str) -> bool:
    """Add the `(run, epoch, metric)` rows of the part called `name` to the history at `path`.

    A part counts once: appending a committed one again, as an interrupted run does when it starts over, changes
    nothing and gives False.  Earlier parts stay."""
    return append_part(part.select(*_columns_of(HISTORY)), path, name)


def _columns_of(schema: str) -> list[Column]:
    return [F.col(name).cast(kind) for name, kind in (field.split() for field in schema.split(", "))]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed parts; a history without one is empty."""
    return read_parts(spark, path, HISTORY)


def save_best(hist: DataFrame, path: str) -> int:
    """Store the best checkpoint of every run as the next version, visible as a whole or not at all."""
    version = max(_versions(hist.sparkSession, path), default=0) + 1
    append_part(best_checkpoint(hist).select(*_columns_of(BEST)), path, f"{version:012d}")
    return version


def read_best(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """`(run, n_epochs, best_epoch, best_metric)` of the latest version, or of the one asked for."""
    known = _versions(spark, path)
    if version is not None and version not in known:
        raise ValueError(f"no version {version} of the best checkpoints at {path}")
    wanted = max(known, default=0) if version is None else version
    return read_parts(spark, path, BEST, [f"{wanted:012d}"])


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(part) for part in committed_parts(spark, path)]


def _check_mode(mode: str) -> None:
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', not {mode!r}")


def early_stop(hist: DataFrame, mode: str, patience: int = 10, min_delta: float = 0.0, percentage: bool = False,
               run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """`(run, n_epochs, stop_epoch, best_epoch, best_metric)`; stop_epoch is null when
    the run never stops."""
    _check_mode(mode)
    if patience == 0:
        # the rule is off: nothing is recorded and nothing stops
        return hist.groupBy(run).agg(F.count(F.lit(1)).alias("n_epochs")).select(
            run, "n_epochs", F.lit(None).cast("long").alias("stop_epoch"),
            F.lit(None).cast("long").alias("best_epoch"), F.lit(None).cast("double").alias("best_metric"))
    if min_delta == 0:
        return _early_stop_scan(hist, mode, patience, run, epoch, metric)
    return _early_stop_fold(hist, mode, patience, min_delta, percentage, run, epoch, metric)


def _early_stop_scan(hist, mode, patience, run, epoch, metric) -> DataFrame:
    sign = 1.0 if mode == "min" else -1.0
    h = hist.select(
        F.col(run).alias("run"), F.col(epoch).alias("epoch"), F.col(metric).alias("metric"),
        (F.col(metric) * F.lit(sign)).alias("__m"),
    )
    bucket = F.floor(F.col("epoch") / F.lit(EPOCH_BUCKET))
    # inclusive running minimum of (value, epoch): its epoch is the current one exactly
    # when the current value is strictly below every earlier value
    key = F.when(~F.isnan("__m"), F.struct(F.col("__m").alias("m"), F.col("epoch").alias("e")))
    h = running_sum(h, bucket, ["epoch"], key, "__cm", partition=["run"], how="min")
    # NaN as the very first value: it stays the best and nothing is ever better
    first_nan = F.when(F.col("epoch") == 0, F.isnan("metric").cast("int"))
    h = running_sum(h, bucket, ["epoch"], first_nan, "__m0", partition=["run"], how="max")
    h = h.withColumn("__m0nan", F.col("__m0") == 1)
    improved = (F.col("epoch") == 0) | (~F.col("__m0nan") & (F.col("__cm.e") == F.col("epoch")))
    h = h.withColumn("__imp", F.when(improved, F.col("epoch")))
    h = running_sum(h, bucket, ["epoch"], F.col("__imp"), "__last", partition=["run"], how="max")
    stop = (F.col("epoch") >= 1) & (F.isnan("metric") | (F.col("epoch") - F.col("__last") >= patience))
    best_val = F.when(F.col("__m0nan"), F.lit(float("nan"))).otherwise(F.col("__cm.m") * F.lit(sign))
    h = h.withColumn("__stop", stop).withColumn("__best", best_val)
    per_run = h.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.min(F.when(F.col("__stop"), F.struct("epoch", F.col("__last").alias("last"), F.col("__best").alias("best")))).alias("__s"),
        F.max(F.struct("epoch", F.col("__last").alias("last"), F.col("__best").alias("best"))).alias("__end"),
    )
    at = F.coalesce(F.col("__s"), F.col("__end"))
    return per_run.select(
        F.col("run").alias(run), "n_epochs",
        F.col("__s.epoch").cast("long").alias("stop_epoch"),
        at["last"].cast("long").alias("best_epoch"),
        at["best"].alias("best_metric"),
    )


def _early_stop_fold(hist, mode, patience, min_delta, percentage, run, epoch, metric) -> DataFrame:
    series = hist.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).alias("m")))).alias("__xs"),
    )
    init = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(None).cast("long").alias("best_epoch"),
        F.lit(0).alias("bad"),
        F.lit(None).cast("long").alias("stop"),
    )

    def _d(s):
        return (F.lit(float(min_delta)) * s["best"] / F.lit(100.0)) if percentage else F.lit(float(min_delta))

    def step(s, x):
        xs_m, xs_e = x["m"], x["e"]
        # comparisons with a NaN best are false in Python; Spark orders NaN above all numbers
        better = ~F.isnan(s["best"]) & ((xs_m < s["best"] - _d(s)) if mode == "min" else (xs_m > s["best"] + _d(s)))
        bad1 = s["bad"] + 1
        return (
            F.when(s["stop"].isNotNull(), s)
            .when(s["best_epoch"].isNull(), F.struct(xs_m.alias("best"), xs_e.alias("best_epoch"), F.lit(0).alias("bad"),
                                                   F.lit(None).cast("long").alias("stop")))
            .when(F.isnan(xs_m), F.struct(s["best"].alias("best"), s["best_epoch"].alias("best_epoch"),
                                          s["bad"].alias("bad"), xs_e.alias("stop")))
            .when(F.coalesce(better, F.lit(False)),
                  F.struct(xs_m.alias("best"), xs_e.alias("best_epoch"), F.lit(0).alias("bad"),
                           F.lit(None).cast("long").alias("stop")))
            .otherwise(F.struct(s["best"].alias("best"), s["best_epoch"].alias("best_epoch"), bad1.alias("bad"),
                                F.when(bad1 >= patience, xs_e).cast("long").alias("stop")))
        )

    folded = series.select(run, "n_epochs", F.aggregate("__xs", init, step).alias("__f"))
    return folded.select(
        run, "n_epochs", F.col("__f.stop").alias("stop_epoch"),
        F.col("__f.best_epoch").cast("long").alias("best_epoch"), F.col("__f.best").alias("best_metric"),
    )
