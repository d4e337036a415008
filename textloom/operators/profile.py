"""Dataset profiling (A01-A07, L01): counts, prevalence, describe, histogram.

Every statistic over L label columns is one aggregate pass followed by an
`unpivot`, not one scan per label.  Exact quartiles come from exact ranks
(bucketed, see `rank.py`), never from collecting a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.rank import running_sum, with_quantile_bucket
from textloom.session import materialize

RANGES_IN_TASKS = 100_000  # groups of a histogram whose ranges are broadcast, at most


def label_prevalence(df: DataFrame, labels: Sequence[str], denominator: int | Column | None = None) -> DataFrame:
    """Per label positives, negatives, percentage and positive:negative ratio.

    One pass over the table; `denominator` replaces the row count for the
    percentage (the reference divides test counts by the train size).
    """
    aggs = [F.count(F.lit(1)).alias("__n")]
    for l in labels:
        aggs.append(F.sum(F.col(l).cast("long")).alias(f"{l}__pos"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{l}', `{l}__pos`" for l in labels)
    long = wide.selectExpr("__n", f"stack({len(labels)}, {stack}) as (label, positives)")
    denom = F.col("__n") if denominator is None else F.lit(denominator)
    return long.select(
        "label",
        F.col("positives").cast("long").alias("positives"),
        (F.col("__n") - F.col("positives")).cast("long").alias("negatives"),
        F.round(F.try_divide(F.lit(100.0) * F.col("positives"), denom), 6).alias("pct"),
        F.round(F.try_divide(F.col("positives"), F.col("__n") - F.col("positives")), 6).alias("pos_neg_ratio"),
    )


def value_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts of each value of each label column (long form), most frequent first within a label."""
    stack = ", ".join(f"'{l}', CAST(`{l}` AS BIGINT)" for l in labels)
    long = df.selectExpr(f"stack({len(labels)}, {stack}) as (label, value)")
    return long.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("label", F.col("n").desc(), "value")


def describe(df: DataFrame, group: str, value: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample std, min, exact linear-interpolated quantiles, max per group.

    Quantile position p = q * (n - 1); value = v[floor p] + (v[ceil p] - v[floor p]) * frac(p),
    with v indexed by an exact rank.  Ranks come from running sums of counts over the distinct values,
    so a value that most rows hold is one row; only values that cover a needed rank go on.
    """
    base = df.select(group, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = base.groupBy(group).agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    bucketed, _ = with_quantile_bucket(base.groupBy(group, "v").agg(F.count("v").alias("__c")), "v", "__qb")
    ranked = running_sum(bucketed, F.col("__qb"), ["v"], F.col("__c"), "__r", partition=[group], total="__n").drop("__qb")

    def covers(rank):
        return (rank > F.col("__r") - F.col("__c")) & (rank <= F.col("__r"))

    conds, outs = [], []
    for i, q in enumerate(quantiles):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
        ranked = ranked.withColumn(f"__lo{i}", lo).withColumn(f"__hi{i}", hi).withColumn(f"__fr{i}", pos - F.floor(pos))
        conds += [covers(F.col(f"__lo{i}")), covers(F.col(f"__hi{i}"))]
    needed = ranked.where(_any(conds))
    q_aggs = []
    for i, q in enumerate(quantiles):
        v_lo = F.max(F.when(covers(F.col(f"__lo{i}")), F.col("v")))
        v_hi = F.max(F.when(covers(F.col(f"__hi{i}")), F.col("v")))
        fr = F.max(F.col(f"__fr{i}"))
        q_aggs.append((v_lo + (v_hi - v_lo) * fr).alias(f"q{int(round(q * 100))}"))
    qs = needed.groupBy(group).agg(*q_aggs)
    return stats.join(qs, group)


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def histogram(df: DataFrame, group: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram per group over [min, max], last bin closed; empty bins kept.

    A constant group is widened to [v - 0.5, v + 0.5] as numpy does.  The groups' ranges are
    counted: up to `RANGES_IN_TASKS` groups they go to the tasks, so that a group with most of the rows isn't
    shuffled into one; more groups are joined by a shuffle.  Both ways give the same result.
    """
    g = list(group)
    base = df.select(*g, F.col(value).cast("double").alias("v"))
    rng = base.groupBy(*g).agg(F.min("v").alias("lo0"), F.max("v").alias("hi0"))
    rng = rng.select(
        *g,
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    rng = materialize(rng)  # one row a group; read three times below
    ranges = F.broadcast(rng) if rng.count() <= RANGES_IN_TASKS else rng
    binned = base.join(ranges, g).select(
        *g,
        (F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)) + 1)
        .cast("int")
        .alias("bin"),
    )
    counts = binned.groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = rng.select(*g, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select(
        *g,
        "bin",
        F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / bins, 6).alias("bin_lo"),
        F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins, 6).alias("bin_hi"),
    )
    return all_bins.join(counts, [*g, "bin"], "left").select(
        *g, "bin", "bin_lo", "bin_hi", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )
