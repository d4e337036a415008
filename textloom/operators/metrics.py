"""Evaluation on a long score frame `(key, label, score, y)`.

All labels are evaluated in one job (R5: long form, never a loop over labels).
ROC/AUC first aggregate to distinct scores per label, then take exact running
sums with score-quantile buckets so that no label lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scoring import (
    argmax,
    bce_with_logits,
    cross_entropy_2,
    rint,
    sigmoid,
    squared_error,
)
from textloom.operators.rank import running_sum, with_quantile_bucket


def _score_counts(long: DataFrame, group: Sequence[str], score: str, y: str) -> DataFrame:
    yy = F.col(y).cast("long")
    g = long.groupBy(*group, score).agg(
        F.sum(yy).alias("pos"),
        F.sum(F.lit(1) - yy).alias("neg"),
    )
    r = rint(F.col(score))
    # rows whose rounded score equals the label: all positives when it rounds to 1, all negatives at 0
    return g.withColumn(
        "hit", F.when(r == 1.0, F.col("pos")).when(r == 0.0, F.col("neg")).otherwise(F.lit(0)).cast("long")
    )


def _cumulative(g: DataFrame, group: Sequence[str], score: str, value: str, out: str,
                descending: bool, bucketed: bool) -> DataFrame:
    if bucketed:
        has_bucket = "__qb" in g.columns
        if not has_bucket:
            g, _ = with_quantile_bucket(g, score, "__qb")
        bucket = -F.col("__qb") if descending else F.col("__qb")
        order = [F.col(score).desc()] if descending else [F.col(score)]
        out_df = running_sum(g, bucket, order, F.col(value), out, partition=list(group))
        return out_df if has_bucket else out_df.drop("__qb")
    order = F.col(score).desc() if descending else F.col(score)
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn(out, F.sum(value).over(w))


def auc(long: DataFrame, group: Sequence[str] = ("label",), score: str = "score", y: str = "y",
        bucketed: bool = True) -> DataFrame:
    """A14 + A15: ROC-AUC per group with exact tie handling; one-class groups fall back to
    the accuracy of the half-even-rounded score.

    AUC = sum over distinct scores of pos * (negatives below + neg / 2) / (P * N).
    `bucketed=False` suits many small groups (per-batch AUC), where a window
    partitioned by the group is already balanced.
    """
    g = _score_counts(long, group, score, y)
    c = _cumulative(g, group, score, "neg", "__cneg", descending=False, bucketed=bucketed)
    term = F.col("pos") * (F.col("__cneg") - F.col("neg") + F.col("neg") / F.lit(2.0))
    per = c.groupBy(*group).agg(
        F.sum(term).alias("__s"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum("hit").alias("__hit"),
    )
    p, n = F.col("positives"), F.col("negatives")
    value = F.when((p == 0) | (n == 0), F.col("__hit") / (p + n)).otherwise(F.col("__s") / (p.cast("double") * n.cast("double")))
    return per.select(*group, value.alias("auc"), p.cast("long").alias("positives"), n.cast("long").alias("negatives"))


def auc_batch_mean(long: DataFrame, batch: str = "batch_id", group: Sequence[str] = ("label",),
                   score: str = "score", y: str = "y") -> DataFrame:
    """Mean over batches of the per-batch AUC (with the one-class fallback)."""
    per_batch = auc(long, [*group, batch], score, y, bucketed=False)
    return per_batch.groupBy(*group).agg(
        F.avg("auc").alias("auc_batch_mean"), F.count(F.lit(1)).alias("n_batches"),
        F.sum(((F.col("positives") == 0) | (F.col("negatives") == 0)).cast("long")).alias("n_fallback"),
    )


def auc_macro(long: DataFrame, key: str, group: str = "label", score: str = "score", y: str = "y") -> DataFrame:
    """Mean of per-label AUC; if any label has one class only, the subset accuracy
    (all labels of a row equal to their rounded scores) instead."""
    per = auc(long, [group], score, y)
    summary = per.agg(
        F.avg("auc").alias("__mean"),
        F.sum(((F.col("positives") == 0) | (F.col("negatives") == 0)).cast("long")).alias("__one_class"),
    )
    row_ok = long.groupBy(key).agg(
        F.min((rint(F.col(score)) == F.col(y).cast("double")).cast("int")).alias("__ok")
    )
    subset = row_ok.agg(F.avg("__ok").alias("__subset"))
    # two one-row aggregates combined by a union + max (no join needed)
    both = summary.unionByName(subset, allowMissingColumns=True)
    agg = both.agg(F.max("__mean").alias("m"), F.max("__one_class").alias("o"), F.max("__subset").alias("s"))
    return agg.select(F.when(F.col("o") > 0, F.col("s")).otherwise(F.col("m")).alias("auc_macro"))


def roc_curve(long: DataFrame, group: Sequence[str] = ("label",), score: str = "score", y: str = "y",
              drop_intermediate: bool = False) -> DataFrame:
    """ROC points per group by descending distinct threshold, plus the (0, 0) start
    point whose threshold is max + 1.

    drop_intermediate=True removes points whose second differences of both fps and tps
    are zero (first and last point kept).  The step to a point is that point's own count of
    positives and negatives, so a second difference is the next point's counts less its own.

    One pass over the distinct scores: each bucket of scores tells its counts and its first
    point, so the few bucket rows give what lies above a bucket and which point follows it.
    """
    group = list(group)
    g, _ = with_quantile_bucket(_score_counts(long, group, score, y).drop("hit"), score, "__qb")
    point = F.struct(F.col(score).alias("s"), "pos", "neg")
    per = g.groupBy(*group, "__qb").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"), F.max(point).alias("__first"))
    tot = per.groupBy(*group).agg(F.sum("__p").alias("P"), F.sum("__n").alias("N"), F.max("__first.s").alias("__mx"))
    down = Window.partitionBy(*group).orderBy(F.col("__qb").desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    per = per.select(
        *group, "__qb", F.sum("__p").over(above).alias("__tp"), F.sum("__n").over(above).alias("__fp"), F.lead("__first").over(down).alias("__after"),
        F.sum("__p").over(everything).alias("P"), F.sum("__n").over(everything).alias("N"))
    inside = Window.partitionBy(*group, "__qb").orderBy(F.col(score).desc())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    c = g.join(per, [*group, "__qb"]).select(
        *group, score, "pos", "neg", "P", "N",
        (F.coalesce("__tp", F.lit(0)) + F.sum("pos").over(upto)).alias("tps"),
        (F.coalesce("__fp", F.lit(0)) + F.sum("neg").over(upto)).alias("fps"),
        (F.col("__tp").isNull() & (F.row_number().over(inside) == 1)).alias("__start"),
        F.coalesce(F.lead(point).over(inside), F.col("__after")).alias("__next"))
    if drop_intermediate:
        c = c.where(F.col("__start") | F.col("__next").isNull() | (F.col("__next.pos") != F.col("pos")) | (F.col("__next.neg") != F.col("neg")))
    pts = c.select(*group, score, "tps", "fps", "P", "N")
    start = tot.select(*group, (F.col("__mx") + 1).alias(score), F.lit(0).cast("long").alias("tps"),
                       F.lit(0).cast("long").alias("fps"), "P", "N")
    pts = pts.unionByName(start)
    return pts.select(
        *group,
        F.col(score).alias("threshold"),
        F.col("tps").cast("long").alias("tps"),
        F.col("fps").cast("long").alias("fps"),
        F.try_divide("fps", "N").alias("fpr"),
        F.try_divide("tps", "P").alias("tpr"),
    )


def row_losses(long: DataFrame, score: str = "score", y: str = "y", pos_weight: float = 10.0) -> DataFrame:
    """Per-row losses of a logit: BCE, weighted BCE, squared error of the
    probability, and 2-class cross-entropy of the logits (-x, x)."""
    x = F.col(score).cast("double")
    return long.select(
        "*",
        bce_with_logits(x, F.col(y)).alias("bce"),
        bce_with_logits(x, F.col(y), pos_weight).alias("bce_pw"),
        squared_error(sigmoid(x), F.col(y)).alias("mse"),
        cross_entropy_2(F.array(-x, x), F.col(y)).alias("ce2"),
    )


def mean_losses(long: DataFrame, group: Sequence[str] = ("label",), score: str = "score", y: str = "y") -> DataFrame:
    """A10: row-weighted mean of every per-row loss, per group."""
    rl = row_losses(long, score, y)
    return rl.groupBy(*group).agg(*[F.avg(m).alias(m) for m in ("bce", "bce_pw", "mse", "ce2")])


def loss_batch_mean(long: DataFrame, batch: str = "batch_id", group: Sequence[str] = ("label",),
                    score: str = "score", y: str = "y") -> DataFrame:
    """Unweighted mean over batches of the batch-mean BCE."""
    rl = row_losses(long, score, y)
    per_batch = rl.groupBy(*group, batch).agg(F.avg("bce").alias("__b"))
    return per_batch.groupBy(*group).agg(F.avg("__b").alias("bce_batch_mean"))


def argmax_accuracy(long: DataFrame, group: Sequence[str] = ("label",), score: str = "score", y: str = "y") -> DataFrame:
    """Accuracy (mean) and number correct (sum) of argmax over the logits (-x, x)."""
    x = F.col(score).cast("double")
    hit = (argmax(F.array(-x, x)) == F.col(y).cast("long")).cast("long")
    return long.groupBy(*group).agg(F.avg(hit).alias("accuracy"), F.sum(hit).alias("correct"))


def _label_array(labels: Sequence[str], fmt: str) -> Column:
    return F.array(*[F.col(fmt.format(l)).cast("double") for l in labels])


def accuracy_thresh(wide: DataFrame, labels: Sequence[str], thresh: float = 0.5, use_sigmoid: bool = True,
                    logit_fmt: str = "logit_{}") -> DataFrame:
    """Per row the share of labels whose thresholded score equals the label,
    summed over rows and divided by the row count."""
    p = _label_array(labels, logit_fmt)
    yv = _label_array(labels, "{}")
    hits = F.zip_with(p, yv, lambda a, b: ((sigmoid(a) if use_sigmoid else a) > thresh).cast("double") == b)
    per_row = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h.cast("double")) / F.lit(float(len(labels)))
    return wide.agg(F.avg(per_row).alias("accuracy_thresh"), F.sum(per_row).alias("accuracy_thresh_sum"))


def fbeta(wide: DataFrame, labels: Sequence[str], thresh: float = 0.2, beta: float = 2.0, eps: float = 1e-9,
          use_sigmoid: bool = True, logit_fmt: str = "logit_{}") -> DataFrame:
    """Sample-wise F-beta averaged over rows."""
    b2 = beta * beta
    p = _label_array(labels, logit_fmt)
    yv = _label_array(labels, "{}")
    pred = F.transform(p, lambda a: ((sigmoid(a) if use_sigmoid else a) > thresh).cast("double"))

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)

    tp = total(F.zip_with(pred, yv, lambda a, b: a * b))
    prec = tp / (total(pred) + eps)
    rec = tp / (total(yv) + eps)
    f = (prec * rec) / (prec * b2 + rec + eps) * (1 + b2)
    return wide.agg(F.avg(f).alias("fbeta"))
