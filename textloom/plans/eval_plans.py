"""Scoring and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.scoring import argmax, sigmoid, threshold
from textloom.operators import metrics as M
from textloom.operators.split import batch_assign
from textloom.plans.registry import register
from textloom.sources import tables as tb

LABELS = tb.LABELS
BATCH = 8


def _r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long_with_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Long scores with the sequential batch (size 8, by doc_id) of every document."""
    batches = batch_assign(tb.six_labels(spark, sf).select("doc_id"), "doc_id", BATCH)
    return tb.long_scores(spark, sf).join(batches, "doc_id")


SQL_BATCHED = (
    tb.sql_with("long_scores")
    + f""", bt AS (SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / {BATCH}) AS batch_id FROM six_labels),
    lb AS (SELECT * FROM long_scores JOIN bt USING (doc_id))
"""
)

SQL_AUC_BODY = """g AS (SELECT {grp}, score, sum(y) AS pos, sum(1 - y) AS neg,
        sum(CASE WHEN round_even(score, 0) = y THEN 1 ELSE 0 END) AS hit FROM {src} GROUP BY {grp}, score),
    c AS (SELECT *, sum(neg) OVER (PARTITION BY {grp} ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS nb FROM g),
    a AS (SELECT {grp}, sum(pos * (nb + neg / 2.0)) AS s, sum(pos) AS p, sum(neg) AS n, sum(hit) AS h FROM c GROUP BY {grp}),
    auc AS (SELECT {grp}, CASE WHEN p = 0 OR n = 0 THEN h / (p + n) ELSE s / (p * n) END AS auc, p, n FROM a)
"""


@register(
    "score_threshold",
    tb.sql_with("long_scores")
    + """SELECT doc_id, label, round(1.0 / (1.0 + exp(-score)), 6) AS prob,
        CAST(1.0 / (1.0 + exp(-score)) > 0.5 AS INTEGER) AS pred, CAST(score > 0.5 AS INTEGER) AS pred_raw
    FROM long_scores""",
)
def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """F03 + T23: sigmoid probability and strict 0.5 threshold, on sigmoid and on the raw score."""
    long = tb.long_scores(spark, sf)
    return long.select(
        "doc_id", "label", _r6(sigmoid("score")).alias("prob"),
        threshold("score", 0.5, True).alias("pred"), threshold("score", 0.5, False).alias("pred_raw"),
    )


@register(
    "score_argmax",
    tb.sql_with("long_scores")
    + """SELECT doc_id, label, CAST(CASE WHEN score > -score THEN 1 ELSE 0 END AS BIGINT) AS cls,
        round(greatest(score, -score), 6) AS top_logit FROM long_scores""",
)
def score_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """Argmax class of the two-class logits (-x, x); first maximum on ties."""
    long = tb.long_scores(spark, sf)
    two = F.array(-F.col("score"), F.col("score"))
    return long.select("doc_id", "label", argmax(two).alias("cls"), _r6(F.array_max(two)).alias("top_logit"))


@register(
    "eval_auc",
    tb.sql_with("long_scores")
    + ", "
    + SQL_AUC_BODY.format(grp="label", src="long_scores")
    + "SELECT label, round(auc, 6) AS auc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM auc",
)
def eval_auc(spark: SparkSession, sf: str) -> DataFrame:
    """ROC-AUC of every label in one job."""
    r = M.auc(tb.long_scores(spark, sf))
    return r.select("label", _r6("auc").alias("auc"), "positives", "negatives")


@register(
    "eval_auc_batch_mean",
    SQL_BATCHED
    + ", "
    + SQL_AUC_BODY.format(grp="label, batch_id", src="lb")
    + """SELECT label, round(avg(auc), 6) AS auc_batch_mean, CAST(count(*) AS BIGINT) AS n_batches,
        CAST(sum(CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_fallback FROM auc GROUP BY label""",
)
def eval_auc_batch_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A09 + A15: mean of per-batch AUC, with the accuracy fallback for one-class batches."""
    r = M.auc_batch_mean(long_with_batches(spark, sf))
    return r.select("label", _r6("auc_batch_mean").alias("auc_batch_mean"), "n_batches", "n_fallback")


@register(
    "eval_auc_macro",
    tb.sql_with("long_scores")
    + ", "
    + SQL_AUC_BODY.format(grp="label", src="long_scores")
    + """, sub AS (SELECT avg(ok) AS s FROM (SELECT doc_id, min(CAST(round_even(score, 0) = y AS INTEGER)) AS ok
                                           FROM long_scores GROUP BY doc_id))
    SELECT round(CASE WHEN (SELECT sum(CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) FROM auc) > 0
                 THEN (SELECT s FROM sub) ELSE (SELECT avg(auc) FROM auc) END, 6) AS auc_macro""",
)
def eval_auc_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Macro AUC over the labels (subset accuracy if any label is one-class)."""
    return M.auc_macro(tb.long_scores(spark, sf), "doc_id").select(_r6("auc_macro").alias("auc_macro"))


@register(
    "eval_auc_micro",
    tb.sql_with("long_scores")
    + ", flat AS (SELECT 'all' AS grp, score, y FROM long_scores), "
    + SQL_AUC_BODY.format(grp="grp", src="flat")
    + "SELECT round(auc, 6) AS auc_micro, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM auc",
)
def eval_auc_micro(spark: SparkSession, sf: str) -> DataFrame:
    """Micro AUC over all (row, label) pairs, labels flattened."""
    r = M.auc(tb.long_scores(spark, sf).withColumn("grp", F.lit("all")), ["grp"])
    return r.select(_r6("auc").alias("auc_micro"), "positives", "negatives")


@register(
    "eval_roc_curve",
    tb.sql_with("long_scores")
    + """, g AS (SELECT label, score, sum(y) AS pos, sum(1 - y) AS neg FROM long_scores GROUP BY label, score),
    c AS (SELECT label, score,
            sum(pos) OVER (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
            sum(neg) OVER (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps FROM g),
    t AS (SELECT label, sum(pos) AS p, sum(neg) AS n, max(score) AS mx FROM g GROUP BY label),
    pts AS (SELECT c.label, c.score AS threshold, tps, fps, p, n FROM c JOIN t USING (label)
            UNION ALL SELECT label, mx + 1, 0, 0, p, n FROM t)
    SELECT label, round(threshold, 6) AS threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps,
        round(fps / n, 6) AS fpr, round(tps / p, 6) AS tpr FROM pts""",
)
def eval_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    """ROC curve points of every label."""
    r = M.roc_curve(tb.long_scores(spark, sf))
    return r.select("label", _r6("threshold").alias("threshold"), "tps", "fps", _r6("fpr").alias("fpr"), _r6("tpr").alias("tpr"))


@register(
    "eval_roc_curve_dropped",
    tb.sql_with("long_scores")
    + """, g AS (SELECT label, score, sum(y) AS pos, sum(1 - y) AS neg FROM long_scores GROUP BY label, score),
    c AS (SELECT label, score,
            sum(pos) OVER (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
            sum(neg) OVER (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps FROM g),
    nb AS (SELECT *, lag(tps) OVER w AS tp, lead(tps) OVER w AS tn, lag(fps) OVER w AS fp, lead(fps) OVER w AS fn
           FROM c WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
    kept AS (SELECT * FROM nb WHERE tp IS NULL OR tn IS NULL OR fn - 2 * fps + fp <> 0 OR tn - 2 * tps + tp <> 0),
    t AS (SELECT label, sum(pos) AS p, sum(neg) AS n, max(score) AS mx FROM g GROUP BY label),
    pts AS (SELECT k.label, k.score AS threshold, tps, fps, p, n FROM kept k JOIN t USING (label)
            UNION ALL SELECT label, mx + 1, 0, 0, p, n FROM t)
    SELECT label, round(threshold, 6) AS threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps,
        round(fps / n, 6) AS fpr, round(tps / p, 6) AS tpr FROM pts""",
)
def eval_roc_curve_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """W02 with intermediate collinear points dropped (the ROC library default)."""
    r = M.roc_curve(tb.long_scores(spark, sf), drop_intermediate=True)
    return r.select("label", _r6("threshold").alias("threshold"), "tps", "fps", _r6("fpr").alias("fpr"), _r6("tpr").alias("tpr"))


_SP = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


def _sql_softplus(x: str) -> str:
    return _SP.format(x=x)


@register(
    "eval_losses",
    tb.sql_with("long_scores")
    + f"""SELECT label,
        round(avg({_sql_softplus('score')} - score * y), 6) AS bce,
        round(avg(10.0 * y * {_sql_softplus('-score')} + (1 - y) * {_sql_softplus('score')}), 6) AS bce_pw,
        round(avg(power(1.0 / (1.0 + exp(-score)) - y, 2)), 6) AS mse,
        round(avg(greatest(score, -score) + ln(exp(-score - greatest(score, -score)) + exp(score - greatest(score, -score)))
                  - CASE WHEN y = 1 THEN score ELSE -score END), 6) AS ce2
    FROM long_scores GROUP BY label
    UNION ALL
    SELECT '_all', round(avg({_sql_softplus('score')} - score * y), 6), NULL, NULL, NULL FROM long_scores""",
)
def eval_losses(spark: SparkSession, sf: str) -> DataFrame:
    """A10 + T27: row-weighted mean BCE, weighted BCE (pos_weight 10), MSE of the
    probability and 2-class cross-entropy per label; multi-label soft margin over all."""
    long = tb.long_scores(spark, sf)
    per = M.mean_losses(long)
    soft_margin = M.row_losses(long).agg(F.avg("bce").alias("bce")).select(
        F.lit("_all").alias("label"), "bce",
        *[F.lit(None).cast("double").alias(c) for c in ("bce_pw", "mse", "ce2")],
    )
    both = per.unionByName(soft_margin)
    return both.select("label", *[_r6(c).alias(c) for c in ("bce", "bce_pw", "mse", "ce2")])


@register(
    "eval_loss_batch_mean",
    SQL_BATCHED
    + f"""SELECT label, round(avg(b), 6) AS bce_batch_mean FROM
        (SELECT label, batch_id, avg({_sql_softplus('score')} - score * y) AS b FROM lb GROUP BY label, batch_id)
    GROUP BY label""",
)
def eval_loss_batch_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted mean of batch-mean BCE."""
    return M.loss_batch_mean(long_with_batches(spark, sf)).select("label", _r6("bce_batch_mean").alias("bce_batch_mean"))


@register(
    "eval_accuracy",
    tb.sql_with("long_scores")
    + """SELECT label, round(avg(h), 6) AS accuracy, CAST(sum(h) AS BIGINT) AS correct FROM
        (SELECT label, CAST((CASE WHEN score > -score THEN 1 ELSE 0 END) = y AS INTEGER) AS h FROM long_scores)
    GROUP BY label""",
)
def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Argmax accuracy (mean) and the number correct (the notebook's sum)."""
    r = M.argmax_accuracy(tb.long_scores(spark, sf))
    return r.select("label", _r6("accuracy").alias("accuracy"), F.col("correct").cast("long").alias("correct"))


def _sql_row_mean(expr_fmt: str) -> str:
    return "(" + " + ".join(expr_fmt.format(l=l) for l in LABELS) + f") / {float(len(LABELS))}"


@register(
    "eval_accuracy_thresh",
    tb.sql_with("scores")
    + "SELECT round(avg(a), 6) AS accuracy_thresh, round(sum(a), 6) AS accuracy_thresh_sum FROM (SELECT "
    + _sql_row_mean("CAST(CAST(1.0 / (1.0 + exp(-logit_{l})) > 0.5 AS DOUBLE) = CAST({l} AS DOUBLE) AS DOUBLE)")
    + " AS a FROM scores)",
)
def eval_accuracy_thresh(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholded multi-label accuracy (sigmoid, 0.5)."""
    r = M.accuracy_thresh(tb.scores(spark, sf), LABELS)
    return r.select(_r6("accuracy_thresh").alias("accuracy_thresh"), _r6("accuracy_thresh_sum").alias("accuracy_thresh_sum"))


def _sql_fbeta() -> str:
    pred = {l: f"CAST(1.0 / (1.0 + exp(-logit_{l})) > 0.2 AS DOUBLE)" for l in LABELS}
    tp = " + ".join(f"{pred[l]} * CAST({l} AS DOUBLE)" for l in LABELS)
    sp = " + ".join(pred[l] for l in LABELS)
    sy = " + ".join(f"CAST({l} AS DOUBLE)" for l in LABELS)
    return f"""SELECT round(avg((prec * rec) / (prec * 4.0 + rec + 1e-9) * 5.0), 6) AS fbeta FROM
        (SELECT ({tp}) / (({sp}) + 1e-9) AS prec, ({tp}) / (({sy}) + 1e-9) AS rec FROM scores)"""


@register("eval_fbeta", tb.sql_with("scores") + _sql_fbeta())
def eval_fbeta(spark: SparkSession, sf: str) -> DataFrame:
    """Sample-wise F-beta (threshold 0.2, beta 2, eps 1e-9)."""
    return M.fbeta(tb.scores(spark, sf), LABELS).select(_r6("fbeta").alias("fbeta"))
