"""Model training / scoring / evaluation queries.

Spark ML results depend on optimiser details, so these are rows-only checks
(no DuckDB oracle), except the fixed-weight linear scorer, which is plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.scoring import sigmoid
from textloom.operators import metrics as M
from textloom.operators import model as ML
from textloom.operators.history import best_checkpoint
from textloom.operators.split import split_exact
from textloom.plans import sqlfrag as S
from textloom.plans.registry import register
from textloom.session import materialize, scratch_path
from textloom.sources import tables as tb

LABELS = tb.LABELS
SEED = 23
POS_WEIGHT = 10.0


NUM_FEATURES = 1 << 18


def _split_features(spark: SparkSession, sf: str):
    """Word tokens of the labelled documents, exact 80/20 split, features fitted on train.

    The split is ranked on `doc_id` alone and joined to the text afterwards,
    so tokenising happens once; tokens and features are checkpointed, because
    the IDF fit and every per-label fit read them again.
    """
    six = tb.six_labels(spark, sf)
    flags = split_exact(six.select("doc_id"), "doc_id", SEED, train_ratio=None, test_ratio=0.2)
    data = materialize(
        six.join(flags, "doc_id").select("doc_id", T.word_tokens("text").alias("tokens"), "is_train", *LABELS)
    )
    feat_model = ML.fit_features(data.where("is_train = 1"), num_features=NUM_FEATURES)
    feats = materialize(feat_model.transform(data).drop("tf", "tokens"))
    return feat_model, feats


def _long_valid(models, feats) -> DataFrame:
    valid = feats.where("is_train = 0")
    scored = ML.score_per_label(models, valid, "doc_id")
    ys = valid.select("doc_id", *LABELS).unpivot(["doc_id"], LABELS, "label", "y")
    return scored.join(ys, ["doc_id", "label"])


@register("ml_train_per_label")
def ml_train_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """One weighted logistic regression per label over shared features;
    one row per label with its training size and final objective."""
    _, feats = _split_features(spark, sf)
    train = feats.where("is_train = 1")
    models = ML.fit_per_label(train, LABELS, pos_weight=POS_WEIGHT, parallelism=len(LABELS))
    hist = ML.objective_history(spark, models)
    best = best_checkpoint(hist)
    return best.select(
        F.col("run").alias("label"), "n_epochs", "best_epoch", F.round("best_metric", 6).alias("best_objective")
    )


@register("ml_eval")
def ml_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out evaluation: AUC, mean BCE on the probability's logit, accuracy per label."""
    _, feats = _split_features(spark, sf)
    models = ML.fit_per_label(feats.where("is_train = 1"), LABELS, pos_weight=POS_WEIGHT, parallelism=len(LABELS))
    long = _long_valid(models, feats).withColumnRenamed("logit", "score")
    auc = M.auc(long)
    losses = M.mean_losses(long)
    acc = M.argmax_accuracy(long)
    wide = auc.join(losses, "label").join(acc, "label")
    return wide.unpivot(["label"], ["auc", "bce", "accuracy"], "metric", "value")


@register("ml_score")
def ml_score(spark: SparkSession, sf: str) -> DataFrame:
    """Score every unlabelled document with every label's model (long form)."""
    feat_model, feats = _split_features(spark, sf)
    models = ML.fit_per_label(feats.where("is_train = 1"), LABELS, pos_weight=POS_WEIGHT, parallelism=len(LABELS))
    test = tb.test_comments(spark, sf).select("doc_id", T.word_tokens("text").alias("tokens"))
    test_feats = feat_model.transform(test)
    return ML.score_per_label(models, test_feats, "doc_id").select("doc_id", "label", "prob")


@register("ml_model_roundtrip")
def ml_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K04 + S07: save per-label models and their objective history, load both back, and
    score the validation split with the loaded models (best checkpoint read from history)."""
    _, feats = _split_features(spark, sf)
    models = ML.fit_per_label(feats.where("is_train = 1"), LABELS, pos_weight=POS_WEIGHT, parallelism=len(LABELS))
    path = scratch_path(spark, "models")
    ML.save_models(models, path)
    ML.objective_history(spark, models).write.mode("overwrite").parquet(f"{path}/_history")
    loaded = ML.load_models(path, LABELS)
    hist = spark.read.parquet(f"{path}/_history")
    best = best_checkpoint(hist).select(F.col("run").alias("label"), "best_epoch")
    scored = _long_valid(loaded, feats)
    return scored.join(F.broadcast(best), "label").select("doc_id", "label", F.round("prob", 6).alias("prob"), "y", "best_epoch")


def _weight(k: int):
    return ((F.char_length("w") + F.lit(k)) % 7 - 3).cast("double") / F.lit(10.0)


@register(
    "score_linear",
    f"""WITH d AS (SELECT doc_id, {S.word_tokens('text')} AS t FROM documents)
    SELECT doc_id, {', '.join(
        f"round(CASE WHEN len(t) = 0 THEN 0.0 ELSE list_sum(list_transform(t, lambda w: CAST((length(w) + {k}) % 7 - 3 AS DOUBLE) / 10.0)) / len(t) END, 6) AS logit_{l}"
        for k, l in enumerate(LABELS))},
        {', '.join(
        f"CAST(1.0 / (1.0 + exp(-(CASE WHEN len(t) = 0 THEN 0.0 ELSE list_sum(list_transform(t, lambda w: CAST((length(w) + {k}) % 7 - 3 AS DOUBLE) / 10.0)) / len(t) END))) > 0.5 AS INTEGER) AS pred_{l}"
        for k, l in enumerate(LABELS))}
    FROM d""",
)
def score_linear(spark: SparkSession, sf: str) -> DataFrame:
    """M03 built-in model: a fixed-weight linear scorer over word tokens (weight from the
    token length), mean over the document's tokens, one logit and 0/1 prediction per label.

    Tokens are exploded and summed per document by a hash aggregate whose
    partial step runs before the shuffle (one row per document and task).
    """
    d = tb.table(spark, sf, "documents").select("doc_id", F.explode_outer(T.word_tokens("text")).alias("w"))
    sums = d.groupBy("doc_id").agg(
        F.count("w").alias("__n"), *[F.sum(_weight(k)).alias(f"__s{k}") for k in range(len(LABELS))]
    )
    cols = []
    for k, l in enumerate(LABELS):
        logit = F.when(F.col("__n") == 0, F.lit(0.0)).otherwise(F.col(f"__s{k}") / F.col("__n"))
        cols += [F.round(logit, 6).alias(f"logit_{l}"), (sigmoid(logit) > 0.5).cast("int").alias(f"pred_{l}")]
    return sums.select("doc_id", *cols)
