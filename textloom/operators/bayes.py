"""A closed-form classifier per label (M01-M05, S07, K04, P04): multinomial naive Bayes.

Training is one aggregation over token occurrences for all labels together, so its result is
a table that SQL can state exactly.  Scoring reads the texts once: a document's distinct tokens meet one
row per token that holds the weights of every label.

Model tables: `priors(label, prior, oov)`, `weights(token, w_<label>...)`, where a weight is the log-odds
of the token, and `oov` that of a token that training did not see.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.dictionary import elements
from textloom.session import materialize


def fit(train: DataFrame, tokens: str, labels: Sequence[str], pos_weight: float = 1.0,
        smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """`(priors, weights)`.  A positive document counts `pos_weight` times in the prior and in its tokens' counts.

    Weights are log((p_t + s) / (P + s (V + 1))) - log((n_t + s) / (N + s (V + 1))): p_t and n_t the weighted occurrences of the
    token in positive and negative documents, P and N their totals, V the number of distinct tokens, one more for unseen ones.
    """
    pos, s = F.lit(float(pos_weight)), F.lit(float(smoothing))
    docs = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(l).cast("long")).alias(f"p_{l}") for l in labels])
    counts = materialize(  # one row a distinct token; read for the totals and again for the weights
        elements(train, tokens, "token", *labels)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(l).cast("long")).alias(f"p_{l}") for l in labels])
    )
    totals = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"),
                        *[F.coalesce(F.sum(f"p_{l}"), F.lit(0)).alias(f"t_{l}") for l in labels])

    def log_odds(p, n, total_p, total_n):
        room = s * (F.col("v") + 1)
        return F.log((pos * p + s) / (pos * total_p + room)) - F.log((n + s) / (total_n + room))

    total = totals.select(F.struct("*").alias("t")).scalar()
    weights = counts.withColumn("__t", total).select("*", "__t.*").select("token", *[
        log_odds(F.col(f"p_{l}"), F.col("n") - F.col(f"p_{l}"), F.col(f"t_{l}"), F.col("t") - F.col(f"t_{l}")).alias(f"w_{l}")
        for l in labels])
    head = docs.select("n", *[F.col(f"p_{l}").alias(f"d_{l}") for l in labels]).withColumn("__t", total).select("*", "__t.*")
    rows = F.array(*[
        F.struct(
            F.lit(l).alias("label"),
            (F.log(pos * F.coalesce(F.col(f"d_{l}"), F.lit(0)) + s) - F.log(F.col("n") - F.coalesce(F.col(f"d_{l}"), F.lit(0)) + s)).alias("prior"),
            log_odds(F.lit(0), F.lit(0), F.col(f"t_{l}"), F.col("t") - F.col(f"t_{l}")).alias("oov"))
        for l in labels])
    priors = head.select(F.explode(rows).alias("r")).select("r.*")
    return priors, weights


def score(model: tuple[DataFrame, DataFrame], df: DataFrame, key: str, tokens: str, labels: Sequence[str]) -> DataFrame:
    """`(key, label, logit, prob)` for every row and label; a row without tokens scores its prior."""
    priors, weights = model
    # a document's distinct tokens with their counts: a repeated token travels once
    bag = df.select(key, F.explode_outer(tokens).alias("token")).groupBy(key, "token").agg(F.count("token").alias("n"))
    known = F.col("w_" + labels[0]).isNotNull()
    sums = bag.join(weights, "token", "left").groupBy(key).agg(
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unseen"),
        *[F.coalesce(F.sum(F.col("n") * F.col(f"w_{l}")), F.lit(0.0)).alias(l) for l in labels])
    long = sums.unpivot([key, "unseen"], list(labels), "label", "__w")
    logit = F.col("prior") + F.col("__w") + F.col("unseen") * F.col("oov")
    scored = long.join(F.broadcast(priors), "label").select(key, "label", logit.alias("logit"))  # one row a label
    return scored.withColumn("prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))))


def save(model: tuple[DataFrame, DataFrame], path: str) -> None:
    """The model as two Parquet tables under `path`."""
    for name, table in zip(("priors", "weights"), model):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The model saved by `save`."""
    return spark.read.parquet(f"{path}/priors"), spark.read.parquet(f"{path}/weights")
