"""Bag-of-words features without hashing, and linear models fitted to them by full-batch steps.

A bag is a table (key, token, n): one row per distinct token of a row.  Features and weights are
tables too, so nothing collides and every step can be stated in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.dictionary import elements, sent_if_small
from textloom.session import materialize

BIAS = ""  # the token of the constant feature; no token is empty


def bag(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """`(key, token, n)`: rows are shuffled whole, by key, and counted where they are, so
    what is made from the bags by key needs no shuffle."""
    return elements(df.select(key, tokens).repartition(key), tokens, "token", key).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequencies(bags: DataFrame, n_rows: int, min_rows: int = 1) -> DataFrame:
    """`(token, in_rows, idf)`, idf = ln((n_rows + 1) / (in_rows + 1)), of tokens in at least `min_rows` rows."""
    per = bags.groupBy("token").agg(F.count(F.lit(1)).alias("in_rows")).where(F.col("in_rows") >= min_rows)
    return per.withColumn("idf", F.log(F.lit(float(n_rows + 1)) / (F.col("in_rows") + 1)))


def tfidf(bags: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """`(key, token, n, weight)`, weight = n * idf; tokens without an idf are left out.  Sparse: only what occurs."""
    return bags.join(idf.select("token", "idf"), "token").select(key, "token", "n", (F.col("n") * F.col("idf")).alias("weight"))


def fit_gradient(features: DataFrame, rows: DataFrame, key: str, value: str, labels: Sequence[str], steps: int,
                 rate: float = 1.0, reg: float = 0.0, pos_weight: float = 1.0) -> DataFrame:
    """`(token, w_<label>...)`: weights of all labels' logistic regressions after `steps` full-batch gradient
    steps from zero; `BIAS` is the constant term's token, which `reg` spares.

    `features` has key, token and `value`; `rows` has key and 0/1 labels (a row without features
    counts).  A positive row counts `pos_weight` times.  A step is two aggregations over the features
    for all labels together: scores by row, then gradients by token.  The weights of each step are
    a table of their own, so the plan doesn't grow with the steps; the features are dealt out by key
    once, and stay there if the weights are small enough to be sent to them."""
    ys = materialize(rows.select(key, *labels))
    x = features.select(key, "token", F.col(value).cast("double").alias("__x")).unionByName(
        ys.select(key, F.lit(BIAS).alias("token"), F.lit(1.0).alias("__x")))
    x = materialize(x.join(ys.select(key), key, "left_semi").repartition(key))
    weights = sent_if_small(x.select("token").distinct().select("token", *[F.lit(0.0).alias(f"w_{l}") for l in labels]))
    n = float(max(1, ys.count()))

    def residual(l: str) -> Column:
        p = 1 / (1 + F.exp(-F.col(f"__z_{l}")))
        return ((p - F.col(l)) * F.when(F.col(l) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)) / F.lit(n)).alias(f"__r_{l}")

    for _ in range(steps):
        scores = x.join(weights, "token").groupBy(key).agg(*[F.sum(F.col("__x") * F.col(f"w_{l}")).alias(f"__z_{l}") for l in labels])
        rest = scores.join(ys, key).select(key, *[residual(l) for l in labels])
        slope = x.join(rest, key).groupBy("token").agg(*[F.sum(F.col("__x") * F.col(f"__r_{l}")).alias(f"__g_{l}") for l in labels])
        held = F.when(F.col("token") == BIAS, F.lit(0.0)).otherwise(F.lit(float(reg)))
        weights = sent_if_small(weights.join(slope, "token").select("token", *[
            (F.col(f"w_{l}") - F.lit(float(rate)) * (F.col(f"__g_{l}") + held * F.col(f"w_{l}"))).alias(f"w_{l}") for l in labels]))
    return weights


def score_weights(features: DataFrame, rows: DataFrame, key: str, value: str, weights: DataFrame, labels: Sequence[str]) -> DataFrame:
    """`(key, z_<label>...)`: logits of every row; tokens without a weight count nothing."""
    bias = F.broadcast(weights.where(F.col("token") == BIAS).select(*[F.col(f"w_{l}").alias(f"__b_{l}") for l in labels]))  # one row
    sums = features.join(weights, "token").groupBy(key).agg(*[F.sum(F.col(value) * F.col(f"w_{l}")).alias(f"__z_{l}") for l in labels])
    joined = rows.select(key).join(sums, key, "left").withColumn("__one", F.lit(1)).join(bias.withColumn("__one", F.lit(1)), "__one")
    return joined.select(key, *[(F.coalesce(f"__z_{l}", F.lit(0.0)) + F.col(f"__b_{l}")).alias(f"z_{l}") for l in labels])
