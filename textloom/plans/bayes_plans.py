"""Closed-form classifier queries (M01-M05, S07, K04, P04) with SQL for every step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bayes
from textloom.operators import metrics as M
from textloom.operators.split import split_exact
from textloom.plans import sqlfrag as S
from textloom.plans.eval_plans import SQL_AUC_BODY
from textloom.plans.registry import register
from textloom.session import scratch_path
from textloom.sources import tables as tb

LABELS = tb.LABELS
SEED = 23
TEST_RATIO = 0.2
POS_WEIGHT = 10.0
DIGITS = 3  # of a logit: sums of many terms differ in their last bits with the order of addition


def _split(spark: SparkSession, sf: str) -> DataFrame:
    six = tb.six_labels(spark, sf)
    flags = split_exact(six.select("doc_id"), "doc_id", SEED, train_ratio=None, test_ratio=TEST_RATIO)
    return six.join(flags, "doc_id").select("doc_id", T.word_tokens("text").alias("tokens"), "is_train", *LABELS)


def _model(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return bayes.fit(split.where("is_train = 1"), "tokens", LABELS, POS_WEIGHT)


def _scored_rest(split: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    rest = split.where("is_train = 0")
    ys = rest.select("doc_id", *LABELS).unpivot(["doc_id"], LABELS, "label", "y")
    return bayes.score(model, rest, "doc_id", "tokens", LABELS).join(ys, ["doc_id", "label"])


def _odds(p: str, n: str, tp: str, tn: str) -> str:
    return f"(ln(({POS_WEIGHT} * {p} + 1) / ({POS_WEIGHT} * {tp} + v + 1)) - ln(({n} + 1) / ({tn} + v + 1)))"


SQL_MODEL = (
    tb.sql_with("six_labels", "test_comments")
    + f""", sp AS (SELECT *, {S.word_tokens('text')} AS tokens, row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':{SEED}')), doc_id)
        <= count(*) OVER () - ceil({TEST_RATIO} * count(*) OVER ()) AS is_train FROM six_labels),
    tk AS (SELECT unnest(tokens) AS token, {', '.join(LABELS)} FROM sp WHERE is_train),
    ct AS (SELECT token, count(*) AS n, {', '.join(f'sum({l}) AS p_{l}' for l in LABELS)} FROM tk GROUP BY token),
    tot AS (SELECT count(*) AS v, sum(n) AS t, {', '.join(f'sum(p_{l}) AS t_{l}' for l in LABELS)} FROM ct),
    dc AS (SELECT count(*) AS nd, {', '.join(f'sum({l}) AS d_{l}' for l in LABELS)} FROM sp WHERE is_train),
    wt AS (SELECT token, {', '.join(_odds(f'p_{l}', f'(n - p_{l})', f't_{l}', f'(t - t_{l})') + f' AS w_{l}' for l in LABELS)} FROM ct, tot),
    pr AS ({' UNION ALL '.join(f"SELECT '{l}' AS label, ln({POS_WEIGHT} * d_{l} + 1) - ln(nd - d_{l} + 1) AS prior, {_odds('0', '0', f't_{l}', f'(t - t_{l})')} AS oov FROM dc, tot" for l in LABELS)})
"""
)


def _sql_scored(source: str, where: str, name: str) -> str:
    weighted = ", ".join(f"struct_pack(label := '{l}', w := w_{l})" for l in LABELS)
    return f""", docs_{name} AS (SELECT doc_id, {S.word_tokens('text')} AS tokens FROM {source} WHERE {where}),
    occ_{name} AS (SELECT doc_id, unnest(tokens) AS token FROM docs_{name}),
    sums_{name} AS (SELECT o.doc_id, p.label, sum(CASE p.label {' '.join(f"WHEN '{l}' THEN coalesce(w_{l}, oov)" for l in LABELS)} END) AS s
        FROM occ_{name} o LEFT JOIN wt USING (token) CROSS JOIN pr p GROUP BY o.doc_id, p.label),
    {name} AS (SELECT d.doc_id, p.label, round(p.prior + coalesce(s.s, 0), {DIGITS}) AS logit
        FROM docs_{name} d CROSS JOIN pr p LEFT JOIN sums_{name} s ON s.doc_id = d.doc_id AND s.label = p.label)
"""


SQL_REST = SQL_MODEL + _sql_scored("sp", "NOT is_train", "rest") + (
    ", ys AS (" + " UNION ALL ".join(f"SELECT doc_id, '{l}' AS label, {l} AS y FROM sp" for l in LABELS) + ")")


@register(
    "nb_train",
    SQL_MODEL + "SELECT token, " + ", ".join(f"round(w_{l}, 6) AS w_{l}" for l in LABELS) + " FROM wt",
)
def nb_train(spark: SparkSession, sf: str) -> DataFrame:
    """The weights of every training token for every label."""
    _, weights = _model(_split(spark, sf))
    return weights.select("token", *[F.round(f"w_{l}", 6).alias(f"w_{l}") for l in LABELS])


@register("nb_score", SQL_MODEL + _sql_scored("test_comments", "true", "found") + "SELECT doc_id, label, logit FROM found")
def nb_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every unlabelled document scored for every label in one pass over the texts."""
    test = tb.test_comments(spark, sf).select("doc_id", T.word_tokens("text").alias("tokens"))
    return bayes.score(_model(_split(spark, sf)), test, "doc_id", "tokens", LABELS).select(
        "doc_id", "label", F.round("logit", DIGITS).alias("logit"))


@register(
    "nb_eval",
    SQL_REST
    + ", ev AS (SELECT r.label, r.logit AS score, CAST(y.y AS INTEGER) AS y FROM rest r JOIN ys y ON y.doc_id = r.doc_id AND y.label = r.label), "
    + SQL_AUC_BODY.format(grp="label", src="ev")
    + """, ac AS (SELECT label, avg(CASE WHEN (score > 0) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM ev GROUP BY label)
    SELECT label, round(auc, 6) AS auc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, round(accuracy, 6) AS accuracy
    FROM auc JOIN ac USING (label)""",
)
def nb_eval(spark: SparkSession, sf: str) -> DataFrame:
    """AUC and accuracy of every label on the held-out documents."""
    split = _split(spark, sf)
    long = _scored_rest(split, _model(split)).select("label", F.round("logit", DIGITS).alias("score"), "y")
    hit = ((F.col("score") > 0) == (F.col("y") == 1)).cast("double")
    acc = long.groupBy("label").agg(F.round(F.avg(hit), 6).alias("accuracy"))
    return M.auc(long).withColumn("auc", F.round("auc", 6)).join(acc, "label")


@register(
    "nb_roundtrip",
    SQL_REST + "SELECT r.doc_id, r.label, r.logit, CAST(y.y AS INTEGER) AS y FROM rest r JOIN ys y ON y.doc_id = r.doc_id AND y.label = r.label",
)
def nb_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """K04 + S07: the model saved, loaded, and applied to the held-out documents."""
    split = _split(spark, sf)
    path = scratch_path(spark, "nb-model")
    bayes.save(_model(split), path)
    return _scored_rest(split, bayes.load(spark, path)).select("doc_id", "label", F.round("logit", DIGITS).alias("logit"), "y")
