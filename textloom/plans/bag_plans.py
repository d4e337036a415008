"""TF-IDF features, gradient steps and a model per batch, each with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import bag as B
from textloom.operators import encode as E
from textloom.operators.dictionary import sent_if_small
from textloom.operators.batch_model import score_batches
from textloom.plans.bayes_plans import SQL_MODEL, _split
from textloom.plans.encode_plans import CLS, EOS, MAX_LEN, PAD, SQL_FIXED_CTES, UNK, _doc_tokens
from textloom.plans.registry import register
from textloom.plans.text_plans import word_vocab
from textloom.session import materialize
from textloom.sources import tables as tb

LABELS = tb.LABELS
MIN_ROWS = 5
STEPS, RATE, REG, POS_WEIGHT = 3, 0.5, 0.01, 10.0

_SQL_BAGS = SQL_MODEL + f""", occ AS (SELECT doc_id, is_train, unnest(tokens) AS token FROM sp),
    bags AS (SELECT doc_id, token, count(*) AS n FROM occ GROUP BY doc_id, token),
    train AS (SELECT * FROM sp WHERE is_train),
    dfs AS (SELECT token, count(DISTINCT doc_id) AS in_rows FROM occ WHERE is_train GROUP BY token HAVING count(DISTINCT doc_id) >= {MIN_ROWS}),
    idfs AS (SELECT token, in_rows, ln(((SELECT count(*) FROM train) + 1)::DOUBLE / (in_rows + 1)) AS idf FROM dfs),
    feats AS (SELECT doc_id, token, n, n * idf AS weight FROM bags JOIN idfs USING (token))"""


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(the split's rows, their TF-IDF features with frequencies of the training rows)."""
    split = materialize(_split(spark, sf))
    bags = materialize(B.bag(split, "doc_id"))
    train = split.where("is_train = 1").select("doc_id")
    idf = B.inverse_frequencies(bags.join(train, "doc_id", "left_semi"), train.count(), MIN_ROWS)
    return split, B.tfidf(bags, sent_if_small(idf.select("token", "idf")), "doc_id")


@register("feat_tfidf", _SQL_BAGS + " SELECT doc_id, token, n::BIGINT AS n, round(weight, 6) AS weight FROM feats")
def feat_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    """Exact TF-IDF, a row per document and distinct token."""
    return _features(spark, sf)[1].select("doc_id", "token", "n", F.round("weight", 6).alias("weight"))


def _sql_steps() -> str:
    """Bias as the empty token; x = ln(1 + n) * idf, scaled to length 1 a document."""
    per = lambda f: ", ".join(f(l) for l in LABELS)
    out = [_SQL_BAGS + f""", raw AS (SELECT doc_id, token, ln(1 + n) * idf AS v FROM bags JOIN idfs USING (token)),
    x AS MATERIALIZED (SELECT doc_id, token, v / len AS x FROM raw JOIN (SELECT doc_id, sqrt(sum(v * v)) AS len FROM raw GROUP BY doc_id HAVING sum(v * v) > 0) USING (doc_id)
        WHERE doc_id IN (SELECT doc_id FROM train) UNION ALL SELECT doc_id, '', 1.0 FROM train),
    w0 AS (SELECT DISTINCT token, {per(lambda l: f'0.0::DOUBLE AS w_{l}')} FROM x)"""]
    for s in range(STEPS):
        out.append(f"""z{s} AS (SELECT doc_id, {per(lambda l: f'sum(x * w_{l}) AS z_{l}')} FROM x JOIN w{s} USING (token) GROUP BY doc_id),
    r{s} AS (SELECT doc_id, {per(lambda l: f'(1 / (1 + exp(-z_{l})) - {l}) * CASE WHEN {l} = 1 THEN {POS_WEIGHT} ELSE 1.0 END / (SELECT count(*) FROM train) AS r_{l}')}
        FROM z{s} JOIN train USING (doc_id)),
    g{s} AS (SELECT token, {per(lambda l: f'sum(x * r_{l}) AS g_{l}')} FROM x JOIN r{s} USING (doc_id) GROUP BY token),
    w{s + 1} AS MATERIALIZED (SELECT token, {per(lambda l: f"w_{l} - {RATE} * (g_{l} + CASE WHEN token = '' THEN 0.0 ELSE {REG} END * w_{l}) AS w_{l}")}
        FROM w{s} JOIN g{s} USING (token))""")
    return ",\n".join(out)


def _fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    split, feats = _features(spark, sf)
    idf = F.col("weight") / F.col("n")
    raw = feats.select("doc_id", "token", (F.log(1 + F.col("n")) * idf).alias("v"))
    size = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len")).where("len > 0")
    x = materialize(raw.join(size, "doc_id").select("doc_id", "token", (F.col("v") / F.col("len")).alias("x")))
    weights = B.fit_gradient(x, split.where("is_train = 1"), "doc_id", "x", LABELS, STEPS, RATE, REG, POS_WEIGHT)
    return split, x, weights


@register("gd_train", _sql_steps() + f" SELECT token, {', '.join(f'round(w_{l}, 6) AS w_{l}' for l in LABELS)} FROM w{STEPS}")
def gd_train(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of one weighted logistic regression per label after a few full-batch steps."""
    return _fitted(spark, sf)[2].select("token", *[F.round(f"w_{l}", 6).alias(f"w_{l}") for l in LABELS])


class _WeightedIds:
    """The query's model: a small integer table, a logit per label from the real positions' ids."""

    def __init__(self):
        self.table = np.arange(1, len(LABELS) + 1, dtype=np.int64)  # a real one would read its weights here

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x, m = ids.astype(np.int64), mask.astype(np.int64)
        return np.stack([((x * t % 7 - 3) * m).sum(axis=1) / m.sum(axis=1) for t in self.table], axis=1)


@register(
    "score_batch_model",
    SQL_FIXED_CTES + ", m AS (SELECT doc_id, ids, list_transform(ids, lambda x: CASE WHEN x <> " + str(PAD) + " THEN 1 ELSE 0 END) AS mask FROM fx) SELECT doc_id, "
    + ", ".join(f"round(list_sum(list_transform(range(1, {MAX_LEN} + 1), lambda i: (ids[i] * {k + 1} % 7 - 3) * mask[i]))::DOUBLE / list_sum(mask), 6) AS logit_{l}"
                for k, l in enumerate(LABELS))
    + " FROM m",
)
def score_batch_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model object made once a worker, called on batches of encoded documents."""
    enc = E.encode_single(_doc_tokens(spark, sf), "doc_id", "tokens", word_vocab(spark, sf), MAX_LEN, prefix=[CLS], suffix=[EOS],
                          pad_id=PAD, unk_id=UNK, mask_rule="ne_pad")
    names = [f"logit_{l}" for l in LABELS]
    got = score_batches(enc, ["doc_id"], {"input_ids": MAX_LEN, "input_mask": MAX_LEN}, _WeightedIds, names)
    return got.select("doc_id", *[F.round(n, 6).alias(n) for n in names])
