"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.scoring import sigmoid
from textloom.operators import profile
from textloom.operators.split import sample_n
from textloom.plans import sqlfrag as S
from textloom.plans.registry import register
from textloom.sources import tables as tb

LABELS = tb.LABELS
HEAD_N = 5
SAMPLE_N = 50
SAMPLE_SEED = 7


@register(
    "eda_row_counts",
    tb.sql_with("train_comments", "test_comments")
    + "SELECT 'train' AS dataset, CAST(count(*) AS BIGINT) AS n_rows FROM train_comments "
    "UNION ALL SELECT 'test', CAST(count(*) AS BIGINT) FROM test_comments",
)
def eda_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the labelled and unlabelled tables."""
    train = tb.train_comments(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("train").alias("dataset"), "n_rows")
    test = tb.test_comments(spark, sf).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("test").alias("dataset"), "n_rows")
    return train.unionByName(test)


@register(
    "eda_value_counts",
    tb.sql_with("six_labels")
    + " UNION ALL ".join(
        f"SELECT '{l}' AS label, CAST({l} AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS n FROM six_labels GROUP BY {l}"
        for l in LABELS
    ),
)
def eda_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Value counts of every label column."""
    return profile.value_counts(tb.six_labels(spark, sf), LABELS)


@register(
    "eda_label_prevalence",
    tb.sql_with("six_labels")
    + " UNION ALL ".join(
        f"""SELECT '{l}' AS label, CAST(sum({l}) AS BIGINT) AS positives, CAST(count(*) - sum({l}) AS BIGINT) AS negatives,
            round(100.0 * sum({l}) / count(*), 6) AS pct, round(sum({l}) / (count(*) - sum({l})), 6) AS pos_neg_ratio
            FROM six_labels"""
        for l in LABELS
    ),
)
def eda_label_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """Positives, percentage and pos:neg ratio of every label, one pass."""
    return profile.label_prevalence(tb.six_labels(spark, sf), LABELS)


def _sql_pred_prevalence() -> str:
    from textloom.plans.submit_plans import _sql_test_scores

    preds = ", ".join(f"CAST(1.0 / (1.0 + exp(-logit_{l})) > 0.5 AS INTEGER) AS {l}" for l in LABELS)
    body = " UNION ALL ".join(
        f"""SELECT '{l}' AS label, CAST(sum({l}) AS BIGINT) AS positives, CAST(count(*) - sum({l}) AS BIGINT) AS negatives,
            round(100.0 * sum({l}) / (SELECT count(*) FROM train_comments), 6) AS pct,
            round(sum({l}) / (count(*) - sum({l})), 6) AS pos_neg_ratio FROM preds"""
        for l in LABELS
    )
    return (tb.sql_with("train_comments", "test_comments")[:-1] + ", " + _sql_test_scores()
            + f", preds AS (SELECT doc_id, {preds} FROM test_scores)\n" + body)


@register("eda_pred_prevalence", _sql_pred_prevalence())
def eda_pred_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """A04 with the reference's denominator (D13): positives among the thresholded test
    predictions, as a percentage of the *training* row count."""
    from textloom.plans.submit_plans import test_scores

    n_train = tb.train_comments(spark, sf).agg(F.count(F.lit(1))).scalar()  # a subquery of the same plan
    preds = test_scores(spark, sf).select(
        "doc_id", *[(sigmoid(f"logit_{l}") > 0.5).cast("int").alias(l) for l in LABELS]
    )
    return profile.label_prevalence(preds, LABELS, denominator=n_train)


@register(
    "eda_text_length",
    """SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(max(length(text)) AS BIGINT) AS max_chars,
        round(avg(length(text)), 6) AS avg_chars,
        CAST(arg_max(doc_id, struct_pack(l := length(text), d := -doc_id)) AS BIGINT) AS longest_doc
    FROM documents GROUP BY lang""",
)
def eda_text_length(spark: SparkSession, sf: str) -> DataFrame:
    """Longest text (code points) per language, with the document holding it."""
    d = tb.table(spark, sf, "documents").select("doc_id", "lang", F.char_length("text").alias("n"))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.max("n").cast("long").alias("max_chars"),
        F.round(F.avg("n"), 6).alias("avg_chars"),
        F.max_by("doc_id", F.struct(F.col("n"), -F.col("doc_id"))).alias("longest_doc"),
    )


def _describe_input(spark: SparkSession, sf: str) -> DataFrame:
    long = tb.long_scores(spark, sf).select(F.concat(F.lit("logit_"), "label").alias("column"), F.col("score").alias("v"))
    chars = tb.table(spark, sf, "documents").select(F.lit("n_chars").alias("column"), F.col("n_chars").cast("double").alias("v"))
    return long.unionByName(chars)


@register(
    "eda_describe",
    tb.sql_with("long_scores")
    + """, d AS (SELECT 'logit_' || label AS "column", score AS v FROM long_scores
              UNION ALL SELECT 'n_chars', CAST(n_chars AS DOUBLE) FROM documents)
    SELECT "column", CAST(count(v) AS BIGINT) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
        round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
        round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max
    FROM d GROUP BY "column" """,
)
def eda_describe(spark: SparkSession, sf: str) -> DataFrame:
    """describe() of every logit column and of n_chars, exact quartiles."""
    d = profile.describe(_describe_input(spark, sf), "column", "v")
    return d.select(
        "column", F.col("count").cast("long").alias("count"),
        *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")],
    )


@register(
    "eda_score_hist",
    tb.sql_with("long_scores")
    + """, v AS (SELECT label, 'raw' AS kind, score AS v FROM long_scores
              UNION ALL SELECT label, 'sigmoid', 1.0 / (1.0 + exp(-score)) FROM long_scores),
    r AS (SELECT label, kind, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                 CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v GROUP BY label, kind),
    b AS (SELECT v.label, v.kind, CAST(least(floor((v.v - r.lo) / (r.hi - r.lo) * 10), 9) + 1 AS INTEGER) AS bin
          FROM v JOIN r USING (label, kind)),
    c AS (SELECT label, kind, bin, count(*) AS n FROM b GROUP BY ALL),
    a AS (SELECT label, kind, lo, hi, CAST(unnest(range(1, 11)) AS INTEGER) AS bin FROM r)
    SELECT a.label, a.kind, a.bin, round(lo + (hi - lo) * (a.bin - 1) / 10, 6) AS bin_lo,
        round(lo + (hi - lo) * a.bin / 10, 6) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM a LEFT JOIN c USING (label, kind, bin)""",
)
def eda_score_hist(spark: SparkSession, sf: str) -> DataFrame:
    """10-bin histograms of raw and sigmoid scores per label."""
    long = tb.long_scores(spark, sf)
    v = long.select("label", F.lit("raw").alias("kind"), F.col("score").alias("v")).unionByName(
        long.select("label", F.lit("sigmoid").alias("kind"), sigmoid("score").alias("v"))
    )
    return profile.histogram(v, ["label", "kind"], "v", 10)


@register(
    "eda_head",
    tb.sql_with("six_labels")
    + f"SELECT doc_id, md5(text) AS text_md5, {', '.join(LABELS)} FROM six_labels ORDER BY doc_id LIMIT {HEAD_N}",
)
def eda_head(spark: SparkSession, sf: str) -> DataFrame:
    """First rows by key (a top-k, no full sort)."""
    six = tb.six_labels(spark, sf)
    return six.orderBy("doc_id").limit(HEAD_N).select("doc_id", F.md5("text").alias("text_md5"), *LABELS)


@register(
    "sample_n",
    f"""SELECT doc_id, lang FROM documents
    ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':', '{SAMPLE_SEED}')), doc_id LIMIT {SAMPLE_N}""",
)
def sample_n_query(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly n documents without replacement, seeded."""
    docs = tb.table(spark, sf, "documents").select("doc_id", "lang")
    return sample_n(docs, "doc_id", SAMPLE_N, SAMPLE_SEED)


_ = S
