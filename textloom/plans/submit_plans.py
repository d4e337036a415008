"""Submission and file round-trip queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textloom.functions.scoring import sigmoid
from textloom.operators import submit as SB
from textloom.plans.registry import register
from textloom.session import scratch_path
from textloom.sources import files as FS
from textloom.sources import tables as tb
from textloom.sources.parallel_csv import read_csv_parallel

LABELS = tb.LABELS


def test_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Model output for the unlabelled documents: the logit rule without the label term."""
    test = tb.test_comments(spark, sf).select("doc_id")
    return test.select("doc_id", *[tb.logit_expr(k, F.lit(0)).alias(f"logit_{l}") for k, l in enumerate(LABELS)])


def _sql_test_scores() -> str:
    cols = ", ".join(f"{tb.sql_logit(k, '0')} AS logit_{l}" for k, l in enumerate(LABELS))
    return f"test_scores AS (SELECT doc_id, {cols} FROM test_comments)"


def _r6(c):
    return F.round(c, 6)


def _prob_sql(l: str) -> str:
    return f"round(1.0 / (1.0 + exp(-logit_{l})), 6) AS {l}"


SQL_SUBMISSION = (
    tb.sql_with("test_comments")[:-1]
    + ", "
    + _sql_test_scores()
    + "\nSELECT CAST(doc_id AS VARCHAR) AS id, "
    + ", ".join(_prob_sql(l) for l in LABELS)
    + " FROM test_scores"
)


@register("sink_submission", SQL_SUBMISSION)
def sink_submission(spark: SparkSession, sf: str) -> DataFrame:
    """Submission CSV (id + one probability per label, header, no index) written to
    the shared scratch folder and read back with an explicit schema."""
    preds = test_scores(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), *[sigmoid(f"logit_{l}").alias(l) for l in LABELS]
    )
    path = scratch_path(spark, "submission")
    FS.write_csv(preds, path, header=True)
    schema = Ty.StructType([Ty.StructField("id", Ty.StringType())] + [Ty.StructField(l, Ty.DoubleType()) for l in LABELS])
    back = FS.read_csv(spark, path, schema, header=True)
    return back.select("id", *[_r6(F.col(l)).alias(l) for l in LABELS])


@register(
    "sink_raw_scores",
    tb.sql_with("test_comments")[:-1] + ", " + _sql_test_scores()
    + "\nSELECT CAST(doc_id AS VARCHAR) AS id, " + ", ".join(f"round(logit_{l}, 6) AS logit_{l}" for l in LABELS)
    + " FROM test_scores",
)
def sink_raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Raw logits written as CSV and read back."""
    raw = test_scores(spark, sf).select(F.col("doc_id").cast("string").alias("id"), *[f"logit_{l}" for l in LABELS])
    path = scratch_path(spark, "raw-scores")
    FS.write_csv(raw, path, header=True)
    schema = Ty.StructType([Ty.StructField("id", Ty.StringType())] + [Ty.StructField(f"logit_{l}", Ty.DoubleType()) for l in LABELS])
    back = FS.read_csv(spark, path, schema, header=True)
    return back.select("id", *[_r6(F.col(f"logit_{l}")).alias(f"logit_{l}") for l in LABELS])


@register(
    "submission_fill",
    tb.sql_with("test_comments")[:-1] + ", " + _sql_test_scores()
    + "\nSELECT CAST(t.doc_id AS VARCHAR) AS id, " + ", ".join(_prob_sql(l) for l in LABELS)
    + " FROM test_comments t LEFT JOIN test_scores USING (doc_id)",
)
def submission_fill(spark: SparkSession, sf: str) -> DataFrame:
    """S06 + J04/J06: template (test ids, written and read back as CSV) filled by key join."""
    template = tb.test_comments(spark, sf).select(F.col("doc_id").cast("string").alias("id"))
    path = scratch_path(spark, "template")
    FS.write_csv(template, path, header=True)
    tmpl = FS.read_csv(spark, path, Ty.StructType([Ty.StructField("id", Ty.StringType())]), header=True)
    preds = test_scores(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), *[sigmoid(f"logit_{l}").alias(l) for l in LABELS]
    )
    filled = SB.fill_template(tmpl, preds, "id", LABELS)
    return filled.select("id", *[_r6(F.col(l)).alias(l) for l in LABELS])


@register(
    "submission_combine",
    tb.sql_with("test_comments")[:-1] + ", " + _sql_test_scores()
    + "\nSELECT CAST(doc_id AS VARCHAR) AS id, "
    + ", ".join(f"CAST(1.0 / (1.0 + exp(-logit_{l})) > 0.5 AS INTEGER) AS {l}" for l in LABELS)
    + " FROM test_scores",
)
def submission_combine(spark: SparkSession, sf: str) -> DataFrame:
    """S03 + U02 + J05: one thresholded result table per label (label names read from a
    class-list file) stacked long and pivoted wide in one shuffle."""
    cls_path = scratch_path(spark, "classes")
    FS.write_lines(spark.createDataFrame([(l, i) for i, l in enumerate(LABELS)], "label string, i int"), "label", "i", cls_path)
    labels = [r["label"] for r in FS.read_class_list(spark, cls_path).orderBy("label_idx").collect()]  # a handful of names
    ts = test_scores(spark, sf)
    per_label = {
        l: ts.select(F.col("doc_id").cast("string").alias("id"), (sigmoid(f"logit_{l}") > 0.5).cast("int").alias("pred"))
        for l in labels
    }
    wide = SB.combine_labels(SB.stack_labels(per_label, "id", "pred"), "id", labels)
    return wide.select("id", *[F.col(l).cast("int").alias(l) for l in labels])


@register(
    "src_csv_roundtrip",
    tb.sql_with("six_labels")
    + "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars, "
    + ", ".join(LABELS) + " FROM six_labels",
)
def src_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled table as a quoted, multi-line CSV with header, read back unchanged."""
    six = tb.six_labels(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment_text"), *LABELS)
    path = scratch_path(spark, "train-csv")
    FS.write_csv(six, path, header=True)
    back = FS.read_csv(spark, path, FS.comments_schema(LABELS), header=True)
    return back.select(
        "id", F.md5("comment_text").alias("text_md5"), F.char_length("comment_text").cast("long").alias("n_chars"), *LABELS
    )


@register(
    "src_csv_parallel",
    "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars, lang, source FROM documents",
)
def src_csv_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as a quoted, multi-line CSV, each file read by as many tasks as it has splits."""
    docs = tb.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment_text"), "lang", "source")
    path = scratch_path(spark, "documents-csv")
    FS.write_csv(docs, path, header=True)
    back = read_csv_parallel(spark, path, docs.schema)
    return back.select("id", F.md5("comment_text").alias("text_md5"), F.char_length("comment_text").cast("long").alias("n_chars"), "lang", "source")


@register(
    "prep_reformat",
    tb.sql_with("six_labels", "test_comments")
    + "SELECT 'train' AS part, md5(text) AS text_md5, " + ", ".join(LABELS) + " FROM six_labels "
    + "UNION ALL SELECT 'test', md5(text), " + ", ".join("0" for _ in LABELS) + " FROM test_comments",
)
def prep_reformat(spark: SparkSession, sf: str) -> DataFrame:
    """P01 + P02 + K02 + S02: drop the id, add zero labels to the unlabelled table, write both
    header-less, read them back by position."""
    train = tb.six_labels(spark, sf).drop("doc_id").select(F.col("text").alias("Text"), *LABELS)
    test = tb.test_comments(spark, sf).select(F.col("text").alias("Text")).withColumns({l: F.lit(0) for l in LABELS})
    schema = FS.comments_schema(LABELS, text_col="Text", with_id=False)
    out = None
    for part, df in (("train", train), ("test", test)):
        path = scratch_path(spark, f"temp-{part}")
        FS.write_csv(df, path, header=False)
        back = FS.read_csv(spark, path, schema, header=False).select(
            F.lit(part).alias("part"), F.md5("Text").alias("text_md5"), *LABELS
        )
        out = back if out is None else out.unionByName(back)
    return out
