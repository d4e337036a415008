"""Parquet table access and the reference-shaped inputs derived from them.

The fixture definitions here are written once as DataFrame code and once as
SQL (`SQL_FIXTURES`) for the DuckDB oracle; both follow FIXTURES.md part 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# The six label columns standing in for the reference's six toxicity labels.
LABELS = ["toxic", "low_quality", "is_long", "non_english", "has_digit", "has_newline"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def train_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents (train.csv): documents inner join labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def test_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents (test.csv): documents left anti join labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def six_label_columns() -> dict[str, Column]:
    return {
        "toxic": F.col("toxic").cast("int"),
        "low_quality": (F.lit(1) - F.col("quality")).cast("int"),
        "is_long": (F.col("n_chars") > 2000).cast("int"),
        "non_english": (F.col("lang") != "en").cast("int"),
        "has_digit": F.col("text").rlike("[0-9]").cast("int"),
        "has_newline": (F.instr(F.col("text"), "\n") > 0).cast("int"),
    }


def six_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, text` + six 0/1 label columns over the labelled documents."""
    return train_comments(spark, sf_dir).select("doc_id", "text", *[c.alias(n) for n, c in six_label_columns().items()])


def logit_expr(k: int, y: Column) -> Column:
    raw = (F.col("doc_id") * 7919 + F.lit(k * 104729)) % 2001 - 1000
    return raw.cast("double") / F.lit(250.0) + y.cast("double")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id`, six labels and one synthetic logit per label (`logit_<label>`)."""
    lab = six_labels(spark, sf_dir).drop("text")
    return lab.select("*", *[logit_expr(k, F.col(n)).alias(f"logit_{n}") for k, n in enumerate(LABELS)])


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form `(doc_id, label, score, y)`: one row per document and label."""
    wide = scores(spark, sf_dir)
    stack = ", ".join(f"'{n}', logit_{n}, {n}" for n in LABELS)
    return wide.selectExpr("doc_id", f"stack({len(LABELS)}, {stack}) as (label, score, y)")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as sentence pairs: text_b is the next turn (null on the last).

    `lead` over a conversation window would put one very long conversation in
    one task; instead turns get an exact per-conversation rank (turn-quantile
    buckets) and the next turn is an equi-join on (conv_id, rank + 1).
    """
    from textloom.operators.rank import exact_rank, with_quantile_bucket

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    conv, _ = with_quantile_bucket(conv, "turn", "__qb")
    ranked = exact_rank(conv, F.col("__qb"), ["turn"], "__r", partition=["conv_id"]).drop("__qb")
    nxt = ranked.select("conv_id", (F.col("__r") - 1).alias("__r"), F.col("text").alias("text_b"))
    return ranked.join(nxt, ["conv_id", "__r"], "left").select(
        "conv_id", "turn", F.col("text").alias("text_a"), "text_b"
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric histories from events: run = user_id, epoch = 0-based order of (ts, event_id).

    The per-run order is an exact rank with time-quantile buckets, so one very
    active user is still numbered by many tasks.
    """
    from textloom.operators.rank import exact_rank, with_quantile_bucket

    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ev = ev.withColumn("__t", F.unix_micros(F.col("ts").cast("timestamp")))
    ev, _ = with_quantile_bucket(ev, "__t", "__qb")
    r = exact_rank(ev, F.col("__qb"), ["ts", "event_id"], "__r", partition=["user_id"])
    return r.select(
        F.col("user_id").alias("run"),
        (F.col("__r") - 1).cast("long").alias("epoch"),
        F.col("value").alias("metric"),
    )


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with every `<br>` variant rewritten to the exact `<br />` form."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_replace("html", r"<br\s*/?>", "<br />").alias("html"))


# ---------------------------------------------------------------------------
# The same fixtures in DuckDB SQL (oracle side).  Each is a CTE body.
SQL_FIXTURES = {
    "train_comments": "SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
    "test_comments": "SELECT d.* FROM documents d ANTI JOIN labels l USING (doc_id)",
    "six_labels": """SELECT doc_id, text,
        CAST(toxic AS INTEGER) AS toxic,
        CAST(1 - quality AS INTEGER) AS low_quality,
        CAST(n_chars > 2000 AS INTEGER) AS is_long,
        CAST(lang <> 'en' AS INTEGER) AS non_english,
        CAST(regexp_matches(text, '[0-9]') AS INTEGER) AS has_digit,
        CAST(instr(text, chr(10)) > 0 AS INTEGER) AS has_newline
      FROM (SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))""",
}


def sql_logit(k: int, y: str) -> str:
    return f"(CAST((doc_id * 7919 + {k * 104729}) % 2001 - 1000 AS DOUBLE) / CAST(250 AS DOUBLE) + CAST({y} AS DOUBLE))"


SQL_FIXTURES["scores"] = "SELECT doc_id, " + ", ".join(LABELS) + ", " + ", ".join(
    f"{sql_logit(k, n)} AS logit_{n}" for k, n in enumerate(LABELS)
) + " FROM six_labels"
SQL_FIXTURES["long_scores"] = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS label, logit_{n} AS score, {n} AS y FROM scores" for n in LABELS
)
SQL_FIXTURES["pairs"] = """SELECT conv_id, turn, text AS text_a,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS text_b FROM conversations"""
SQL_FIXTURES["history"] = """SELECT user_id AS run,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
    value AS metric FROM events"""
SQL_FIXTURES["html_text"] = "SELECT page_id, regexp_replace(html, '<br\\s*/?>', '<br />', 'g') AS html FROM pages"


def sql_with(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding the named fixtures (dependencies first)."""
    deps = {"scores": ["six_labels"], "long_scores": ["six_labels", "scores"]}
    order: list[str] = []
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    parts = [f"{n} AS ({SQL_FIXTURES[n]})" for n in order]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return "WITH " + ",\n".join(parts) + "\n"
