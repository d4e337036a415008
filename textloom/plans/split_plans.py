"""Split, batch and shard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.split import batch_assign as batch_op
from textloom.operators.split import random_rank, shard_assign as shard_op, split_labeled as labeled_op
from textloom.plans.registry import register
from textloom.sources import tables as tb

SEED = 23
BATCH = 8
WORLD = 4
EVEN_WORLD = 7


def _md5(key: str, seed) -> str:
    return f"md5(concat(CAST({key} AS VARCHAR), ':', '{seed}'))"


@register(
    "split_exact",
    tb.sql_with("train_comments")
    + f"""SELECT doc_id,
        CAST(r <= round_even(0.7 * n, 0) AS INTEGER) AS is_train,
        CAST(r <= n - ceil(0.2 * n) AS INTEGER) AS is_train_tts
    FROM (SELECT doc_id, row_number() OVER (ORDER BY {_md5('doc_id', SEED)}, doc_id) AS r, count(*) OVER () AS n
          FROM train_comments)""",
)
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact 70/30 ratio split and exact test_size=0.2 split from one seeded rank."""
    r = random_rank(tb.train_comments(spark, sf).select("doc_id"), "doc_id", SEED, "r", total="n")
    n = F.col("n")
    return r.select(
        "doc_id",
        (F.col("r") <= F.bround(F.lit(0.7) * n, 0)).cast("int").alias("is_train"),
        (F.col("r") <= n - F.ceil(F.lit(0.2) * n)).cast("int").alias("is_train_tts"),
    )


@register(
    "batch_assign",
    tb.sql_with("train_comments")
    + f"""SELECT doc_id,
        CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {BATCH}) AS BIGINT) AS batch_id,
        CAST(floor((row_number() OVER (ORDER BY {_md5('doc_id', f'{SEED}:0')}, doc_id) - 1) / {BATCH}) AS BIGINT)
            AS shuffled_batch_id
    FROM train_comments""",
)
def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    """W01 + L03: sequential batches of 8 by doc_id and the epoch-0 shuffled batches."""
    base = tb.train_comments(spark, sf).select("doc_id")
    seq = batch_op(base, "doc_id", BATCH)
    shuf = batch_op(base, "doc_id", BATCH, seed=SEED, epoch=0).withColumnRenamed("batch_id", "shuffled_batch_id")
    return seq.join(shuf, "doc_id")


@register(
    "shard_assign",
    f"""SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {WORLD} AS BIGINT) AS shard FROM documents""",
)
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Round-robin replica shards over all documents."""
    return shard_op(tb.table(spark, sf, "documents").select("doc_id"), "doc_id", WORLD)


@register(
    "shard_assign_even",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5('doc_id', SEED)}, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
    size AS (SELECT CAST(ceil(count(*) / {EVEN_WORLD}.0) * {EVEN_WORLD} AS BIGINT) AS wanted FROM documents)
    SELECT doc_id, CAST(place % {EVEN_WORLD} AS BIGINT) AS shard FROM r
    UNION ALL SELECT doc_id, CAST((place + n) % {EVEN_WORLD} AS BIGINT) FROM r, size WHERE place + n < wanted""",
)
def shard_assign_even(spark: SparkSession, sf: str) -> DataFrame:
    """Shuffled replica shards of equal size; the first rows of the order come again."""
    return shard_op(tb.table(spark, sf, "documents").select("doc_id"), "doc_id", EVEN_WORLD, seed=SEED, even=True)


@register(
    "split_labeled",
    """SELECT d.doc_id, 'train' AS part FROM documents d JOIN labels l USING (doc_id)
    UNION ALL SELECT d.doc_id, 'test' FROM documents d ANTI JOIN labels l USING (doc_id)""",
)
def split_labeled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled (inner join) and unlabelled (left anti join) parts of the corpus."""
    train, test = labeled_op(tb.table(spark, sf, "documents").select("doc_id"), tb.table(spark, sf, "labels"))
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(test.select("doc_id", F.lit("test").alias("part")))
