"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS_PER_RUN = 512


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.  Only a plain local session (tests) gets one of its own."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_KEY} is not set: name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-llm-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


_collected: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `written` makes inside the block when it is left.  Write what is
    wanted of them inside, as nothing can be read from them later."""
    _collected.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _collected.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: it is computed once, its lineage
    ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if _collected:
        _collected[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by `written` once nothing reads it any more."""
    spark = df.sparkSession
    base = shared_dir(spark)
    jvm = spark._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        if base.split("://")[-1].lstrip("/") in folder:
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrowed(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(doc_id, text) under fixed names; other columns and clashing names are left behind."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; when a task ends, Arrow gives back what it keeps of freed memory.  Else
    workers hold it while they wait, also through stages that run no Python."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return released


def words_in(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` (null: 0), by splitting once."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int")
            - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def running_sums(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, sums: dict[str, str]) -> DataFrame:
    """Sums of the rows before each row of its key (exclusive), whole keys never in one task.

    `bucket` must be a whole number, monotone in `order`.  Rows are summed by (key, bucket); the
    bucket sums are accumulated in two levels, runs of `BUCKETS_PER_RUN` buckets and then the
    buckets of a run; and only the rows of one bucket are sorted together.
    `sums` maps new column -> summed column."""
    b, c, key = fresh(df, "bucket_"), fresh(df, "coarse_"), fresh(df, "run_")
    df = df.withColumn(b, bucket)
    names = {f"{n}_base_": n for n in sums}

    def before(parts: DataFrame, within: list[str], order: str) -> list[Column]:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(f"{n}_b_").over(w), F.lit(0)).alias(base) for base, n in names.items()]

    def same(left: list[str], right: str) -> Column:
        cond = F.lit(True)
        for k in left:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{right}.{k}"))
        return cond

    per = df.groupBy(*keys, b).agg(*[F.sum(col).alias(f"{n}_b_") for n, col in sums.items()]).withColumn(c, F.floor(F.col(b) / BUCKETS_PER_RUN))
    runs = per.groupBy(*keys, c).agg(*[F.sum(f"{n}_b_").alias(f"{n}_b_") for n in sums])
    runs = runs.select(F.struct(*keys, c, *before(runs, keys, c)).alias("of"))
    per = per.select(*keys, b, c, *before(per, [*keys, c], b)).join(runs, same([*keys, c], "of"))
    per = per.select(F.struct(*keys, b, *[(F.col(base) + F.col(f"of.{base}")).alias(base) for base in names]).alias(key))
    w2 = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(per, same([*keys, b], key), "left").select(
        *[c for c in df.columns if c != b],
        *[(F.col(f"{key}.{base}") + F.coalesce(F.sum(sums[n]).over(w2), F.lit(0))).alias(n) for base, n in names.items()],
    )
