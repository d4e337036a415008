"""File sources and sinks.

CSV is read with an explicit schema (no inference pass), `multiLine` so quoted
newlines survive, and `escape='"'` so doubled quotes round-trip; the default
backslash escape corrupts `""` inside fields.  Writers keep leading/trailing
spaces (Spark trims them by default when writing CSV).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

CSV_OPTIONS = {
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}
# an empty string is written as "" and an absent value as nothing; a null mark that no field
# can hold keeps the reader from taking the first for the second
READ_OPTIONS = CSV_OPTIONS | {"mode": "FAILFAST", "enforceSchema": "false", "emptyValue": "", "nullValue": "\u0000"}


def comments_schema(labels, id_col: str = "id", text_col: str = "comment_text", with_id: bool = True) -> Ty.StructType:
    fields = [Ty.StructField(id_col, Ty.StringType())] if with_id else []
    fields.append(Ty.StructField(text_col, Ty.StringType()))
    fields += [Ty.StructField(l, Ty.IntegerType()) for l in labels]
    return Ty.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: Ty.StructType, header: bool = True) -> DataFrame:
    """Quoted CSV with an explicit (positional when header-less) schema."""
    # a header must name the schema's columns in order, and a malformed row is an error, never a null
    return spark.read.schema(schema).options(**READ_OPTIONS).option("header", str(header).lower()).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """CSV with or without a header row; every field quoted only when needed."""
    df.write.mode(mode).options(**CSV_OPTIONS).option("header", str(header).lower()).csv(path)


def write_lines(df: DataFrame, col: str, order: str, path: str, single: bool = False) -> None:
    """One value per line, in `order`: range-sorted part files, or one file for an export that asks for it."""
    lines = df.orderBy(order).select(F.col(col).cast("string"))
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, m): the lines of text files, in any number of tasks.  (file, block) is the
    split that a line begins in, and m rises by 1 from line to line of a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("m"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of the files under `path`, in the order of their names, numbered from 0.

    Each split counts its lines; the sums of the counts before a split, a small table, are its offset."""
    lines = split_lines(spark, path)
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    before = Window.orderBy(F.length("file"), "file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(splits, ["file", "block"]).select("value", (F.col("m") + F.col("shift")).alias("line"))


def read_vocab_file(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary file or folder of part files, id = 0-based line number over all of them, each line stripped."""
    return numbered_lines(spark, path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("token"), F.col("line").alias("id"))


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """One class name per line, in file order."""
    return read_vocab_file(spark, path).select(F.col("token").alias("label"), F.col("id").alias("label_idx"))


def write_vectors(vectors: DataFrame, path: str, word: str = "token", vec: str = "vec") -> None:
    """Word-vector text file `word f1 ... fd` plus a `count dim` header line."""
    body = vectors.select(F.concat_ws(" ", F.col(word), F.array_join(F.transform(vec, lambda x: x.cast("string")), " ")).alias("value"))
    head = vectors.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size(vec)).cast("string")).alias("value"))
    head.unionByName(body).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """`word f1 ... fd` lines -> `(token, vec ARRAY<FLOAT>)`; the 2-field header is dropped."""
    line = F.regexp_replace("value", r"\s+$", "")
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(line, " ").alias("p"), line.alias("line"))
    header = (F.size("p") == 2) & F.col("line").rlike(r"^[0-9]+ " + str(dim) + "$")
    body = parts.where(~header).select(F.when(F.size("p") == dim + 1, F.col("p")).otherwise(
        F.raise_error(F.concat(F.lit(f"a word-vector line has no {dim} numbers: "), F.substring("line", 1, 80)))).alias("p"))
    return body.select(
        F.get(F.col("p"), 0).alias("token"),
        F.transform(F.slice("p", 2, dim), lambda x: x.cast("float")).alias("vec"),
    )
