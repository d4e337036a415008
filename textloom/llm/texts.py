"""The distinct texts of a table, shuffled once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop_written, partitions, scratch


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes, t1 and t2, that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


class DistinctTexts:
    """A table (t1, t2, text, copies) of the distinct texts, bucketed by their hash in the shared
    folder: joins on the hash read it where it lies, so texts shuffle this one time."""

    def __init__(self, docs: DataFrame, text: Column, where: Column):
        self.spark = docs.sparkSession
        self.name = f"textloom_texts_{uuid.uuid4().hex[:12]}"
        rows = docs.select(*text_key(text), text.alias("text")).where(where)
        texts = rows.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        (texts.write.bucketBy(partitions(self.spark), "t1", "t2").option("compression", "zstd")
         .option("path", scratch(self.spark, "texts")).saveAsTable(self.name))

    def all(self) -> DataFrame:
        return self.spark.table(self.name)

    def asked(self, rows: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
        """Each text that `rows` (t1, t2, `columns`) ask about, with a list `asks` of what they ask."""
        per = rows.groupBy("t1", "t2").agg(F.collect_list(F.struct(*columns)).alias("asks"))
        return self.all().join(per, ["t1", "t2"], how)

    def forget(self) -> None:
        """Take the name out of the catalog; the files stay, for tables already made from them."""
        self.spark.sql(f"DROP TABLE {self.name}")

    def drop(self) -> None:
        drop_written(self.all())
        self.forget()
