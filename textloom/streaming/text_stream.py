"""Word tokenisation of a streaming table of documents (stateless, append mode)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as T
from textloom.session import scratch_path


def token_counts_stream(spark: SparkSession, path: str, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Streaming `(key, n_tokens, n_chars)` for every arriving document."""
    src = spark.readStream.schema(schema).parquet(path)
    toks = T.word_tokens(text)
    return src.select(key, F.size(toks).cast("long").alias("n_tokens"), F.char_length(text).cast("long").alias("n_chars"))


def write_available_now(df: DataFrame, out_path: str) -> StreamingQuery:
    """Process everything available, append parquet to `out_path`; the checkpoint goes to a
    fresh sub-folder of the shared checkpoint folder."""
    ckpt = scratch_path(df.sparkSession, "stream-ckpt")
    return (
        df.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out_path)
        .outputMode("append").trigger(availableNow=True).start()
    )
