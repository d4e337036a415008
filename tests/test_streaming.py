"""The stateless text functions on a streaming source give the batch result."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from textloom.functions import text as T
from textloom.streaming import token_counts_stream, write_available_now


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "docs"
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").write.parquet(str(src))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    q = write_available_now(token_counts_stream(spark, str(src), schema), str(tmp_path / "out"))
    q.awaitTermination(300)
    got = {r["doc_id"]: r["n_tokens"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = {r["doc_id"]: r["n"] for r in docs.select("doc_id", F.size(T.word_tokens("text")).alias("n")).collect()}
    assert got == want
