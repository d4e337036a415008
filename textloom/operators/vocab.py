"""Vocabulary operators: token frequencies (A08), min-frequency filter (F02),
frequency-ordered ids (W06), top-k (L04), token <-> id lookups (J01, J02).

All are DataFrame -> DataFrame.  Frequencies use a partial + final hash
aggregate, so a very frequent token is combined map-side before the shuffle.
Id assignment uses the bucketed exact rank (no single-task global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.dictionary import elements, lookup
from textloom.operators.rank import exact_rank

# ---------------------------------------------------------------------------
# Specials of the word vocabulary, in id order.
WORD_SPECIALS = ("<unk>", "<pad>", "<cls>", "<eos>")
# Specials of the sub-word vocabulary, in id order.
PIECE_SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
# ---------------------------------------------------------------------------


def token_frequencies(df: DataFrame, tokens: str | Column = "tokens") -> DataFrame:
    """`(token, freq)` over an ARRAY<STRING> column."""
    return elements(df, tokens, "token").groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def specials_frame(spark, specials: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id long").withColumn(
        "freq", F.lit(0).cast("long")
    )


def build_vocab(
    freqs: DataFrame,
    min_freq: int = 1,
    specials: Sequence[str] = WORD_SPECIALS,
    max_size: int | None = None,
) -> DataFrame:
    """F02 + W06: `(token, id, freq)`; specials first, then freq desc, token asc.

    Bucket for the exact rank: (frequency descending, first two characters of
    the token) -- a monotone coarsening of the order, so even one very common
    frequency value is spread over many buckets.
    """
    spark = freqs.sparkSession
    words = freqs.where(F.col("freq") >= min_freq)
    if specials:
        words = words.where(~F.col("token").isin(*specials))
    bucket = F.struct((-F.col("freq")).alias("nf"), F.substring("token", 1, 2).alias("p"))
    # at most 64 parts: the bucket table has a row for every frequency and token beginning
    coarse = -F.floor(F.log2(-F.col("__bk.nf")))
    ranked = exact_rank(words, bucket, [F.col("freq").desc(), F.col("token")], out="rank", coarse=coarse)
    if max_size is not None:
        ranked = ranked.where(F.col("rank") <= max_size)
    out = ranked.select("token", (F.col("rank") - 1 + len(specials)).alias("id"), "freq")
    if specials:
        out = specials_frame(spark, specials).unionByName(out)
    return out


def top_tokens(freqs: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens (freq desc, token asc) -- a top-k, no full sort."""
    return freqs.orderBy(F.col("freq").desc(), F.col("token")).limit(k)


def lookup_ids(
    tokens_df: DataFrame,
    vocab: DataFrame,
    key: str,
    tokens: str = "tokens",
    unk_id: int = 0,
    out: str = "ids",
    carry: Sequence[str] = (),
) -> DataFrame:
    """ARRAY<STRING> -> ARRAY<LONG> by the vocabulary, as a dictionary in the tasks or
    through a join, whichever its measured size allows (`operators.dictionary`).

    Unknown tokens map to `unk_id`; a null or empty array gives an empty one.  Returns `key`, the
    `carry` columns and `out`.
    """
    return lookup(tokens_df, [key, *carry], tokens, vocab.select("token", F.col("id").cast("long").alias("id")), "token", "id", out, unk_id)


def unknown_tokens(tokens_df: DataFrame, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """J01, strict side: `(token, n)` of the tokens that the vocabulary lacks; empty if all are known."""
    seen = token_frequencies(tokens_df, tokens).withColumnRenamed("freq", "n")
    return seen.join(vocab.select("token"), "token", "left_anti")


def strict_ids(tokens_df: DataFrame, vocab: DataFrame, key: str, tokens: str = "tokens", out: str = "ids") -> DataFrame:
    """J01 with `strict`: as `lookup_ids`, but the query fails on a token that the vocabulary lacks."""
    ids = lookup_ids(tokens_df, vocab, key, tokens, -1, out)
    known = F.assert_true(~F.array_contains(out, -1), F.lit("a token is not in the vocabulary"))
    return ids.withColumn(out, F.when(known.isNull(), F.col(out)))


def lookup_tokens(ids_df: DataFrame, vocab: DataFrame, key: str, ids: str = "ids", out: str = "tokens",
                  carry: Sequence[str] = ()) -> DataFrame:
    """ARRAY<LONG> -> ARRAY<STRING> (inverse of `lookup_ids`; unknown ids -> null)."""
    return lookup(ids_df, [key, *carry], ids, vocab.select(F.col("id").cast("long").alias("id"), "token"), "id", "token", out)
