"""Texts to model features with any tokenizer (T22, X01), and processors by task name.

A tokenizer takes `(df, key, text)` and returns `(key, tokens)`: an array of strings for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import encode as E
from textloom.operators import subword as SW

Tokenizer = Callable[[DataFrame, str, str], DataFrame]


def word_tokenizer(df: DataFrame, key: str, text: str) -> DataFrame:
    """T04."""
    return df.select(key, T.word_tokens(text).alias("tokens"))


def wordpiece_tokenizer(vocab: DataFrame, clean: bool = False, do_lower_case: bool = True) -> Tokenizer:
    """T10 and T12 over `vocab`; with `clean`, the HTML cleaner (T02) runs first."""

    def run(df: DataFrame, key: str, text: str) -> DataFrame:
        source = T.clean_text_html(text) if clean else F.col(text)
        basic = SW.basic_tokenize(df.select(key, source.alias("__text")), "__text", "tokens", do_lower_case)
        return SW.wordpiece_tokenize(basic.select(key, "tokens"), key, "tokens", vocab, "tokens")

    return run


def single_features(df: DataFrame, key: str, text: str, tokenizer: Tokenizer, vocab: DataFrame, max_len: int,
                    prefix: Sequence[int], suffix: Sequence[int], pad_id: int = 0, unk_id: int = 1) -> DataFrame:
    """Key, n_tokens, length, input_ids, input_mask and segment_ids (all 0) of one text a row."""
    enc = E.encode_single(tokenizer(df, key, text), key, "tokens", vocab, max_len, prefix, suffix, pad_id, unk_id)
    return enc.withColumn("segment_ids", F.array_repeat(F.lit(0), max_len))


def pair_features(df: DataFrame, key: Sequence[str], text_a: str, text_b: str, tokenizer: Tokenizer, vocab: DataFrame,
                  max_len: int, cls_id: int, sep_id: int, pad_id: int = 0, unk_id: int = 1) -> DataFrame:
    """Features of two texts a row (a null second text: of the first alone); both go through the tokenizer together."""
    k = F.struct(*key)
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col(text_a).alias("text")), F.struct(F.lit("b").alias("side"), F.col(text_b).alias("text")))
    long = df.select(k.alias("__k"), F.explode(sides).alias("__s")).where("__s.side = 'a' OR __s.text IS NOT NULL")
    toks = tokenizer(long.select(F.struct("__k", "__s.side").alias("__ks"), F.col("__s.text").alias("text")), "__ks", "text")
    wide = toks.groupBy("__ks.__k").agg(
        F.max(F.when(F.col("__ks.side") == "a", F.col("tokens"))).alias("ta"),
        F.max(F.when(F.col("__ks.side") == "b", F.col("tokens"))).alias("tb"))
    return E.encode_pair(wide.select("__k.*", "ta", "tb"), key, "ta", "tb", vocab, max_len, cls_id, sep_id, pad_id, unk_id)


@dataclass(frozen=True)
class Processor:
    """A task's inputs: its labels, and `(guid, text_a, text_b, labels)` examples of each part."""

    labels: tuple[str, ...]
    parts: dict[str, Callable[[SparkSession, str], DataFrame]]


PROCESSORS: dict[str, Processor] = {}


def add_processor(task: str, processor: Processor) -> None:
    PROCESSORS[task.lower()] = processor


def processor(task: str) -> Processor:
    """The processor of a task, whatever the case of its name; an unknown name is an error."""
    found = PROCESSORS.get(task.lower())
    if found is None:
        raise ValueError(f"no processor for task {task!r}; known: {', '.join(sorted(PROCESSORS)) or 'none'}")
    return found
