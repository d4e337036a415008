"""Basic tokenizer (T05-T11) and greedy WordPiece.

The basic tokenizer is JVM expressions (an Arrow UDF sees only texts that aren't ASCII).
WordPiece splits *distinct* words: in the tasks by a vocabulary that fits there, else by joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textloom.functions import text as T
from textloom.functions.accents import strip_accents
from textloom.operators.dictionary import elements, lookup, map_arrays, small_table
from textloom.operators.vocab import PIECE_SPECIALS
from textloom.session import materialize

# Fixed values of the WordPiece rule.
UNK_TOKEN = "[UNK]"
MAX_INPUT_CHARS_PER_WORD = 100
CONTINUATION = "##"

KNOWN_WORDS = 200_000  # distinct words that a worker remembers


def basic_tokenize(df: DataFrame, text: str, out: str, do_lower_case: bool = True) -> DataFrame:
    """Clean -> CJK spacing -> split -> (lower, strip accents) -> punctuation split,
    all on the whole string (specials protected), then one split."""
    whole = "__protected"
    df = df.withColumn(whole, F.lower(T.basic_protect(text)) if do_lower_case else T.basic_protect(text))
    return df.withColumn(out, T.basic_finish(strip_accents(whole) if do_lower_case else F.col(whole))).drop(whole)


class Pieces:
    """Greedy longest-match pieces of words, by a vocabulary that is held in memory."""

    def __init__(self, tokens: Sequence[str]):
        self.names = [*tokens, UNK_TOKEN]
        self.tokens = {t: i for i, t in enumerate(tokens)}
        self.first = sorted({len(t) for t in self.tokens}, reverse=True)  # lengths that occur, longest first
        self.later = sorted({len(t) - len(CONTINUATION) for t in self.tokens if t.startswith(CONTINUATION) and len(t) > len(CONTINUATION)}, reverse=True)
        self.known: dict[str, bytes] = {}

    def of(self, word: str) -> list[str]:
        return [self.names[i] for i in np.frombuffer(self.numbers(word), np.int32)]

    def numbers(self, word: str) -> bytes:
        """The places of the word's pieces in `names`, as int32: a remembered word costs few bytes."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = np.array(self._split(word), np.int32).tobytes()
        return found

    def _split(self, word: str) -> list[int]:
        unknown = [len(self.names) - 1]
        n, at, out = len(word), 0, []
        if n > MAX_INPUT_CHARS_PER_WORD:
            return unknown
        while at < n:
            for size in self.later if at else self.first:
                piece = CONTINUATION + word[at : at + size] if at else word[:size]
                if at + size <= n and piece in self.tokens:
                    break
            else:
                return unknown
            out.append(self.tokens[piece])
            at += size
        return out


def wordpiece_table(words: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """`(word, pieces)` for a table of distinct words.

    For vocabularies that are too large for a task's memory.  Every stretch of a word that has the
    length of some vocabulary entry is a candidate and equi-joined with the vocabulary; the longest hit of each start is kept, and a
    word's hits are chained from its first character.  A word above the length limit, or
    whose chain breaks, is one unknown piece.
    """
    lengths = sorted(r[0] for r in vocab.select(F.char_length("token").alias("n")).where(
        F.col("n").between(1, MAX_INPUT_CHARS_PER_WORD + len(CONTINUATION))).distinct().collect())  # at most 102 numbers
    sizes = F.array(*[F.lit(x) for x in sorted({y for x in lengths for y in (x, x - len(CONTINUATION)) if y > 0})]).cast("array<int>")
    w, n = F.col(word), F.char_length(word)
    short = words.select(word).where(n.between(1, MAX_INPUT_CHARS_PER_WORD))
    spans = short.select(word, F.explode(F.sequence(F.lit(1), n)).alias("start"))
    spans = spans.withColumn("len", F.explode(F.filter(sizes, lambda x: x <= n - F.col("start") + 1)))
    part = F.substring(w, F.col("start"), F.col("len"))
    hits = spans.withColumn("token", F.when(F.col("start") == 1, part).otherwise(F.concat(F.lit(CONTINUATION), part))).join(
        vocab.select("token").distinct(), "token")
    longest = hits.groupBy(word, "start").agg(F.max(F.struct("len", "token")).alias("hit"))
    by_word = longest.groupBy(word).agg(F.map_from_entries(F.collect_list(F.struct("start", "hit"))).alias("__hits"))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def follow(state, i):
        hit = F.element_at("__hits", i)
        take = (state["at"] == i) & hit.isNotNull()
        return F.when(take, F.struct((state["at"] + hit["len"]).alias("at"), F.concat(state["pieces"], F.array(hit["token"])).alias("pieces"))).otherwise(state)

    chain = F.aggregate(F.sequence(F.lit(1), n), begin, follow)
    split = by_word.withColumn("__c", chain).select(
        word, F.when(F.col("__c.at") == n + 1, F.col("__c.pieces")).alias("__pieces"))
    unknown = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(UNK_TOKEN)))
    return words.select(word).join(split, word, "left").select(word, F.coalesce("__pieces", unknown).alias("pieces"))


def wordpiece_tokenize(df: DataFrame, key: str, tokens: str, vocab: DataFrame, out: str, most_rows: int | None = None) -> DataFrame:
    """ARRAY<STRING> of basic tokens -> ARRAY<STRING> of word pieces, per `key`.

    A vocabulary of a size that tasks can hold goes to them, and each distinct word of a worker is
    split once there: nothing is shuffled.  With a larger one the distinct words are split by joins,
    and documents look them up by their distinct words.  Returns `key` and `out`.
    """
    vocab, rows = small_table(vocab.select("token"), most_rows)
    if rows is None:
        words = elements(df, tokens, "word").where(F.col("word").isNotNull()).distinct()
        table = wordpiece_table(words, vocab)
        return lookup(df, [key], tokens, table, "word", "pieces", "__p", most_rows=most_rows).select(key, F.flatten("__p").alias(out))
    held = df.sparkSession.sparkContext.broadcast(rows["token"].to_pylist())
    made: list[tuple[Pieces, pa.Array]] = []

    def split(values: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        if not made:
            table = Pieces(held.value)
            made.append((table, pa.array(table.names, pa.string())))
        table, names = made[0]
        coded = values.dictionary_encode()
        pieces = [table.numbers(w) for w in coded.dictionary.to_pylist()]
        begins = np.concatenate(([0], np.cumsum([len(p) // 4 for p in pieces]))).astype(np.int64)
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.diff(begins)[ids]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[:-1][ids] - (ends - n), n)
        text = names.take(pa.array(np.frombuffer(b"".join(pieces), np.int32)[place]))
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        return text, np.diff(upto)

    return map_arrays(df, [key], tokens, out, Ty.StringType(), split)


def piece_vocab(basic_tokens: DataFrame, tokens: str = "tokens", n_words: int = 2000) -> DataFrame:
    """The sub-word vocabulary fixture `(token, id)` built from basic tokens.

    Order: specials; every distinct character c and `##c`, sorted; the n_words
    most frequent words (freq desc, word asc); `##` + last three characters of
    those words, distinct, sorted.  Duplicates keep their first place.  The
    result is bounded by 2 x distinct characters + 2 x n_words + 5 rows, so the
    final id window runs over a bounded table.
    """
    spark = basic_tokens.sparkSession
    words = elements(basic_tokens, tokens, "word")
    freq = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")))  # read four times below
    chars = (
        freq.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)(.)"), 1)).alias("c"))
        .distinct()
        .select(F.explode(F.array(F.col("c"), F.concat(F.lit(CONTINUATION), "c"))).alias("token"))
        .distinct()
    )
    top = freq.orderBy(F.col("freq").desc(), "word").limit(n_words)
    top_ranked = top.select(
        F.col("word").alias("token"),
        F.lit(2).alias("part"),
        F.row_number().over(Window.orderBy(F.col("freq").desc(), "word")).alias("r"),
    )
    suffixes = top.select(F.concat(F.lit(CONTINUATION), F.substring("word", -3, 3)).alias("token")).distinct()
    specials = spark.createDataFrame([(t, 0, i) for i, t in enumerate(PIECE_SPECIALS)], "token string, part int, r int")
    parts = (
        specials.unionByName(chars.select("token", F.lit(1).alias("part"), F.lit(0).alias("r")))
        .unionByName(top_ranked)
        .unionByName(suffixes.select("token", F.lit(3).alias("part"), F.lit(0).alias("r")))
    )
    first = parts.groupBy("token").agg(F.min(F.struct("part", "r")).alias("k"))
    w = Window.orderBy(F.col("k.part"), F.col("k.r"), F.col("token"))
    return first.select("token", (F.row_number().over(w) - 1).cast("long").alias("id"))
