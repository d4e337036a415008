"""Quality rules with suffix-array repetition.

Each batch of texts becomes one array of word numbers in which every text has
numbers and a separator of its own, so that one vectorised prefix doubling sorts the
suffixes of all texts at once and no repeat crosses a text.  Common prefixes of
neighbouring suffixes come from the ranks that the doubling leaves behind.  A text
fails if the union of the spans of its maximal repeated word sequences covers too much
of it or the longest one is too long.

The common-prefix intervals are nested, and each suffix adds the span of the deepest one
it lies in, whose length is the greater of its two neighbouring common prefixes.  That
gives the union over all maximal repeats of m words or more: an occurrence of a maximal
repeat is a prefix of a suffix in that repeat's interval, so the suffix's deepest interval
is no shorter; and the words of a suffix's deepest interval, lengthened to the left while
all their occurrences follow the same word, are a maximal repeat that covers them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe import text_runs
from textloom.llm.common import narrowed, read_table, releasing
from textloom.llm.registry import register

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50  # of words in 3-word windows that occur twice
MIN_REPEAT = 8           # words that a repeat needs to count for cover
MAX_COVERED = 0.5        # of a text's words
MAX_LONGEST = 0.25       # of a text's words
LONGEST_FROM = 50        # words; shorter repeats never fail a text by their length alone
BATCH_WORDS = 100_000    # words sorted together; a longer text is sorted alone

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def _levels(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of `words` and the ranks by the first 1, 2, 4, ... of them."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    ranks = [rank]
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if rank.max(initial=0) == n - 1:
            return order, ranks
        ranks.append(rank)
        step *= 2


def repeat_lengths(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lcp, longest): the suffix array; words that neighbours order[r-1], order[r] share;
    and for each position the most words from it on that occur from another position too."""
    n = len(words)
    order, ranks = _levels(words)
    lcp = np.zeros(n + 1, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        # a rank is of `step` words only if the suffix has so many; ends differ as separators do
        lcp[1:n][same] += step
        a[same] += step
        b[same] += step
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(lcp[:n], lcp[1:])
    return order, lcp, longest


def _word_stats(text: str, words: list[str]) -> tuple[int, int, int]:
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    return sum(map(len, words)), len(_SYMBOL.findall(text)), dup


def _repetition(groups: list[np.ndarray], min_repeat: int) -> list[tuple[int, int, int]]:
    """Per text: words in repeated 3-word windows, words covered by repeats of `min_repeat` or more, longest repeat."""
    top = max((int(g.max(initial=0)) for g in groups), default=0) + 1
    parts = []
    for i, g in enumerate(groups):  # a text's words and its separator get numbers that no other text has
        parts += [g + i * (top + 1), np.array([i * (top + 1) + top])]
    all_words = np.concatenate(parts)
    _, _, longest = repeat_lengths(all_words)
    sizes = np.array([len(g) + 1 for g in groups])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n = len(all_words)
    at = np.arange(n)

    def covered(reach: np.ndarray) -> np.ndarray:
        upto = np.maximum.accumulate(at + reach)
        return np.add.reduceat((upto > at).astype(np.int64), starts)

    # a text's spans end before its separator, so the running maximum never reaches the next text
    three = covered(np.where(longest >= 3, 3, 0))
    spans = covered(np.where(longest >= min_repeat, longest, 0))
    most = np.maximum.reduceat(longest, starts)
    return list(zip(three.tolist(), spans.tolist(), most.tolist()))


_OUT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
        "longest_repeat long, base_failed boolean, kept boolean")


def quality_rows(texts: list[str | None], min_repeat: int, max_covered: float, max_longest: float, batch_words: int) -> Iterator[tuple]:
    """The measures and verdict of each text, in order."""
    numbers: dict[str, int] = {}
    pending: list[tuple[int, int, int, int]] = []
    groups: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[tuple]:
        for (n, chars, symbols, dup), (three, cover, longest) in zip(pending, _repetition(groups, min_repeat)):
            failed = n < MIN_WORDS or 100 * three > MAX_REPEAT_PERCENT * n
            kept = not failed and cover <= max_covered * n and (longest <= LONGEST_FROM or longest <= max_longest * n)
            yield n, chars, symbols, dup, three, cover, longest, failed, kept

    for text in texts:
        text = text or ""
        words = _WORD.findall(text)
        if pending and held + len(words) > batch_words:
            yield from flush()
            pending.clear(), groups.clear(), numbers.clear()
            held = 0
        pending.append((len(words), *_word_stats(text, words)))
        groups.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)))
        held += len(words)
    if pending:
        yield from flush()


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT,
                  max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """One row per row of `docs`: doc_id, the measures and `kept`.

    A null text counts as empty (fails, as it has no words); repeated rows each get their row;
    an empty table gives no rows; extra columns are ignored.  Texts are read whole."""
    kept = narrowed(docs, id_col, text_col)
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {_OUT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        for batch in batches:
            for part in text_runs(batch, 1):
                cols = zip(*quality_rows(part.column(1).to_pylist(), min_repeat, max_covered, max_longest, BATCH_WORDS))
                arrays = [pa.array(c, pa.bool_() if i >= 7 else pa.int64()) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", *names])

    return kept.mapInArrow(releasing(run), schema)


def keep_by_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of `docs` (all columns) whose text passes the rules; nothing is shuffled."""
    text_at = docs.columns.index(text_col)
    args = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_longest": MAX_LONGEST} | limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch, text_at):
                rows = quality_rows(part.column(text_at).to_pylist(), batch_words=BATCH_WORDS, **args)
                yield part.filter(pa.array([r[-1] for r in rows], pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)


@register("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
