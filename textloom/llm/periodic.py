"""Periodic runs of words, found with multi-scale minimizers.

A run is a maximal stretch of words that repeats with some smallest period, at least four
times.  Periods up to `SHORT` are scanned directly: words are compared with those `lag`
further on.  Longer ones go by scales.  At scale K (a power of two) every sequence of K words
has an exact name, made of the names of its halves, and in every window of K/2 places the
least name (in a mixed order, the leftmost if tied) is selected.  Inside a run with a period q
of K/2 < q <= K two windows q apart hold the same names, so they select places q apart, and
no sequence of K >= q words recurs sooner; so some two neighbours among the selected places
of one name are exactly q apart.  Every such pair seeds an extension to both sides, word by
word, which gives the run and is exact.

Only sequences that recur keep a name, and a sequence recurs only if its halves do, so scales
shrink fast on prose.  All texts of a batch are searched at once: words get numbers that no
other text has.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import narrowed, read_table
from textloom.llm.registry import register

SHORT = 8             # longest period that is scanned directly
MIN_TIMES = 4         # periods that a run needs at least
MIN_WORDS = 6         # and words
BATCH_WORDS = 400_000  # words searched together; a longer text is searched alone

Rewrite = Callable[[object, int], "np.ndarray | None"]


def _mixed(names: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of names, so that minima fall evenly."""
    x = names.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _recurring(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key occurs again, its number)."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[number] > 1, number


def _selected(pos: np.ndarray, name: np.ndarray, width: int) -> np.ndarray:
    """Indices of the minimizers of all windows of `width` (a power of two) neighbouring places."""
    n = len(pos)
    if n < width:
        return np.zeros(0, np.int64)
    order = _mixed(name)
    best, step = np.arange(n), 1
    while step < width:
        a, b = best[:-step], best[step:]
        best = np.where(order[a] <= order[b], a, b)
        step *= 2
    whole = pos[width - 1 :] - pos[: n - width + 1] == width - 1
    return np.unique(best[whole])


def _seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lags) per scale: pairs of neighbouring equal minimizers at a lag of the scale."""
    again, name = _recurring(words)
    pos = np.flatnonzero(again)
    name = name[pos]
    k = 1
    while len(pos):
        if k > SHORT:
            at = _selected(pos, name, k // 2)
            at = at[np.lexsort((pos[at], name[at]))]
            p, q = pos[at[:-1]], pos[at[1:]]
            ok = (name[at[:-1]] == name[at[1:]]) & (q - p > k // 2) & (q - p <= k)
            yield p[ok], (q - p)[ok]
        dense = np.full(len(words) + k, -1, np.int64)
        dense[pos] = name
        then = dense[pos + k]
        some = then >= 0
        pos, name, then = pos[some], name[some], then[some]
        again, name = _recurring(name * (len(words) + 1) + then)
        pos, name = pos[again], name[again]
        k *= 2


def _equal_for(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from `at` on, in direction `step`, have the same word `lag` further."""
    n, chunk = 0, 64
    while True:
        lo, hi = (at + n, min(at + n + chunk, len(words) - lag)) if step > 0 else (max(at - n - chunk + 1, 0), at - n + 1)
        if lo >= hi:
            return n
        same = words[lo:hi] == words[lo + lag : hi + lag]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return n + int(same.argmin())
        n += hi - lo
        chunk *= 2


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


def runs_of(words: np.ndarray, min_times: int = MIN_TIMES, min_words: int = MIN_WORDS) -> np.ndarray:
    """(start, length, period) rows of every run, by start, then period.  `min_times` is 4 or more:
    the windows of a scale need so much room."""
    if min_times < 4:
        raise ValueError("runs of fewer than 4 periods are not all found")
    found: list[np.ndarray] = []

    def keep(start: np.ndarray, length: np.ndarray, period: int) -> None:
        ok = length >= max(min_words, min_times * period)
        found.append(np.stack([start[ok], length[ok], np.full(int(ok.sum()), period)], axis=1))

    for lag in range(1, min(SHORT, len(words) - 1) + 1):
        start, same = _stretches(words[:-lag] == words[lag:])
        keep(start, same + lag, lag)
    for places, lags in _seeds(words):
        done_lag = done_upto = -1
        order = np.lexsort((places, lags))
        for p, lag in zip(places[order].tolist(), lags[order].tolist()):
            if lag == done_lag and p < done_upto:
                continue  # inside the stretch just extended
            ahead, back = _equal_for(words, p, lag, 1), _equal_for(words, p - 1, lag, -1)
            done_lag, done_upto = lag, p + ahead
            keep(np.array([p - back]), np.array([ahead + back + lag]), lag)
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a stretch with several periods has the smallest as its own; the others are its multiples
    first = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.zeros(0, bool)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _batch(ids: list, texts: list[str | None], rewrite: Rewrite | None, batch_words: int) -> Iterator[tuple[int, list, str]]:
    """(words, runs, collapsed text) of each text, in order."""
    pending: list[tuple[list[bytes], np.ndarray | None]] = []
    numbers: list[np.ndarray] = []
    held = top = 0

    def flush() -> Iterator[tuple[int, list, str]]:
        sizes = np.array([len(x) for x in numbers])
        ends = np.cumsum(sizes)
        runs = runs_of(np.concatenate(numbers))
        upto = np.searchsorted(runs[:, 0], ends)
        lo = 0
        for (words, order), begin, end, hi in zip(pending, (ends - sizes).tolist(), ends.tolist(), upto.tolist()):
            mine = runs[lo:hi] - np.array([begin, 0, 0])
            lo = hi
            if order is not None:
                words = [words[i] for i in order.tolist()]
            if len(mine):
                gone = np.zeros(end - begin, bool)
                for start, length, period in mine.tolist():
                    gone[start + period : start + length] = True
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            yield end - begin, mine.tolist(), b" ".join(words).decode("utf-8", "surrogatepass")

    for doc_id, text in zip(ids, texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split: \x20 \x09-\x0D
        if pending and held + len(words) > batch_words:
            yield from flush()
            pending.clear(), numbers.clear()
            held = top = 0
        order = rewrite(doc_id, len(words)) if rewrite else None
        seen: dict[bytes, int] = {}
        number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + top
        numbers.append(number if order is None else number[order])
        pending.append((words, order))
        top, held = top + len(seen), held + len(words)
    if pending:
        yield from flush()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs array<struct<start, period, length>> (longs, by
    start, then period) and collapsed (the words that no run repeats, joined by one space).

    Words are numbered from 0.  `rewrite(id, n)` may give, for a text of n words, the word numbers that
    are searched in their place (or None).  A null or wordless text has no words and no runs; null
    and repeated ids are treated like any; an empty table gives no rows; other columns are ignored.
    Texts are read whole; a text longer than a batch is searched alone."""
    kept = narrowed(docs, id_col, text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, texts = [], [], []
            for size, found, text in _batch(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rewrite, BATCH_WORDS):
                n.append(size)
                runs.append([{"start": s, "period": p, "length": length} for s, length, p in found])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(texts, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    return kept.mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start:long,period:long,length:long>>, collapsed string")


def planted_order(doc_id, n: int) -> np.ndarray | None:
    """The query's rewriting of a tenth of the documents: from some word on, a stretch of words repeats."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def run_digests(rows: DataFrame) -> DataFrame:
    """Rows of `periodic_runs` as counts, the longest run (ties: smallest start, then period) and hashes."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))

    one = rows.withColumn("best", F.when(F.size("runs") > 0, longest))
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=planted_order))
