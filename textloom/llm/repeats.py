"""Removal of byte strings that occur elsewhere, by two-stage suffix sorting.

A byte goes if some string of `length` bytes over it also starts anywhere else.  The corpus is
too large for one suffix array, so equal strings are first brought together: every window of
`length` bytes chooses an anchor, the place of its least hashed `ANCHOR`-byte string (the leftmost
if tied).  Equal windows choose equal anchors at equal offsets.  Neighbouring windows with one
anchor form a segment; texts become narrow rows (anchor hash, segment hash).

Equal segments are counted, not compared: all their windows recur.  Only segments whose anchor
also has other segments are cut out, sent to their anchor's task and sorted there, one
block of many anchors at a time:  suffixes smaller than their successors are sorted directly,
the others are induced by scanning the buckets of first bytes in order, and a window
recurs if it shares `length` bytes with a neighbour.

An anchor with more than `KINDS` different segments is not sorted as it is: its segments
are cut by the offset of the anchor, and what all windows of a part have in common joins the
key, so that only parts that may hold equal windows stay together; parts of one window settle
what is still too large.  No text is compared with more than a bounded number of others.

Texts shuffle once, into a table that is bucketed by text hash, and are read from there;
equal texts are one row of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import drop_written, read_table, written
from textloom.llm.registry import register
from textloom.llm.texts import DistinctTexts, text_key

LENGTH = 400
ANCHOR = 128            # bytes of an anchor string, at most `LENGTH`
KINDS = 256             # different segments of one anchor that are sorted together
PART_OFFSETS = (32, 1)  # anchor offsets of a part, when there are more
CHUNK = 1 << 18         # windows of a text that are hashed together
BLOCK_WINDOWS = 150_000  # windows that are sorted together, and one anchor's more
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(0xFFFFFFFF00000000)


# ------------------------------------------------------------------ anchors

@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    one = np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate((one, np.full(n - 1, _BASE, np.uint64))))
    down = np.cumprod(np.concatenate((one, np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64))))
    return up, down


def anchor_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size`-byte string of `text`."""
    up, down = _powers(CHUNK + 4 * LENGTH if len(text) <= CHUNK + 4 * LENGTH else len(text))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)])))
    x = (sums[size:] - sums[:-size]) * down[: len(text) - size + 1]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(rows, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def segments(text: bytes, length: int, anchor: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, anchor place, anchor hash) of each segment of a text."""
    whole = np.frombuffer(text, np.uint8)
    for lo in range(0, len(text) - length + 1, CHUNK):
        part = whole[lo : lo + CHUNK + length - 1]
        h = anchor_hashes(part, anchor)
        least = sliding_minimum((h & _TOP) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
        at = (least & ~_TOP).astype(np.int64)
        cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
        first = cut[:-1]
        place = at[first]
        yield from zip((first + lo).tolist(), np.diff(cut).tolist(), (place + lo).tolist(), h[place].view(np.int64).tolist())


# ------------------------------------------------------------------ two-stage sorting

def _descending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is greater than its successor (the last one is: nothing follows)."""
    step = np.append(np.sign(text[1:].astype(np.int16) - text[:-1]), -1)
    at = np.where(step != 0, np.arange(len(text)), len(text))
    return step[np.minimum.accumulate(at[::-1])[::-1]] < 0


def two_stage_order(text: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places of `wanted` (a mask) by the suffix that starts there, compared for `depth` bytes at least.

    An induced suffix needs its successor's place, so a wanted one brings the suffixes after it
    along, up to the first that is sorted directly."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    down = _descending(t)
    upto = np.minimum.accumulate(np.where(~down, np.arange(n), n - 1)[::-1])[::-1]  # the first from here that is sorted directly
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    edge = np.bincount(ends + 1, minlength=n + 2) - np.bincount(upto[ends] + 1, minlength=n + 2)
    member = wanted | (np.cumsum(edge)[:n] > 0)

    direct = sorted(np.flatnonzero(member & ~down).tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    bounds = np.searchsorted(t[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def before(places: np.ndarray) -> np.ndarray:
        p = places[places > 0] - 1
        return p[member[p] & down[p]]

    if n and member[-1] and down[-1]:
        buckets[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int64)
        here = []
        while len(wave):  # what is induced into the bucket that is being scanned
            here.append(wave)
            wave = before(wave)
            wave = wave[t[wave] == c]
        here.append(direct[bounds[c] : bounds[c + 1]])
        scanned = np.concatenate(here)
        out.append(scanned)
        p = before(scanned)
        p = p[t[p] > c]
        if len(p):
            p = p[np.argsort(t[p], kind="stable")]
            for part in np.split(p, np.flatnonzero(t[p][1:] != t[p][:-1]) + 1):
                buckets[t[part[0]]].append(part)
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(text: bytes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at `a` and `b` share, pair by pair; `most` (a multiple of 8) or more count as `most`."""
    padded = np.frombuffer(text + bytes(most + 8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8")[:, 0]
    out = np.full(len(a), most, np.int64)
    live = np.arange(len(a))
    for at in range(0, most, 8):
        x = words[a[live] + at] ^ words[b[live] + at]
        off = np.flatnonzero(x)
        lowest = x[off] & (~x[off] + np.uint64(1))
        out[live[off]] = at + np.searchsorted(np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64), lowest, side="right") - 1
        live = live[x == 0]
    return np.minimum(out, len(text) - np.maximum(a, b))  # not into the padding


def repeated_windows(pieces: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its first `windows` strings of `length` bytes occur twice among all of them."""
    text = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + np.array(windows), -1)
    wanted = np.cumsum(edge)[:-1] > 0
    order = two_stage_order(text, wanted, length)
    step = -(-length // 8) * 8
    shared = common_prefixes(text, order[:-1], order[1:], step) >= length
    twice = np.zeros(len(text), bool)
    twice[order[:-1][shared]] = True
    twice[order[1:][shared]] = True
    return [twice[b : b + w] for b, w in zip(begins.tolist(), windows)]


def _ranges(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, length) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist())


# ------------------------------------------------------------------ the job

_SEGMENT = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int64()),
                      ("f", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])
_SEGMENT_DDL = "t1 long, t2 long, start long, windows int, anchor long, f long, c1 long, c2 long"
_MARK_DDL = "t1 long, t2 long, start long, windows int"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _segment_rows(t1: int, t2: int, text: bytes, found: Iterator[tuple[int, int, int, int]], length: int) -> Iterator[tuple]:
    import xxhash

    for start, n, anchor, f in found:
        c = xxhash.xxh3_128_intdigest(text[start : start + n + length - 1])
        yield t1, t2, start, n, anchor, f, _signed(c >> 64), _signed(c & (1 << 64) - 1)


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def parts(text: bytes, start: int, n: int, anchor: int, f: int, width: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """A segment's windows by the anchor's offset in them, `width` offsets a part; what all windows
    of a part share is in its key."""
    import xxhash

    for j in range((anchor - (start + n - 1)) // width, (anchor - start) // width + 1):
        lo, hi = max(start, anchor - (j + 1) * width + 1), min(start + n - 1, anchor - j * width)
        core = text[anchor - j * width : anchor - (j + 1) * width + 1 + length]
        yield lo, hi - lo + 1, anchor, _signed(xxhash.xxh3_64_intdigest(core, (f + j) & (1 << 64) - 1))


def _first_segments(texts: DistinctTexts, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text in zip(*[c.to_pylist() for c in batch.columns]):
                yield _emit(list(_segment_rows(t1, t2, text, segments(text, length, anchor), length)), _SEGMENT)

    return texts.all().select("t1", "t2", "text").mapInArrow(run, _SEGMENT_DDL)


def _narrower(texts: DistinctTexts, hot: DataFrame, width: int, length: int) -> DataFrame:
    """The segments of anchors with too many kinds, cut into parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text, asks in zip(*[c.to_pylist() for c in batch.columns]):
                found = (p for a in asks for p in parts(text, a["start"], a["windows"], a["anchor"], a["f"], width, length))
                yield _emit(list(_segment_rows(t1, t2, text, found, length)), _SEGMENT)

    asked = texts.asked(hot, ["start", "windows", "anchor", "f"])
    return asked.select("t1", "t2", "text", "asks").mapInArrow(run, _SEGMENT_DDL)


def _sorted_marks(texts: DistinctTexts, cold: DataFrame, length: int) -> DataFrame:
    """The recurring windows of segments that share their anchor with other segments."""
    piece = pa.schema([("f", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()),
                       ("again", pa.bool_()), ("body", pa.binary())])
    mark = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("windows", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text, asks in zip(*[c.to_pylist() for c in batch.columns]):
                yield _emit([(a["f"], t1, t2, a["start"], a["windows"], a["again"], text[a["start"] : a["start"] + a["windows"] + length - 1])
                             for a in asks], piece)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            out = []
            for row, twice in zip(held, repeated_windows([r[6] for r in held], [r[4] for r in held], length)):
                if not row[5]:  # all windows of a segment that occurs again are known to
                    out += [(row[1], row[2], row[3] + lo, size) for lo, size in _ranges(twice)]
            held.clear()
            return _emit(out, mark)

        last = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if n >= BLOCK_WINDOWS and row[0] != last:
                    yield flush()
                    n = 0
                held.append(row)
                last, n = row[0], n + row[4]
        if held:
            yield flush()

    asked = texts.asked(cold, ["f", "start", "windows", "again"])
    pieces = asked.select("t1", "t2", "text", "asks").mapInArrow(cut, "f long, t1 long, t2 long, start long, windows int, again boolean, body binary")
    return pieces.repartition("f").sortWithinPartitions("f").mapInArrow(sort, _MARK_DDL)


def repeated_windows_of(texts: DistinctTexts, length: int, anchor: int, temporary: list[DataFrame]) -> DataFrame:
    """(t1, t2, start, windows): ranges of window starts whose windows occur elsewhere too."""
    def keep(df: DataFrame, name: str) -> DataFrame:
        temporary.append(written(df, name))
        return temporary[-1]

    marks = None
    found = _first_segments(texts, length, anchor)
    for width in (*PART_OFFSETS, None):
        found = keep(found, "repeat-segments")
        rep = F.min(F.struct("t1", "t2", "start", "windows", "anchor")).alias("rep")
        kinds = keep(found.groupBy("f", "c1", "c2").agg(F.count("*").alias("times"), rep), "repeat-kinds")
        again = kinds.where("times > 1").select("f", "c1", "c2")
        new = found.join(again, ["f", "c1", "c2"]).select("t1", "t2", "start", "windows")
        several = kinds.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1")
        mixed = keep(kinds.join(several, "f").select("f", "kinds", (F.col("times") > 1).alias("again"), "rep.*"), "repeat-mixed")
        new = new.unionByName(_sorted_marks(texts, mixed.where(F.col("kinds") <= KINDS) if width else mixed, length))
        marks = keep(new if marks is None else marks.unionByName(new), "repeat-marks")
        hot = mixed.where(F.col("kinds") > KINDS)
        if width is None or hot.isEmpty():
            break
        found = _narrower(texts, hot, width, length)
    return marks


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   kept: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans array<struct<start, end>> (maximal removed
    runs of UTF-8 bytes, end exclusive), kept_sha256 and, if `kept`, kept (the remaining bytes).

    A byte goes if a string of `length` bytes over it also starts elsewhere in the table, be it in
    the same row; strings are judged on the texts as given.  A null text is empty; texts shorter than
    `length` lose nothing; rows with equal texts lose all of it if it is long enough; null and
    repeated ids are treated like any; an empty table gives no rows; other columns are ignored.
    Segments of equal 128-bit hash count as equal."""
    own = F.col(text_col)
    texts = DistinctTexts(docs, own.cast("binary"), F.octet_length("text") >= length)
    temporary: list[DataFrame] = []
    marks = repeated_windows_of(texts, length, anchor, temporary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, t2, text, copies, asks in zip(*[c.to_pylist() for c in batch.columns]):
                edge = np.zeros(len(text) + 1, np.int64)
                ranges = [(0, len(text))] if copies > 1 else [(a["start"], a["start"] + a["windows"] + length - 1) for a in asks]
                np.add.at(edge, [r[0] for r in ranges], 1)
                np.add.at(edge, [r[1] for r in ranges], -1)
                spans = [{"start": s, "end": s + n} for s, n in _ranges(np.cumsum(edge)[:-1] > 0)]
                inner = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
                left = b"".join(text[a:b] for a, b in zip(inner[::2], inner[1::2]))
                rows.append((t1, t2, spans, hashlib.sha256(left).hexdigest(), *[left] * kept))
            yield _emit(rows, schema)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("spans", span), ("sha", pa.string()), *[("left_over", pa.binary())] * kept])
    asked = texts.asked(marks, ["start", "windows"], "left").where("copies > 1 or asks is not null")
    changed = written(asked.select("t1", "t2", "text", "copies", "asks").mapInArrow(
        cut, "t1 long, t2 long, spans array<struct<start:long,end:long>>, sha string" + ", left_over binary" * kept), "repeat-results")
    for df in temporary:
        drop_written(df)
    texts.drop()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own_sha"),
                       *[text.cast("binary").alias("own")] * kept, *text_key(own.cast("binary")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return rows.join(changed, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("sha", "own_sha").alias("kept_sha256"),
        *[F.coalesce("left_over", "own").alias("kept")] * kept)


@register("op13_suffix_repeats")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
