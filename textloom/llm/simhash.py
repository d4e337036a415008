"""SimHash near-duplicates, found by multi-index hashing.

Fingerprints are cut into segments.  If two of them differ in at most `max_bits`
bits, then some segment differs in few: with m segments, one of the first
`max_bits % m + 1` segments differs in at most `max_bits // m` bits, or one of the
others in at most one bit less.  Each distinct fingerprint is filed in one table
per segment; every member of the Hamming ball around its segment is looked up
there, and what is found is verified on all 64 bits.  No link is lost.

The number of segments follows from the number of distinct fingerprints: more
segments mean smaller balls but fuller buckets.  Every choice is exact.

Only distinct fingerprints are compared, and only if they are not yet known to
be in one component: a first round links each table bucket to its most frequent
fingerprint, which settles large groups of near copies with one link a member.
A bucket that is long all the same is cut into blocks, each with its own copy of
the bucket's lookups; a lookup whose component is the whole bucket's is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe import text_runs
from textloom.llm.common import fresh, narrowed, read_table, releasing, written
from textloom.llm.components import components
from textloom.llm.registry import register

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCK = 4_096  # fingerprints of a bucket that one task compares with the bucket's lookups
SEED = 42
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_TABLE = bytes.maketrans(_UPPER, _LOWER)


def text_fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: bit b is 1 if it is set in over half of the shingles' XXH64.  No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()  # bytes.split: \x20 \x09-\x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return digest(b" ".join(words), SEED)
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[words_per_shingle - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    begins = starts[: len(ends)].tolist()
    for at in range(0, len(ends), 65536):
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(begins[at : at + 65536], ends[at : at + 65536])), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, th long, fp long) for every row, `th` being xxhash64 of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch, 1):
                fps = np.fromiter((text_fingerprint(t, words_per_shingle) for t in part.column(1).to_pylist()), dtype=np.uint64, count=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    kept = narrowed(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    return kept.mapInArrow(releasing(run), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def segment_plan(max_bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, ball radius) of each segment that has to be searched."""
    base, extra = divmod(64, segments)
    out, at = [], 0
    for i in range(segments):
        width = base + (i < extra)
        radius = max_bits // segments - (i > max_bits % segments)
        if radius >= 0:
            out.append((at, width, radius))
        at += width
    return out


def choose_segments(n: int, max_bits: int) -> int:
    """The number of segments with the fewest lookups and candidates for a fingerprint among `n`
    evenly spread ones."""

    def cost(segments: int) -> float:
        balls = [(w, sum(comb(w, i) for i in range(r + 1))) for _, w, r in segment_plan(max_bits, segments)]
        return sum(ball * (1 + n / 2**w) for w, ball in balls)

    return min(range(1, max_bits + 2), key=cost)


def _segment(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _probes(fp: Column, segment: int, first: int, width: int, radius: int) -> Column:
    """The table keys within `radius` bits of a fingerprint's segment."""
    flips = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
    return F.transform(flips, lambda m: F.struct(F.lit(segment).alias("s"), _segment(fp, first, width).bitwiseXOR(m).alias("k")))


def links(distinct: DataFrame, max_bits: int, segments: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` with count `n`, enough to give the components."""
    plan = segment_plan(max_bits, segments)
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits
    filed = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _segment(F.col("fp"), at, w).alias("k")) for i, (at, w, _) in enumerate(plan)]))
    table = distinct.withColumn("e", filed).select("fp", "n", "e.s", "e.k")
    hub = table.groupBy("s", "k").agg(F.max_by("fp", F.struct("n", "fp")).alias("hub"))
    first = table.join(hub, ["s", "k"]).where((F.col("fp") != F.col("hub")) & near(F.col("fp"), F.col("hub")))
    stars = written(first.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), "simhash-stars")
    known = components(stars).select(F.col("node").alias("fp"), F.col("component").alias("c"))
    nodes = written(distinct.join(known, "fp", "left").select("fp", F.coalesce("c", "fp").alias("c")), "simhash-nodes")
    filed_nodes = nodes.withColumn("e", filed).select("fp", "c", "e.s", "e.k")
    # at most len(plan) / block of the fingerprints' number
    long = written(filed_nodes.groupBy("s", "k").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"))
                   .where(F.col("size") > block).withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "simhash-long")
    ball = F.explode(F.flatten(F.array(*[_probes(F.col("fp"), i, at, w, r) for i, (at, w, r) in enumerate(plan)])))
    asked = nodes.withColumn("e", ball).select(F.col("fp").alias("q"), F.col("c").alias("qc"), "e.s", "e.k")
    cut = F.coalesce("blocks", F.lit(1))
    t = filed_nodes.join(long, ["s", "k"], "left").withColumn("block", F.pmod(F.xxhash64("fp"), cut)).alias("t")
    settled = (F.col("lo") == F.col("qc")) & (F.col("hi") == F.col("qc"))
    q = asked.join(long, ["s", "k"], "left").where(~F.coalesce(settled, F.lit(False))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), cut.cast("long") - 1))).alias("q")
    found = t.join(q, (F.col("t.s") == F.col("q.s")) & (F.col("t.k") == F.col("q.k")) & (F.col("t.block") == F.col("q.block"))
                   & (F.col("t.c") != F.col("q.qc")) & near(F.col("t.fp"), F.col("q.q")))
    return found.select(F.col("t.c").alias("a"), F.col("q.qc").alias("b")).distinct().unionByName(
        nodes.where("fp <> c").select(F.col("fp").alias("a"), F.col("c").alias("b")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS,
                   max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, th (xxhash64 of the text), fp (long), component_id (smallest
    doc_id whose fingerprint is reachable through links of at most `max_bits` bits, its own included)
    and component_fp, one fingerprint of the group, which tells groups apart also where ids don't.

    Null and wordless texts have fingerprint 0 and link like others; repeated rows and equal
    texts share a component; a null id has component null unless another id is in its group;
    an empty table gives no rows; extra columns are ignored.  Without `segments` their number
    follows from that of the distinct fingerprints; the result doesn't depend on it."""
    fps = written(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash-fp")
    distinct = written(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "simhash-distinct")
    segments = segments or choose_segments(distinct.count(), max_bits)
    groups = components(links(distinct.select("fp", "n"), max_bits, segments))
    labelled = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("c"))
    ids = labelled.groupBy("c").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(ids, "c").select("fp", "component_id", F.col("c").alias("component_fp"))
    return fps.join(by_fp, "fp").select("doc_id", "th", "fp", "component_id", "component_fp")


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row with the smallest id (null
    last), then text hash; columns as in `docs`, of any types.

    Of rows that repeat both, the first by the JSON of their other columns stays.  Null and
    wordless texts are one group; an empty table gives no rows."""
    rows = simhash_groups(docs, id_col, text_col, **options).groupBy("component_fp", "doc_id", "th").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "rows"))
    kept = fresh(docs, "kept")
    mark = rows.groupBy("component_fp").agg(least.alias("least")).select(F.col("least").alias(kept))
    found = docs.join(mark, docs[id_col].eqNullSafe(F.col(f"{kept}.doc_id")) & (F.xxhash64(docs[text_col]) == F.col(f"{kept}.th")))
    once = found.where(F.col(f"{kept}.rows") == 1).select(docs.columns)
    # rows that repeat both id and text are few and only they are compared again
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    place = F.to_json(F.struct(*others)) if others else F.lit("")
    again = found.where(F.col(f"{kept}.rows") > 1).groupBy(kept).agg(F.min_by(F.struct(*docs.columns), place).alias("row"))
    return once.unionByName(again.select("row.*"))


@register("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_groups(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
