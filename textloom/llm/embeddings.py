"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) order the space: a vector is described by its `PREFIX` nearest
pivots.  Inverted lists are kept for every `SHARED` pivots out of a prefix, so two vectors
meet in a list exactly if they share at least `SHARED` pivots; a pair is taken up in the list
of its lowest shared pivots alone.  There its cosine is computed in double precision.

Equal vectors are compared once.  Long lists are cut into blocks and every pair of blocks is a
cell of its own, so no task holds a long list; a cell gives counts per vector and a spanning
forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import read_table, written
from textloom.llm.components import components
from textloom.llm.registry import register

MIN_COSINE = 0.95
PIVOTS = 256       # reference points of a small table; the sample they are chosen from has 8 times as many
MOST_PIVOTS = 4096  # and of a very large one
ROWS_PER_STEP = 1 << 16  # distinct vectors from which on pivots grow, with their cube root: lists then keep their length
PREFIX = 7
LONG_PREFIX = 9    # of more than `PIVOTS`
SHARED = 3
SPREAD = 0.7       # pivots are less similar to each other than this
BLOCK = 1024       # vectors of a list in a block
SMALL_LIST = 8
SEED = 42


def index_size(n: int) -> tuple[int, int]:
    """(pivots, prefix length) for `n` distinct vectors."""
    pivots = PIVOTS
    while pivots < MOST_PIVOTS and (2 * pivots // PIVOTS) ** 3 * ROWS_PER_STEP <= n:
        pivots *= 2
    return pivots, PREFIX if pivots == PIVOTS else LONG_PREFIX


def choose_pivots(sample: np.ndarray, dim: int, n: int = PIVOTS, spread: float = SPREAD) -> np.ndarray:
    """`n` unit vectors: sampled ones that are not too similar, then random directions."""
    out: list[np.ndarray] = []
    for v in sample:
        if len(out) < n and (not out or np.max(np.array(out) @ v) < spread):
            out.append(v)
    more = np.random.default_rng(SEED).normal(size=(n - len(out), dim))
    more /= np.maximum(np.linalg.norm(more, axis=1, keepdims=True), 1e-300)
    return np.concatenate([np.array(out).reshape(-1, dim), more])


def _unit(column: pa.Array) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    v = np.array(column.to_pylist(), dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """Numbers of each vector's nearest pivots, ascending by number."""
    near = np.argpartition(-(vectors @ pivots.T), length - 1, axis=1)[:, :length]
    return np.sort(near, axis=1)


def list_keys(prefix: np.ndarray, n_pivots: int, shared: int = SHARED) -> np.ndarray:
    """The lists of each vector: every choice of `shared` of its pivots as one number."""
    out = []
    for pick in combinations(range(prefix.shape[1]), shared):
        key = np.zeros(len(prefix), np.int64)
        for p in pick:
            key = key * n_pivots + prefix[:, p]
        out.append(key)
    return np.stack(out, axis=1)


def _lowest_shared(prefix_a: np.ndarray, prefix_b: np.ndarray, third: np.ndarray, shared: int) -> np.ndarray:
    """Whether pairs share no pivot up to the list's last one but the list's own."""
    same = (prefix_a[..., :, None] == prefix_b[..., None, :]).any(-1)
    return (same & (prefix_a <= third[..., None])).sum(-1) == shared


def link_cells(batches: Iterator[pa.RecordBatch], min_cosine: float, n_pivots: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, bi, bj, block, rep, copies, prefix, v) sorted by (key, bi, bj) -> (rep, n, root)."""
    def emit(rep, n, root):
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.int64())], ["rep", "n", "root"])

    def small(t: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
        rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
        v, prefix = _unit(t["v"].combine_chunks()), np.array(t["prefix"].to_pylist(), np.int64).reshape(len(rep), -1)
        third = t["key"].to_numpy() % n_pivots
        group = np.repeat(np.arange(len(sizes)), sizes)
        left, right = [], []
        for step in range(1, int(sizes.max())):
            i = np.flatnonzero(group[:-step] == group[step:])
            j = i + step
            ok = (v[i] * v[j]).sum(axis=1) >= min_cosine
            i, j = i[ok], j[ok]
            ok = _lowest_shared(prefix[i], prefix[j], third[i], shared)
            left.append(i[ok]), right.append(j[ok])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return emit(np.concatenate([rep[a], rep[b]]), np.concatenate([copies[b], copies[a]]), np.concatenate([np.minimum(rep[a], rep[b])] * 2))

    def cell(t: pa.Table) -> pa.RecordBatch | None:
        rep, copies, block = t["rep"].to_numpy(), t["copies"].to_numpy(), t["block"].to_numpy()
        v, prefix = _unit(t["v"].combine_chunks()), np.array(t["prefix"].to_pylist(), np.int64).reshape(len(rep), -1)
        third, bi, bj = t["key"][0].as_py() % n_pivots, t["bi"][0].as_py(), t["bj"][0].as_py()
        a = np.flatnonzero(block == bi)
        b = np.flatnonzero(block == bj) if bj != bi else a
        if not len(a) or not len(b):
            return None
        held = np.zeros((len(rep), n_pivots), np.float32)
        np.put_along_axis(held, prefix, 1.0, axis=1)
        held[:, third + 1 :] = 0
        linked = (v[a] @ v[b].T >= min_cosine) & (held[a] @ held[b].T == shared)
        if bi == bj:
            np.fill_diagonal(linked, False)
        n = np.zeros(len(rep), np.int64)
        n[a] += linked @ copies[b]
        if bi != bj:
            n[b] += linked.T @ copies[a]
        root = rep.copy()
        while True:  # the least vector reachable within the cell
            top = np.where(linked, root[b][None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            new = root.copy()
            new[a] = np.minimum(new[a], top)
            down = np.where(linked, new[a][:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
            new[b] = np.minimum(new[b], down)
            if (new == root).all():
                break
            root = new
        some = n > 0
        return emit(rep[some], n[some], root[some])

    held: list[pa.Table] = []

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = np.stack([t[c].to_numpy() for c in ("key", "bi", "bj")])
        begins = np.concatenate(([0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1))
        sizes = np.diff(np.append(begins, t.num_rows))
        short = (sizes <= SMALL_LIST) & (sizes > 1)
        dims = t["key"].to_numpy()[begins] // n_pivots**shared
        for d in np.unique(dims[short]).tolist():  # vectors of one length at a time
            some = short & (dims == d)
            yield small(t.filter(pa.array(np.repeat(some, sizes))), sizes[some])
        for at, n in zip(begins[sizes > SMALL_LIST].tolist(), sizes[sizes > SMALL_LIST].tolist()):
            if (out := cell(t.slice(at, n))) is not None:
                yield out

    for batch in batches:  # the last cell of a batch may go on in the next one
        held.append(pa.Table.from_batches([batch]))
        t = pa.concat_tables(held)
        last = [t[c][-1].as_py() for c in ("key", "bi", "bj")]
        ids = np.stack([t[c].to_numpy() for c in ("key", "bi", "bj")])
        cut = int((ids != np.array(last)[:, None]).any(axis=0).sum())  # sorted: all rows before the last cell
        if cut:
            yield from work(t.slice(0, cut))
        held = [t.slice(cut)]
    if held and held[0].num_rows:
        yield from work(pa.concat_tables(held))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE,
                 n_pivots: int | None = None, length: int | None = None, shared: int = SHARED) -> DataFrame:
    """One row per row: vec_id, n_links (other rows linked directly), component_id (smallest
    vec_id reachable, its own included), kept (vec_id = component_id).

    Links have cosine >= `min_cosine`; the index finds nearly all of them (recall is measured
    in the tests) and never another.  `n_pivots` and `length` follow the number of distinct vectors
    unless given.  Null, empty and zero vectors and those with null or non-finite components link
    with nothing.  Vectors of different lengths don't link.  Rows that repeat an id count as rows.  A row
    with a null id links and counts like any; its group takes the smallest other id, and a group of
    null ids alone has component null and all its rows are kept, as no id tells them apart.  An
    empty table gives no rows; other columns are ignored."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("v").isNotNull() & good, F.lit(False))
    # numbered when written: ids may repeat or be null, so a distinct vector has a number of its own
    distinct = written(rows.where(valid).groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumn(
        "rep", F.monotonically_increasing_id()), "vectors")
    if n_pivots is None:
        n_pivots, length = index_size(distinct.count())
    length = length or PREFIX

    # a sample of bounded size: the vectors with the least hashes
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(8 * n_pivots).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append(r.v)
    chosen = {d: choose_pivots(_unit(pa.array(vs)), d, n_pivots) for d, vs in by_dim.items()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = dict(chosen)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = np.array([len(x) for x in t["v"].to_pylist()])
            for d in np.unique(dims).tolist():
                some = t.filter(pa.array(dims == d))
                if d not in pivots:
                    pivots[d] = choose_pivots(np.zeros((0, d)), d, n_pivots)
                p = prefixes(_unit(some["v"].combine_chunks()), pivots[d], length)
                keys = list_keys(p, n_pivots, shared) + d * n_pivots**shared  # lists never mix lengths
                yield pa.RecordBatch.from_arrays(
                    [some["rep"].combine_chunks(), pa.array(p.tolist(), pa.list_(pa.int64())),
                     pa.array(keys.tolist(), pa.list_(pa.int64()))], ["rep", "prefix", "keys"])

    index = written(distinct.select("rep", "v").mapInArrow(describe, "rep long, prefix array<long>, keys array<long>"), "pivot-index")
    posts = index.select("rep", F.explode("keys").alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = posts.join(lists, "key").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "rep", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    full = cells.join(index.select("rep", "prefix"), "rep").join(distinct.select("rep", "copies", "v"), "rep")
    full = full.select("key", "bi", "bj", "block", "rep", "copies", "prefix", "v")
    full = full.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return link_cells(batches, min_cosine, n_pivots, shared)

    found = written(full.mapInArrow(run, "rep long, n long, root long"), "vector-links")
    groups = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("others"))
    labelled = distinct.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep"))
    least = labelled.groupBy("c").agg(F.min("first_id").alias("least_id"))
    by_vector = labelled.join(least, "c").select(
        F.col("v").alias("same"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), "least_id")
    out = rows.withColumn("valid", valid).join(by_vector, F.col("valid") & (F.col("v") == F.col("same")), "left")
    component = F.coalesce("least_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


@register("op1_pivot_permutation")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
