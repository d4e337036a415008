"""Embedding lookup and pooling.

Vectors are attached to the vocabulary (bounded by vocabulary size).  Pooling sums
them in the tasks: all, if their measured size allows, else those of the smallest ids, which in
a frequency-ordered vocabulary make up nearly all positions; only the other positions are
joined to their vectors.  Padding positions are not exploded: every padding position
holds the same vector, so the mean over all positions adds `n_pad * pad_vec`
analytically.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textloom.operators.dictionary import MOST_BYTES, MOST_ROWS, elements, map_arrays, map_arrays_to, small_table
from textloom.session import materialize

ROWS_AT_ONCE = 256  # rows whose vectors are gathered together


def attach_vectors(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """`(token, id, vec, has_vec)`; a token without a vector gets zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    j = vocab.select("token", "id").join(vectors.select("token", F.col("vec").alias("__v")), "token", "left")
    return j.select("token", "id", F.coalesce("__v", zeros).alias("vec"), F.col("__v").isNotNull().cast("int").alias("has_vec"))


def _vector_rows(values: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The numbers of vectors that all have `dim` of them, a row each."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if len(values) and pc.any(pc.not_equal(pc.list_value_length(values), dim)).as_py():
        raise ValueError(f"a vector has not {dim} numbers")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _vector_sums(df: DataFrame, vectors: pa.Table, dim: int, after: int | None = None):
    """Arrays of ids -> the sums of their vectors, in double; an id without a vector adds nothing.
    With `after`, ids above it are returned as well, as a second array."""
    rows = _vector_rows(vectors["vec"], dim)
    table = np.concatenate((rows, np.zeros((1, dim), rows.dtype)))
    held = df.sparkSession.sparkContext.broadcast((vectors["id"].combine_chunks(), table))

    def work(values: pa.Array, sizes: np.ndarray) -> list[tuple[pa.Array, np.ndarray]]:
        ids, table = held.value
        values = values.cast(ids.type)
        at = pc.fill_null(pc.index_in(values, value_set=ids, skip_nulls=True), len(table) - 1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        out = np.zeros((len(sizes), dim))
        for lo in range(0, len(sizes), ROWS_AT_ONCE):
            some = slice(lo, lo + ROWS_AT_ONCE)
            full = np.flatnonzero(sizes[some])
            if len(full):
                begin = ends[lo] - sizes[lo]
                picked = table[at[begin : ends[some][-1]]].astype(np.float64)
                out[lo + full] = np.add.reduceat(picked, (ends[some] - sizes[some] - begin)[full], axis=0)
        sums = pa.array(out.reshape(-1)), np.full(len(sizes), dim)
        if after is None:
            return [sums]
        above = pc.fill_null(pc.greater(values, after), False)
        upto = np.concatenate(([0], np.cumsum(above.to_numpy(zero_copy_only=False))))[np.concatenate(([0], ends))]
        return [sums, (values.filter(above), np.diff(upto))]

    return work


def _with_joined(held: DataFrame, keep: list[str], rest: DataFrame, dim: int) -> DataFrame:
    """`held` (`keep`, __sum and the ids __rest that are still to add) -> `keep` and the whole __sum.

    Rows get a number of their own, kept in a table, so equal keys stay apart; only the positions of __rest are joined."""
    rows = materialize(held.withColumn("__row", F.monotonically_increasing_id()))
    found = elements(rows, "__rest", "id", "__row").join(rest.select("id", F.col("vec").alias("__vec")), "id")
    lists = found.groupBy("__row").agg(F.flatten(F.collect_list("__vec")).alias("__all"))

    def add(values: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        numbers = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        begins = (np.cumsum(sizes) - sizes) // dim  # every row here has a vector
        return pa.array(np.add.reduceat(numbers, begins, axis=0).reshape(-1)), np.full(len(sizes), dim)

    more = map_arrays(lists, ["__row"], "__all", "__more", Ty.DoubleType(), add)
    both = F.zip_with("__sum", "__more", lambda a, b: a + b)
    return rows.join(more, "__row", "left").select(*keep, F.coalesce(both, F.col("__sum")).alias("__sum"))


def mean_pool(df: DataFrame, key: str, ids: str, length: str, id_vectors: DataFrame, max_len: int, dim: int,
              masked: bool = False, pad_id: int = 0, most_rows: int | None = None) -> DataFrame:
    """Mean of the token vectors of each row.

    masked=False divides by max_len and counts padding positions (as the
    reference's mean over the hidden states); masked=True averages the first
    `length` positions only (none: zeros).  One pass over `df`: vectors that fit into a task by their
    measured size are summed there, without a shuffle.  If they don't all fit, those of the smallest ids
    do, and the other real positions are joined to their vectors: few, where small ids are frequent
    ones; another order of the ids shuffles more and gives the same sums.  Gives `key` and `pooled ARRAY<DOUBLE>`.
    """
    id_vectors, held = small_table(id_vectors.select("id", "vec"), most_rows)
    real = df.select(key, F.col(length).alias("__len"), F.slice(F.col(ids), 1, F.col(length)).alias("__ids"))
    sums = ("__sum", Ty.DoubleType())
    if held is not None:
        base = map_arrays_to(real, [key, "__len"], "__ids", [sums], _vector_sums(real, held, dim))
    else:
        most = min(MOST_ROWS if most_rows is None else most_rows, MOST_BYTES // (8 * dim + 8))
        first = id_vectors.orderBy("id").limit(most).toArrow()
        last = pc.max(first["id"]).as_py() if first.num_rows else None
        rest = id_vectors if last is None else id_vectors.where(F.col("id") > last)
        ids = real.schema["__ids"].dataType.elementType
        both = map_arrays_to(real, [key, "__len"], "__ids", [sums, ("__rest", ids)],
                             _vector_sums(real, first, dim, -(1 << 62) if last is None else last))
        base = _with_joined(both, [key, "__len"], rest, dim)
    s = F.col("__sum")
    if masked:
        pooled = F.transform(s, lambda x: x / F.greatest(F.col("__len"), F.lit(1)))
        return base.select(key, pooled.alias("pooled"))
    # the pad id is unique in a vocabulary: its one vector (dim numbers) becomes a literal
    row = id_vectors.where(F.col("id") == pad_id).select("vec").first()
    pad_vec = [float(x) for x in row["vec"]] if row is not None else [0.0] * dim
    pad = F.array(*[F.lit(x).cast("double") for x in pad_vec])
    n_pad = F.lit(max_len) - F.col("__len")
    pooled = F.zip_with(s, pad, lambda a, p: (a + n_pad * p) / F.lit(float(max_len)))
    return base.select(key, pooled.alias("pooled"))


def first_ids(df: DataFrame, key: str, tokens: str, vocab: DataFrame, empty_id: int, unk_id: int = 0) -> DataFrame:
    """`(key, first)`: the id at position 0 of a layout without prefix; `empty_id` where a row has no token."""
    first = df.select(key, F.get(F.col(tokens), 0).alias("token"))
    j = first.join(vocab.select("token", F.col("id").alias("__id")), "token", "left")
    return j.select(key, F.when(F.col("token").isNull(), F.lit(empty_id)).otherwise(F.coalesce("__id", F.lit(unk_id))).cast("long").alias("first"))


def first_pool(df: DataFrame, key: str, ids: str, id_vectors: DataFrame, dim: int) -> DataFrame:
    """The vector at position 0 (only that position is joined)."""
    first = df.select(key, F.get(F.col(ids), 0).alias("id"))
    j = first.join(id_vectors.select("id", "vec"), "id", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("double"), dim)
    return j.select(key, "id", F.coalesce(F.transform("vec", lambda x: x.cast("double")), zeros).alias("pooled"))


def vec_summary(vec: Column) -> list[Column]:
    """Three scalars that pin a vector down in a result table: sum, L2 norm, first component."""
    v = F.transform(vec, lambda x: x.cast("double"))
    return [
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("vec_sum"),
        F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("vec_l2"),
        F.round(F.get(v, 0), 6).alias("vec_0"),
    ]
