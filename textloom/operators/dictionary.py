"""Lookups of array elements in a table of values, by the table's measured size.

A table that is small enough (`MOST_ROWS`, `MOST_BYTES`, both measured) goes to the tasks as a
dictionary: elements are looked up where they are, in whole Arrow batches, and nothing is shuffled.
A larger one is joined: every document gives one row per *distinct* element with the list of
its places, these rows meet the table, and come together again by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textloom.session import materialize

MOST_ROWS = 1_000_000
MOST_BYTES = 64 << 20
ELEMENTS_AT_ONCE = 1 << 19  # array elements that a task works on together


def elements(df: DataFrame, array: str | Column, out: str, *keep: str) -> DataFrame:
    """`keep` and `out`: a row per element of `array`.

    For a plain `explode` Spark infers a filter on the size of the array, which computes all of the
    array's expression, Arrow UDFs included, once more."""
    spread = df.select(*keep, F.posexplode_outer(array).alias("__pos", out))
    return spread.where(F.col("__pos").isNotNull()).select(*keep, out)


def measured(table: DataFrame, most_rows: int | None = None, most_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """(the table, computed once and for all, and whether its rows are few and short enough for every task)."""
    table = materialize(table)
    width = F.lit(0)
    for f in table.schema.fields:
        col = F.col(f.name)
        width = width + F.coalesce(F.octet_length(col) if isinstance(f.dataType, Ty.StringType)
                                   else F.size(col) * 8 if isinstance(f.dataType, Ty.ArrayType) else F.lit(8), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    few = rows <= (MOST_ROWS if most_rows is None else most_rows) and size <= (MOST_BYTES if most_bytes is None else most_bytes)
    return table, few


def small_table(table: DataFrame, most_rows: int | None = None, most_bytes: int | None = None) -> tuple[DataFrame, pa.Table | None]:
    """(the table, computed once and for all, and its rows if they are few and short enough)."""
    table, few = measured(table, most_rows, most_bytes)
    return table, table.toArrow() if few else None


def sent_if_small(table: DataFrame, most_rows: int | None = None) -> DataFrame:
    """The table, computed once and for all; a join sends it to the tasks if its rows are few and short enough."""
    table, few = measured(table, most_rows)
    return F.broadcast(table) if few else table


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the elements of all arrays, how many each row has); a null array has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def nested(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def in_parts(batch: pa.RecordBatch, at: int, most: int = ELEMENTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose arrays in column `at` hold `most` elements together, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def map_arrays_to(df: DataFrame, keep: Sequence[str], array: str, outs: Sequence[tuple[str, Ty.DataType]],
                  work: Callable[[pa.Array, np.ndarray], Sequence[tuple[pa.Array, np.ndarray]]]) -> DataFrame:
    """`keep` and `outs`, array columns made from the elements and sizes of `array` by `work`, some
    `ELEMENTS_AT_ONCE` at a time: a task's memory depends on neither batch nor table size."""
    df = df.select(*keep, F.col(array).alias("__array"))
    schema = Ty.StructType([df.schema[k] for k in keep] + [Ty.StructField(out, Ty.ArrayType(kind)) for out, kind in outs])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, len(keep)):
                columns = [nested(*made) for made in work(*flat(part.column(len(keep))))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names)

    return df.mapInArrow(run, schema)


def map_arrays(df: DataFrame, keep: Sequence[str], array: str, out: str, kind: Ty.DataType,
               work: Callable[[pa.Array, np.ndarray], tuple[pa.Array, np.ndarray]]) -> DataFrame:
    """As `map_arrays_to`, for one array column `out`."""
    return map_arrays_to(df, keep, array, [(out, kind)], lambda values, sizes: [work(values, sizes)])


def _places(df: DataFrame, keep: Sequence[str], array: str) -> DataFrame:
    """`keep`, size, element, places: one row per distinct element of a row's array; an empty array gives one without element."""
    df = df.select(*keep, F.col(array).alias("__array"))
    element = df.schema["__array"].dataType.elementType
    item = Ty.StructType([Ty.StructField("element", element), Ty.StructField("places", Ty.ArrayType(Ty.IntegerType()))])
    schema = Ty.StructType([df.schema[k] for k in keep] + [Ty.StructField("__size", Ty.IntegerType()), Ty.StructField("__items", Ty.ArrayType(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes = [], []
            for values in batch.column(len(keep)).to_pylist():
                at: dict = {}
                for i, v in enumerate(values or ()):
                    at.setdefault(v, []).append(i)
                sizes.append(len(values or ()))
                items.append([{"element": v, "places": p} for v, p in at.items()])
            kind = pa.list_(pa.struct([("element", batch.schema.field(len(keep)).type.value_type), ("places", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int32()), pa.array(items, kind)], [*keep, "__size", "__items"])

    return df.mapInArrow(run, schema).select(*keep, "__size", F.explode_outer("__items").alias("__i")).select(*keep, "__size", "__i.*")


def lookup(df: DataFrame, keep: Sequence[str], array: str, table: DataFrame, by: str, value: str, out: str, default=None,
           most_rows: int | None = None) -> DataFrame:
    """`keep` (the first is the key) and `out`: for every element of `array` the `value` of the table's
    row whose `by` equals it, else `default`.  A null array gives an empty one; `by` is unique and never null."""
    table, rows = small_table(table.select(by, value), most_rows)
    kind = table.schema[value].dataType
    if rows is not None:
        held = df.sparkSession.sparkContext.broadcast((rows[by].combine_chunks(), rows[value].combine_chunks()))

        def find(values: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            names, given = held.value
            got = given.take(pc.index_in(values.cast(names.type), value_set=names, skip_nulls=True))
            return (got if default is None else pc.fill_null(got, default)), sizes

        return map_arrays(df, keep, array, out, kind, find)
    places = _places(df, keep, array)
    found = places.join(table.select(F.col(by).alias("element"), F.col(value).alias("__v")), "element", "left")
    item = F.struct("places", F.coalesce("__v", F.lit(default)).cast(kind).alias("v"))
    wide = found.groupBy(*keep, "__size").agg(F.collect_list(F.when(F.col("places").isNotNull(), item)).alias("__items"))
    spread = F.flatten(F.transform("__items", lambda i: F.transform(i["places"], lambda p: F.struct(p.alias("p"), i["v"].alias("v")))))
    return wide.select(*keep, F.transform(F.array_sort(spread), lambda x: x["v"]).alias(out))

