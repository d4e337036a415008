"""Quoted CSV with line breaks inside fields, read by any number of tasks.

Whether a line of such a file begins a record depends on all quotes before it.  A first pass
counts quotes by split; the parity of the counts before a split, a prefix sum over one row a
split, tells it whether it begins inside a field.  In a second pass every split cuts its own
records.  Only the pieces of a record that crosses splits are shuffled, and joined by the split
in which it began.  Records are parsed one by one in the JVM, by the options of the plain reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textloom.sources.files import READ_OPTIONS, split_lines

_PIECE = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("first", pa.bool_()), ("text", pa.string())])


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """(file, block, lines, quotes of each line) of consecutive rows of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        value, file, block = batch.column(0), batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        which = file.indices.to_numpy()
        edges = np.flatnonzero((which[1:] != which[:-1]) | (block[1:] != block[:-1])) + 1
        quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield file.dictionary[int(which[a])].as_py(), int(block[a]), value.slice(a, b - a), quotes[a:b]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, quotes, turns): the split's quotes, and whether a line of it follows an odd number of them."""
    seen: dict[tuple[str, int], list] = {}
    for file, block, _, quotes in _by_split(batches):
        state = seen.setdefault((file, block), [0, False])
        before = state[0] + np.cumsum(quotes) - quotes
        state[1] |= bool((before % 2).any())
        state[0] += int(quotes.sum())
    cols = list(zip(*[(f, b, n, t) for (f, b), (n, t) in seen.items()])) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["file", "block", "quotes", "turns"])


def split_states(counts: list) -> dict[tuple[str, int], tuple[int, int]]:
    """For every split: whether it begins inside a field, and the split in which the record that
    is open at its begin began.  `counts` has a row per split."""
    out: dict[tuple[str, int], tuple[int, int]] = {}
    file, parity, owner = None, 0, 0
    for r in sorted(counts, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, parity, owner = r["file"], 0, r["block"]
        out[(file, r["block"])] = (parity, owner)
        if not parity or r["turns"]:  # some record begins here
            owner = r["block"]
        parity = (parity + r["quotes"]) % 2
    return out


def _records(states: dict[tuple[str, int], tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        inside = first = False
        owner = 0
        open_: list[str] = []  # lines of the record that is not complete yet
        head = False           # it began before this split

        def close() -> Iterator[tuple]:
            if open_:
                yield at[0], owner if head else at[1], at[1], first, "\n".join(open_)
                open_.clear()

        for file, block, lines, quotes in _by_split(batches):
            rows: list[tuple] = []
            if (file, block) != at:
                rows += close()
                at = (file, block)
                parity, owner = states[at]
                inside = head = bool(parity)
                first = block == 0
            for line, odd in zip(lines.to_pylist(), (quotes % 2).tolist()):
                open_.append(line)
                inside ^= bool(odd)
                if not inside:
                    rows.append((file, owner if head else None, block, first and not head, "\n".join(open_)))
                    open_.clear()
                    first = head = False
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, _PIECE)], schema=_PIECE)
        rows = list(close())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, _PIECE)], schema=_PIECE)

    return run


def read_csv_parallel(spark: SparkSession, path: str, schema: Ty.StructType, header: bool = True) -> DataFrame:
    """The rows of quoted CSV files, as `files.read_csv` reads them: fields may hold line breaks and
    doubled quotes; a header must name the schema's columns in order; a malformed row is an error.
    A quote stands only in quoted fields (as every CSV writer has it).  Needs a path whose files are not
    compressed to be read by more than one task a file."""
    lines = split_lines(spark, path).select("value", "file", "block")
    counts = lines.mapInArrow(_count, "file string, block long, quotes long, turns boolean")
    states = split_states([r.asDict() for r in counts.collect()])  # one short row per split
    pieces = lines.mapInArrow(_records(states), "file string, owner long, block long, first boolean, text string")
    whole = pieces.where("owner is null").select("file", "first", "text")
    crossing = pieces.where("owner is not null").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "first", "text"))).alias("p")).select(
        "file", F.col("p")[0]["first"].alias("first"), F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))
    text = F.regexp_replace("text", "\r$", "")
    records = whole.unionByName(crossing).select("first", text.alias("text")).where("text <> ''")
    if header:
        names = ",".join(schema.names)
        said = F.regexp_replace("text", '"', "")
        wrong = F.raise_error(F.concat(F.lit(f"the header is not {names}: "), F.substring(said, 1, 200))).cast("boolean")
        records = records.where(F.when(F.col("first"), F.when(said == names, F.lit(False)).otherwise(wrong)).otherwise(F.lit(True)))
    options = {k: v for k, v in READ_OPTIONS.items() if k not in ("enforceSchema", "encoding")}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("text", columns, options).alias("r")).select("r.*")
