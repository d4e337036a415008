"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Pieces are dealt by hash into groups of bounded size, and each group is packed in one
task: longest pieces first, each into the tightest open sequence that holds it.  A segment
tree over the remaining capacities finds that sequence in logarithmic time.  With tens of
thousands of pieces a group, a group wastes less than one sequence more than one packing of
all pieces would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe import default_tokenizer_path, encoder, text_runs
from textloom.llm.common import narrowed, read_table, releasing, written
from textloom.llm.registry import register

CAPACITY = 1024
END_ID = 2
PIECES_PER_GROUP = 50_000


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
               end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): a document's token ids and `end_id`, cut into pieces of
    `capacity` ids if it has more; then the first piece is the one that may be shorter.
    `ids` holds little-endian unsigned 32-bit ids.  A null text is empty: one piece, `end_id` alone."""
    path = tokenizer or default_tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()
    kept = narrowed(docs, id_col, text_col)
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for part in text_runs(batch, 1):
                rows: list[tuple] = []
                for i, raw in enumerate(encode(part.column(1))):
                    raw += end
                    n = len(raw) // 4
                    start = 0
                    for piece in range(-(-n // capacity)):
                        stop = start + (n % capacity or capacity) if piece == 0 else start + capacity
                        rows.append((i, piece, start, stop - start, raw[4 * start : 4 * stop]))
                        start = stop
                who, piece, starts, lengths, ids = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return kept.mapInArrow(releasing(run), schema)


class OpenBins:
    """Open bins by remaining capacity: a segment tree whose leaf c counts those with c left."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, bin_: int, room: int) -> None:
        if room:
            self.bins[room].append(bin_)
            self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the bin with the least room that is at least `need`: (bin, room)."""
        tree, node = self.tree, need + self.leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    open_, n = OpenBins(capacity), 0
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        found = open_.tightest(need)
        if found is None:
            bin_, room, n = n, capacity, n + 1
        else:
            bin_, room = found
        bins[i], offsets[i] = bin_, capacity - room
        open_.put(bin_, room - need)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = PIECES_PER_GROUP) -> DataFrame:
    """`pieces` (with doc_id, piece, start, length of 1 to `capacity`; more columns ride along) and
    sequence_id, offset.  `pieces` is read twice, so hand in a written table without ids.

    Repeated rows are packed one by one; null ids count as any; no rows give none."""
    groups = max(1, -(-pieces.count() // group_rows))
    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "length", F.lit("deal")), F.lit(groups)).alias("group")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start"], kind="stable").drop(columns="group_")
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    return pieces.withColumn("group_", dealt).groupBy("group_").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_pieces(docs, id_col, text_col, capacity, end_id, tokenizer)
    slim = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(slim, capacity)


@register("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
