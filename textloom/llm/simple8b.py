"""Token ids in word-aligned Simple-8b files.

A 64-bit word holds a selector in its upper four bits and as many ids of equal width as
fit the other 60; selector 0 is an escape whose payload is the place of a value of more than
60 bits in the frame's escape list.  Ids are coded in blocks that begin at a word of their
own, and every frame keeps the word offset of each block, so blocks decode independently
and all words of one selector at once.

A file is a row of frames, a frame: header (magic, documents, ids, blocks, words, escapes),
document ids, null flags, lengths, block offsets, words, escapes; all little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import default_tokenizer_path, encoder, text_runs
from textloom.llm.common import narrowed, read_table, scratch, written
from textloom.llm.registry import register

COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])  # values in a word, by selector
WIDTHS = np.array([60, *(60 // COUNTS[1:])])                            # and their bits; 0 is the escape
BLOCK = 256
FRAME_IDS = 1 << 20
MAGIC = 0x31305838424C5854
END_ID = 0


_SHORT = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.size and values.max() < np.uint64(1 << 16):
        return _SHORT[values]
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, side="right").astype(np.uint8)


def encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, escapes) of unsigned integers."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)  # zeros behind a block pad its last word
    full = n // BLOCK
    grid[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : n - full * BLOCK] = values[full * BLOCK :]
    bits = _bit_lengths(grid)
    fitting = np.zeros((blocks, BLOCK), np.int8)
    widest = {1: bits}  # by window length, the most bits that a value of the window starting here has
    for count in sorted(set(COUNTS[1:].tolist())):
        if count not in widest:
            half = max(c for c in widest if c < count)
            rest = widest[max(c for c in widest if c <= half and c >= count - half)]
            reach = bits.shape[1] - count + 1
            shift = count - (bits.shape[1] - rest.shape[1] + 1)
            widest[count] = np.maximum(widest[half][:, :reach], rest[:, shift : shift + reach])
        selector = 14 if count == 1 else int(np.flatnonzero(COUNTS[1:14] == count)[0]) + 1
        fitting += widest[count][:, :BLOCK] <= WIDTHS[selector]
    # a window that fits has all shorter ones fit, so their number is that of the longest one
    chosen = np.where(fitting > 0, 15 - fitting, 0)
    size = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    chosen = chosen.reshape(-1)
    at = BLOCK * np.arange(blocks)
    stop = at + size
    begins = np.zeros(blocks * BLOCK, bool)  # where a word begins; all blocks are walked at once
    while len(at):
        begins[at] = True
        at = at + COUNTS[chosen[at]]
        alive = at < stop
        at, stop = at[alive], stop[alive]
    place_of = np.flatnonzero(begins)
    row, col = np.divmod(place_of, BLOCK)
    selector = chosen[place_of]
    words = selector.astype(np.uint64) << np.uint64(60)
    cells = grid.reshape(-1)
    for s in range(1, 15):
        at_s = np.flatnonzero(selector == s)
        if len(at_s):
            place, word = row[at_s] * (BLOCK + 60) + col[at_s], words[at_s]
            for lane in range(int(COUNTS[s])):
                word |= cells[place + lane] << np.uint64(lane * int(WIDTHS[s]))
            words[at_s] = word
    escaped = np.flatnonzero(selector == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(row, np.arange(blocks)).astype(np.uint64)
    return words, offsets, grid[row[escaped], col[escaped]]


def decode_blocks(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The `n` values of `encode_blocks`."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    per_block = np.diff(np.append(offsets.astype(np.int64), len(words)))
    block = np.repeat(np.arange(len(offsets)), per_block)
    row = BLOCK + 60  # behind each block is room for the zeros that pad its last word
    out = np.zeros(len(offsets) * row, np.uint64)
    start = block * row + before - before[offsets.astype(np.int64)][block]
    for s in range(1, 15):
        at = np.flatnonzero(selector == s)
        if len(at):
            word, mask = words[at], np.uint64((1 << int(WIDTHS[s])) - 1)
            for lane in range(int(COUNTS[s])):
                out[start[at] + lane] = (word >> np.uint64(lane * int(WIDTHS[s]))) & mask
    at = np.flatnonzero(selector == 0)
    out[start[at]] = escapes[words[at].astype(np.int64)]
    return out.reshape(-1, row)[:, :BLOCK].reshape(-1)[:n]


def frame_bytes(doc_ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    words, offsets, escapes = encode_blocks(values)
    head = np.array([MAGIC, len(doc_ids), len(values), len(offsets), len(words), len(escapes)], "<u8")
    return b"".join([
        head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_frames(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, values) of each frame of an open file."""
    while head := stream.read(48):
        magic, docs, ids, blocks, n_words, n_escapes = np.frombuffer(head, "<u8").tolist()
        if magic != MAGIC:
            raise ValueError("not a token file, or a damaged one")
        take = lambda kind, n: np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)
        doc_ids, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
        offsets, words, escapes = take("<u8", blocks), take("<u8", n_words), take("<u8", n_escapes)
        yield ([None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist())], lengths.astype(np.int64),
               decode_blocks(words, offsets, escapes, ids))


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Encode every text, append `end_id`, and write files in ascending id order (nulls first; equal
    ids by text hash) under `folder`, which all executors must reach.  Returns the written
    list of files: part, name, docs, ids, bytes, folder.  The file format holds integer ids: others raise.

    A task writes one file under a name of its own try; only files of tasks that succeeded
    are listed, so a lost executor leaves at most a file that nothing reads."""
    from pyspark import TaskContext

    path = tokenizer or default_tokenizer_path()
    kept = narrowed(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    ordered = kept.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = encoder(path).encode
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.s8b"
        n_docs = n_ids = n_bytes = held = 0
        ids, lengths, raws = [], [], []
        out = None

        def flush() -> int:
            data = frame_bytes(ids, lengths, np.frombuffer(b"".join(raws), "<u4"))
            out.write(data)
            ids.clear(), lengths.clear(), raws.clear()
            return len(data)

        for batch in batches:
            for some in text_runs(batch, 1):
                out = out or system.open_output_stream(f"{base}/{name}")
                for doc_id, raw in zip(some.column(0).to_pylist(), encode(some.column(1))):
                    raw += end
                    ids.append(doc_id), lengths.append(len(raw) // 4), raws.append(raw)
                    held += len(raw) // 4
                    n_docs, n_ids = n_docs + 1, n_ids + len(raw) // 4
                    if held >= FRAME_IDS:
                        n_bytes, held = n_bytes + flush(), 0
        if out:
            if ids:
                n_bytes += flush()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [n_docs], "ids": [n_ids], "bytes": [n_bytes]},
                                             schema=pa.schema([("part", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    listed = ordered.mapInArrow(run, "part long, name string, docs long, ids long, bytes long")
    return written(listed.withColumn("folder", F.lit(folder)), "token-files")


def read_token_files(files: DataFrame, ids: bool = True) -> DataFrame:
    """Per document of the listed files, from their bytes: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit
    integers) and, if `ids`, the ids as such bytes."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = written(files.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0))), "token-file-bases")
    n = max(1, placed.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, base = fs.FileSystem.from_uri(row["folder"])
                start = row["base"]
                with system.open_input_stream(f"{base}/{row['name']}") as stream:
                    for doc_ids, lengths, values in read_frames(stream):
                        raw = values.astype("<u4").tobytes()
                        ends = np.cumsum(lengths)
                        begins = ends - lengths
                        cut = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                        arrays = [pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(lengths),
                                  pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if ids:
                            arrays, names = [*arrays, pa.array(cut, pa.binary())], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(arrays, names)
                        start += int(ends[-1])

    return placed.repartitionByRange(n, "part").mapInArrow(run, schema)


@register("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(read_table(spark, sf_dir, "documents"), scratch(spark, "token-files"))
    return read_token_files(files, ids=False)
