"""The chunk encoder gives the ids that the library gives for the whole text."""

from __future__ import annotations

import random
import sys
import time

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from tokenizers import Tokenizer

from textloom.llm import bpe
from textloom.llm.common import releasing


def test_chunks_equal_whole_texts():
    ours = bpe.Encoder(bpe.default_tokenizer_path())
    library = Tokenizer.from_file(bpe.default_tokenizer_path())  # the plain call
    rnd = random.Random(7)
    parts = [*"ab \n\t.,*#'$_-<|>0\r", "\u00e9", "\u00b2", "\u2460", "\u4e2d", "\x1c", "\x85", "\u3000", "'s", "'ll", "\n\n", " \n", "end.\nNext", "word***", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 16))) for _ in range(4000)]
    want = [np.asarray(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert ours.encode(texts) == want
    assert ours.encode([None, "", *texts]) == [b"", b"", *want]  # met before, and nothing to encode


def test_added_tokens_are_cut_out_as_by_the_library():
    ours, library = bpe.Encoder(bpe.default_tokenizer_path()), Tokenizer.from_file(bpe.default_tokenizer_path())
    special = "<|endoftext|>"
    texts = [special, f"a {special} b", f"x{special}", f"in{special}side words", f"  {special}\n", f"{special}{special} two", f"a b {special[:-1]} c", f"word {special} " * 50]
    for text in texts:
        assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ours.encode(texts[1:2])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_encoder_outlives_the_task_that_made_it():
    """The package's code comes with each task by value; the stored chunks stay in the worker."""
    path = bpe.default_tokenizer_path()
    task = cloudpickle.dumps(lambda: bpe.encoder(path))
    first, second = cloudpickle.loads(task)(), cloudpickle.loads(task)()
    assert first is second


def test_idle_worker_empties_its_store(monkeypatch):
    """Later steps of a job run in the same workers and need the memory."""
    monkeypatch.delitem(sys.modules, bpe._KEPT, raising=False)
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.6)
    ours = bpe.encoder(bpe.default_tokenizer_path())
    texts = ["The first text.\nAnd its second line", "another one", None]
    want = ours.encode(texts)
    assert ours.first and ours.later
    until = time.monotonic() + 20
    while (ours.first or ours.later or ours.first.old or ours.later.old) and time.monotonic() < until:
        time.sleep(0.05)
    assert not (ours.first or ours.later or ours.first.old or ours.later.old)
    assert ours.encode(texts) == want


def test_runs_and_columns_equal_whole_texts(monkeypatch):
    library = Tokenizer.from_file(bpe.default_tokenizer_path())
    monkeypatch.setattr(bpe, "RUN_BYTES", 64)
    monkeypatch.setattr(bpe, "STORE_ENTRIES", 5)
    rnd = random.Random(3)
    words = ["the", "The", "\u00e9t\u00e9", "\u4e2d\u6587", "end.\nNext", "a\n\nb", "a\nb,\nc", "word***", "\t", "", "x2", "<|endoftext|>"]
    texts = [None, "", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(300)], None, "z" * 500, "last"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    ours, got, seen = bpe.Encoder(bpe.default_tokenizer_path()), [], []
    for run in bpe.text_runs(batch, 1):
        assert run.num_rows == 1 or sum(len((t or "").encode()) for t in run.column(1).to_pylist()[1:]) <= 64
        seen += run.column(0).to_pylist()
        got += ours.encode(run.column(1))
    assert seen == list(range(len(texts)))
    assert got == [np.asarray(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert ours.encode(batch.column(1).slice(7, 20)) == got[7:27]
    assert list(bpe.text_runs(batch.slice(0, 0), 1)) == [] and ours.encode([]) == []


def test_task_gives_freed_memory_back(monkeypatch):
    order = []

    class Pool:
        def release_unused(self):
            order.append("released")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    for got in releasing(lambda batches: (b + 1 for b in batches))(iter([1, 2])):
        order.append(got)
    assert order == [2, 3, "released"]
