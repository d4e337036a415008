"""Byte-level BPE encoding inside tasks, with the `tokenizers` library.

The pre-tokenizer of a byte-level BPE never joins text across a single space
that stands between two non-space characters, so the space-led chunks between
such places encode independently.  An `Encoder` has the library encode each distinct
chunk once and joins the stored ids.  Texts are cut, and their chunks numbered, by Arrow for some megabytes at a
time, so Python asks the store once for each distinct chunk of such a run.  Inside a chunk it cuts at two more places that end a unit for any text:
around a line break between two non-space characters, and between a letter or digit and the marks that end the chunk.
A text that holds the string of an added token goes to the library whole.
The store is bounded, in two generations, and ids never depend on it.  A worker that has not encoded for some seconds
empties it, so the steps after it find the memory free.  Ids are little-endian unsigned 32-bit.
"""

from __future__ import annotations

import codecs
import re
import string
import struct
import sys
import threading
import time
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STORE_ENTRIES = 300_000  # bound of each of two generations of the chunk store; never changes ids
RUN_BYTES = 1 << 23      # text that is cut at once; never changes ids
IDLE_SECONDS = 3.0       # without a text to encode, until a worker empties its store; never changes ids
MARKS = string.punctuation
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_KEPT = "textloom_encoders"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    """One encoder per Python worker and file.  The package's code comes with each task, and its
    globals are new each time; what outlives a task hangs on a module of the worker's own."""
    kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
        threading.Thread(target=kept[path].empty_when_idle, daemon=True).start()
    return kept[path]


def _byte_letters() -> str:
    """The letter by which byte-level BPE writes each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return "".join(letters[b] for b in range(256))


_LETTERS = _byte_letters()


def text_runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `RUN_BYTES` bytes of text in `column`, or one text that has more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(upto // RUN_BYTES)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


class _Chunks(dict):
    """Chunk -> ids of `lead` + chunk; learnt from `ids_of` when first asked for.  `bare` holds chunks without a lead.
    A chunk that touches more white space than the one space before it has None."""

    def __init__(self, ids_of: Callable[[str, str], bytes], lead: str, bare: "_Chunks | None" = None):
        self.ids_of, self.lead = ids_of, lead
        self.bare = self if bare is None else bare
        self.line_break = ids_of("", "\n")
        self.old: dict[str, bytes] = {}

    def renew(self) -> None:
        """Start a new generation when this one is full; what is met again moves over."""
        if len(self) > STORE_ENTRIES:
            self.old = dict(self)
            self.clear()

    def empty(self) -> None:
        self.old = {}
        self.clear()

    def __missing__(self, chunk: str) -> bytes | None:
        if (ids := self.old.get(chunk)) is None:
            if not chunk.isalpha():
                if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                    return None
                if "\n" in chunk:
                    first, *others = chunk.split("\n")
                    lines = [self[first], *[self.bare[line] for line in others]]
                    if None not in lines:
                        return self.line_break.join(lines)
                word = chunk.rstrip(MARKS)
                if word and len(word) < len(chunk) and word[-1].isalnum():
                    ids = (self.get(word) or self.old.get(word) or self.ids_of(self.lead, word)) + self.bare[chunk[len(word) :]]
            if ids is None:
                ids = self.ids_of(self.lead, chunk)
        self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.model._resize_cache(0)  # the store below holds what repeats
        self.model = self.tokenizer.model
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(64)]
        self.first = _Chunks(self.ids_of, "")
        self.later = _Chunks(self.ids_of, " ", self.first)
        self.busy, self.used = threading.Lock(), time.monotonic()

    def empty_when_idle(self) -> None:
        """Never ends: for a thread of the worker's own."""
        while True:
            time.sleep(IDLE_SECONDS / 3)
            with self.busy:
                if time.monotonic() - self.used > IDLE_SECONDS and (self.first or self.later):
                    self.first.empty(), self.later.empty()

    def ids_of(self, lead: str, chunk: str) -> bytes:
        """The ids of `lead` (a space or nothing) and `chunk`."""
        if chunk.isalpha():  # letters, and a space before them, are one unit to the pre-tokenizer
            if chunk.isascii():
                unit = _LETTERS[32] + chunk if lead else chunk
            else:
                unit = codecs.charmap_decode((lead + chunk).encode(), "strict", _LETTERS)[0]
            ids = [u.id for u in self.model.tokenize(unit)]
            return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, "<u4").tobytes()
        return self._whole(lead + chunk)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none) as packed little-endian uint32.  Hand in some megabytes at a time."""
        with self.busy:
            out = self._encode(texts) if len(texts) else []
            self.used = time.monotonic()
        return out

    def _encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_string())
        for chunks in (self.first, self.later):
            chunks.renew()
        parts = pc.split_pattern(column, " ")
        ends = parts.offsets.to_numpy()
        heads = ends[:-1]
        numbered = parts.flatten().dictionary_encode()
        codes = numbered.indices.to_numpy().astype(np.int64)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False)
        firsts = distinct[codes[heads]].tolist()
        codes[heads] = len(distinct) + np.arange(len(firsts))  # the first chunk of a text has no space before it
        stored = pa.array([*map(self.later.__getitem__, distinct.tolist()), *map(self.first.__getitem__, firsts)], pa.large_binary())
        joined = stored.take(pa.array(codes))
        at = np.frombuffer(joined.buffers()[1], np.int64, len(codes) + 1)[ends]
        raw = memoryview(joined.buffers()[2] or b"")
        out = [bytes(raw[lo:hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]

        alone = np.zeros(len(out), bool)
        if stored.null_count:
            alone |= np.logical_or.reduceat(stored.is_null().to_numpy(zero_copy_only=False)[codes], heads)
        for token in self.added:
            alone |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(alone).tolist():
            out[i] = self._one(column[i].as_py())
        return out

    def _one(self, text: str) -> bytes:
        """The ids of a text that holds an added token, or more white space in a row than one space or line break."""
        if any(token in text for token in self.added):  # cut out before any pre-tokenizing, also inside words
            return self._whole(text)
        if not text:
            return b""
        parts = _SPLIT.split(text)
        rest = [self.ids_of(" ", p) if p[0].isspace() or p[-1].isspace() else self.later[p] for p in parts[1:]]
        return self.ids_of("", parts[0]) + b"".join(rest)
