"""Problem 8: encoding of the whole corpus with a public byte-level BPE vocabulary.

The vocabulary is turned into a sentencepiece BPE model by writing the model
file's fields directly: every byte is mapped to one visible character, a piece's
score is its negative rank, and nothing is normalised. Texts are cut into
pre-tokens, each is encoded by that model, and the ids are the ranks.
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
CACHE = 400_000  # chunks and pre-tokens a worker keeps,
LONGEST_KEPT = 64  # none of them longer than this
BATCH = 500  # texts encoded together
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# blanks to Python's re that are no white space to the pattern
_ODD = re.compile("[\x1c-\x1f]")


@contextmanager
def no_collection() -> Iterator[None]:
    """Without cyclic garbage collection: nothing here has cycles, and walking a large cache again and again takes longer than the work itself. Workers are used again, so it is turned on afterwards."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def byte_characters() -> list[str]:
    """For each byte one visible character: itself where it is one, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of the model file: bytes are length-delimited, ints varints, floats 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is token i, and piece ``len(tokens)`` is the unknown one it never needs."""
    to = byte_characters()
    pieces = [_field(1, _field(1, "".join(to[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(tokens)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes and decodes with one vocabulary; built once a Python worker."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.tokens = read_ranks(f"{folder}/{vocabulary}.tiktoken")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.map = {chr(b): c for b, c in enumerate(byte_characters())}
        self.table = str.maketrans(self.map)
        self.back = {c: b for b, c in enumerate(byte_characters())}
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _learn(self, chunks: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of ``chunks``, whose pre-tokens are encoded together where no earlier batch met them."""
        cut = {c: self.pattern.findall(c) for c in chunks}
        known = self.cache
        new = list({t for parts in cut.values() for t in parts if t not in known})
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for t in new]
        fresh = dict(zip(new, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True)) if new else {}  # tuples: the garbage collector passes them by
        ids = {c: tuple([i for t in parts for i in (fresh[t] if t in fresh else known[t])]) for c, parts in cut.items()}
        if len(known) + len(fresh) + len(ids) > CACHE:
            known.clear()
        known.update((t, x) for t, x in fresh.items() if len(t) <= LONGEST_KEPT)
        known.update((c, x) for c, x in ids.items() if len(c) <= LONGEST_KEPT)
        return ids

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for a null or an empty one."""
        # no pre-token crosses the border between two chunks, so a chunk's ids don't depend on its neighbours
        chunks = [[] if not t else self.pattern.findall(t) if _ODD.search(t) else _CHUNK.findall(t) for t in texts]
        have = {c: x for c in {c for row in chunks for c in row} if (x := self.cache.get(c)) is not None}
        have |= self._learn({c for row in chunks for c in row if c not in have})
        out = []
        for row in chunks:
            ids: list[int] = []
            for c in row:
                ids += have[c]
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: pieces are looked up and their characters mapped back to bytes."""
        mapped = "".join(self.model.id_to_piece(int(i)) for i in ids)
        return bytes(self.back[c] for c in mapped).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Encoder:
    key = (folder, vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(folder, vocabulary)
    return _ENCODERS[key]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BATCH):
        yield batch.slice(i, BATCH)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row a row of ``df``; null and empty texts have an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            for part in _parts(b):
                with no_collection():
                    rows = enc.encode_batch(part.column(1).to_pylist())
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(x) for x in rows], out=offsets[1:])
                flat = np.fromiter((i for x in rows for i in x), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the lengths of the lists of :func:`encode_texts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            for part in _parts(b):
                with no_collection():
                    n = np.array([len(x) for x in enc.encode_batch(part.column(1).to_pylist())], np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the inverse of :func:`encode_texts`; a null list gives null, an empty one the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
