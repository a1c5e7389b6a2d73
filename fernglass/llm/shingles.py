"""Words and runs of words as 64-bit hashes, whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.lookalike import words

VOCABULARY = 500_000  # words a worker keeps
BATCH = 2_000  # texts hashed together
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; every value has one image."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Word hashes of texts, with a cache of the words met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words of each text)."""
        known = self.known
        if len(known) > VOCABULARY:
            known.clear()
        flat: list[int] = []
        n = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                ws = words(t)
                n[i] = len(ws)
                for w in ws:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                    flat.append(h)
        return np.array(flat, np.uint64), n


def distinct_within(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values of each owner, offsets of the owners)."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(o, minlength=n), out=offsets[1:])
    return v, offsets


def runs(ids: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, owner) of every run of ``size`` consecutive words that stays within its text."""
    owner = np.repeat(np.arange(len(n)), n)
    if size == 1:
        return mix(ids), owner
    m = len(ids) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(size):
        h = mix(h * M1 + ids[k : k + m] + M2)
    inside = owner[:m] == owner[size - 1 :]
    return h[inside], owner[:m][inside]


def sequence_hash(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash of each text's whole sequence of words, whatever separates them."""
    ends = np.cumsum(n)
    starts = ends - n
    where = np.arange(len(ids), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), n)
    terms = mix(ids + mix(where * M3 + M1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mix(total[ends] - total[starts] + n.astype(np.uint64) * M2)


def hashed_runs(df: DataFrame, size: int, keys: list[str], text: str = "text", distinct: bool = True) -> DataFrame:
    """(keys, words, form, runs): per row the number of words, a hash of the whole sequence of words, and the sorted distinct hashes of its runs of ``size`` words.

    A null or empty text has 0 words and no runs; so has one shorter than
    ``size`` no runs.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                ids, n = hasher.ids(b.column(len(keys)).to_pylist())
                h, owner = runs(ids, n, size)
                v, offsets = distinct_within(h, owner, b.num_rows)
                listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(len(keys))), pa.array(n.astype(np.int32)), pa.array(sequence_hash(ids, n).view(np.int64)), listed],
                    names=[*keys, "words", "form", "runs"],
                )

    return df.select(*keys, text).mapInArrow(run, f"{kinds}, words int, form long, runs array<long>")


def jaccard(a, b):
    """Common values divided by all values of two arrays without repeats; null where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0))
