"""Problem 9: filling fixed-capacity containers with items (minimum bin slack).

The plan is made over the histogram of item lengths, which has at most
``capacity`` rows whatever the corpus's size, so the driver may hold it. Each
step takes the longest length left and lets a subset-sum dynamic program over
bitsets choose, among all lengths left, the multiset that fills the rest of the
window closest to the capacity; the counts are found by walking back through the
bitsets. A pattern is used as often as its lengths last, so the number of
patterns depends on the lengths and not on the number of items. Items are then
numbered within their length and looked up in the pattern that owns the number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.llm.tokenizer import TOKENIZERS, VOCABULARY, count_tokens
from fernglass.runtime import materialize

CAPACITY = 2048
ROWS_A_PART = 250_000  # pieces numbered by one task, about


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of lengths of ``counts`` whose sum is the largest that isn't over ``room``.

    Bit s of a bitset says whether the sum s can be reached. A length used up to
    c times is entered as 1, 2, 4, ... copies and a rest; larger lengths come first,
    and the search stops at the first bitset that reaches ``room``. Walking back
    prefers a sum that was reachable without the length at hand.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pattern, times)]: patterns of lengths, in the order made, and how often each is used; together they use the histogram up."""
    left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = fill(left, capacity - seed)
        left[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


def pieces(counts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """(key, piece, size): an item as one piece; one longer than the capacity as full pieces and a rest. Items without tokens have no piece."""
    whole = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    split = F.transform(F.sequence(F.lit(0), whole), lambda i: F.struct(i.alias("piece"), F.least(F.lit(capacity), F.col("n_tokens") - i * capacity).cast("int").alias("size")))
    return counts.where("n_tokens > 0").select(key, F.explode(split).alias("p")).select(key, "p.piece", "p.size")


def numbered(df: DataFrame, size: str, order: list[str], parts: int) -> DataFrame:
    """``df`` with ``number``: 0, 1, 2, ... within each ``size``, without gathering a size in one task.

    Rows are dealt to ``parts`` by a hash; counts per (size, part), which are few,
    give each part's first number, and rows are numbered within (size, part).
    """
    d = df.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    per = d.groupBy(size, "part").agg(F.count(F.lit(1)).alias("n"))
    first = per.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy(size).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(size, "part", "first")
    local = d.withColumn("local", F.row_number().over(Window.partitionBy(size, "part").orderBy(*order)) - 1)
    return local.join(first, [size, "part"]).withColumn("number", F.col("first") + F.col("local")).drop("local", "first", "part")


def pack(counts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """(key, piece, size, container): every piece with the number of its container; containers are numbered from 0.

    Sizes in a container never sum to more than ``capacity``. An item of size 0
    (null or empty text) needs no room: it has one row with piece 0, size 0 and a
    null container. ``counts`` is (key, n_tokens), one row an item.
    """
    p = materialize(pieces(counts, capacity, key))
    histogram = {r["size"]: r.n for r in p.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int]]] = {}  # by length: (the first number a pattern takes, copies a container, first container)
    used: dict[int, int] = {}
    container = 0
    for pattern, times in plan(histogram, capacity):
        for n, k in pattern.items():
            runs.setdefault(n, []).append((used.get(n, 0), k, container))
            used[n] = used.get(n, 0) + k * times
        container += times

    table = {n: np.array(r, np.int64).T for n, r in runs.items()}

    @F.pandas_udf("long")
    def place(size: pd.Series, number: pd.Series) -> pd.Series:
        s, x = size.to_numpy(), number.to_numpy()
        out = np.empty(len(s), np.int64)
        for n in np.unique(s):
            at = np.nonzero(s == n)[0]
            first, k, base = table[int(n)]
            i = np.searchsorted(first, x[at], side="right") - 1
            out[at] = base[i] + (x[at] - first[i]) // k[i]
        return pd.Series(out)

    parts = max(64, -(-sum(histogram.values()) // rows_a_part))
    packed = numbered(p, "size", [key, "piece"], parts).select(key, "piece", "size", place("size", "number").alias("container"))
    empty = counts.where("n_tokens = 0").select(key, F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("container"))
    return packed.unionByName(empty)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack` over the texts of ``documents``, measured in tokens."""
    return pack(materialize(count_tokens(documents, folder=folder, vocabulary=vocabulary)), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the least containers possible, and the share of room unused."""
    s = packed.where("container is not null").agg(F.max("container").alias("last"), F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"))
    n = F.coalesce(F.col("last") + 1, F.lit(0))
    return s.select(n.alias("containers"), "pieces", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.ceil(F.coalesce("tokens", F.lit(0)) / capacity).cast("long").alias("least"), F.when(n > 0, 1 - F.col("tokens") / (n * capacity)).alias("unused"))
