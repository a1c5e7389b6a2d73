"""From texts that share a key to pairs that may be alike, however many texts share it.

Keys come from fingerprints (:mod:`near_duplicates`, :mod:`split_overlap`). A key of
few texts is joined as it is. The texts of hot keys are divided by their rarest
runs, which loses nothing: with the runs of every text in one order from rare to
common, two texts that reach the threshold share a run among the first
``n - ceil(threshold * n) + 1`` of each. Boilerplate stands last in that order and
brings nobody together. A run that is still hot (a passage copied again and again
with edits) has its texts cut into blocks, and pairs of blocks are compared one by
one, each pair of texts only at the first such run that both have.

Nothing is dropped, capped or sampled at any size of a key, and no task holds more
than two blocks of one key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.llm.shingles import jaccard
from fernglass.runtime import if_small, is_empty, materialize, release

PAIRS = 2_000_000  # pairs a key may make before it is divided; up to there comparing codes costs less than ordering runs
BLOCK = 1_000  # texts of one key that a task compares with as many others

RunsOf = Callable[[DataFrame], DataFrame]  # (side, id) to (side, id, runs)


@dataclass(frozen=True)
class Bound:
    """Which pairs may reach ``threshold``, by what every text carries: its size and a bit code of ``longs`` columns p0, p1, ...

    Sizes must be within the threshold of each other. The code's bits are parities
    (see :func:`parities`): two codes differ in no more bits than there are runs that
    only one of two texts has, so the Hamming radius never rules out a pair that
    reaches the threshold.
    """

    threshold: float
    longs: int

    @property
    def codes(self) -> list[str]:
        return [f"p{i}" for i in range(self.longs)]

    @property
    def columns(self) -> list[str]:
        return ["size", *self.codes]

    def _near(self, m, n, apart):
        radius = (m + n) * ((1 - self.threshold) / (1 + self.threshold)) + 1e-6
        return (m >= self.threshold * n - 1e-9) & (n >= self.threshold * m - 1e-9) & (apart <= radius)

    def holds(self) -> Column:
        """For columns prefixed x and y."""
        apart = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in self.codes), F.lit(0))
        return self._near(F.col("xsize"), F.col("ysize"), apart)

    def table(self, left: pa.Table, right: pa.Table) -> np.ndarray:
        """The same for every row of ``left`` against every row of ``right``."""
        apart = np.zeros((left.num_rows, right.num_rows), np.int16)
        for c in self.codes:
            x, y = (t.column(c).to_numpy().view(np.uint64) for t in (left, right))
            apart += np.bitwise_count(x[:, None] ^ y[None, :])
        return self._near(left.column("size").to_numpy()[:, None], right.column("size").to_numpy()[None, :], apart)


def parities(v: np.ndarray, offsets: np.ndarray, longs: int) -> list[np.ndarray]:
    """``longs`` columns: for each of ``64 * longs`` bits whether an odd number of a text's runs falls on it."""
    n = np.diff(offsets)
    at = np.repeat(np.arange(len(n)), n) * longs + ((v >> np.uint64(6)) % np.uint64(longs)).astype(np.int64)
    bits = np.zeros(len(n) * longs, np.uint64)
    np.bitwise_xor.at(bits, at, np.uint64(1) << (v & np.uint64(63)))
    return [np.ascontiguousarray(c) for c in bits.view(np.int64).reshape(len(n), longs).T]


def once(prints: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``; only rows whose keys repeat are shuffled whole."""
    n = materialize(prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    if is_empty(n):
        return prints
    rest = [F.first(c).alias(c) for c in prints.columns if c not in keys]
    n = if_small(n)
    several = materialize(prints.join(n, keys, "left_semi").groupBy(*keys).agg(*rest).select(*prints.columns))
    return prints.join(n, keys, "left_anti").unionByName(several)


def _with_partners(rows: DataFrame, cross: bool) -> DataFrame:
    """(side, id, key, na, nb, pairs): the rows of keys that make a pair, with the key's texts on either side.

    Keys are counted by an aggregation, which combines before it shuffles, and the
    counts are joined back; a hot key is then the uneven side of a join. Across
    sides, only the keys that both have are counted.
    """
    if not cross:
        n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("nb")).where("nb > 1")
        out = rows.select("id", "key").join(n, "key").select(F.lit(False).alias("side"), "id", "key", F.lit(0).cast("long").alias("na"), "nb", F.expr("nb * (nb - 1) div 2").alias("pairs"))
        return materialize(out)
    a, b = rows.where("side").select("key", "id"), rows.where("not side").select("key", "id")
    b = materialize(b.join(a.select("key").distinct(), "key", "left_semi"))
    nb = b.groupBy("key").agg(F.count(F.lit(1)).alias("nb"))
    a = materialize(a.join(nb, "key"))
    na = a.groupBy("key").agg(F.count(F.lit(1)).alias("na"), F.first("nb").alias("nb"))
    both = a.select(F.lit(True).alias("side"), "id", "key").unionByName(b.select(F.lit(False).alias("side"), "id", "key"))
    out = materialize(both.join(na, "key").select("side", "id", "key", "na", "nb", (F.col("na") * F.col("nb")).alias("pairs")))
    release(a, b)
    return out


def _paired(rows: DataFrame, sides: DataFrame, bound: Bound, cross: bool) -> DataFrame:
    both = rows.select("side", "id", "key").join(sides.select("side", "id", *bound.columns), ["side", "id"])
    of = lambda s, p: (both.where(F.col("side") == s) if cross else both).select("key", *(F.col(c).alias(p + c) for c in ("id", *bound.columns)))
    x = of(True, "x").join(of(False, "y"), "key").where(bound.holds())
    return (x if cross else x.where("xid < yid")).select(F.col("xid").alias("a"), F.col("yid").alias("b"))


def rarest_runs(runs: DataFrame, threshold: float, cross: bool) -> DataFrame:
    """(side, id, key): those runs of each (side, id, runs) that it must share one of with whatever it is alike to.

    The order is by the number of texts that have a run; runs that no other text
    (for ``cross``, no text of the other side) has come first and are left out.
    """
    each = runs.select("side", "id", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    df = each.groupBy("run").agg(F.count(F.lit(1)).alias("df"), F.count_if("side").alias("da"))
    df = df.where("da > 0 and da < df" if cross else "df > 1").select("run", "df")
    order = Window.partitionBy("side", "id").orderBy("df", "run")  # one text's runs
    x = each.join(df, "run").select("side", "id", "n", "run", F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("side", "id")).alias("shared"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    return x.where(F.col("n") - F.col("shared") + F.col("place") <= prefix).select("side", "id", F.col("run").alias("key"))


def _by_blocks(rows: DataFrame, sides: DataFrame, bound: Bound, cross: bool, block: int) -> DataFrame:
    """Pairs (a, b) of the rows of hot keys, each only at the least key that both texts have here."""
    keys = rows.groupBy("side", "id").agg(F.sort_array(F.collect_list("key")).alias("held"))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / block).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side"), parts("na")).otherwise(parts("nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side"), parts("nb")).otherwise(parts("na") if cross else parts("nb")) - 1))
    x = rows.join(keys, ["side", "id"]).join(sides.select("side", "id", *bound.columns), ["side", "id"])
    x = x.select("key", "side", "id", "held", *bound.columns, mine.alias("part"), other.alias("with"))
    i, j = (F.when(F.col("side"), F.col("part")).otherwise(F.col("with")), F.when(F.col("side"), F.col("with")).otherwise(F.col("part"))) if cross else (F.least("part", "with"), F.greatest("part", "with"))
    x = x.withColumn("i", i).withColumn("j", j)

    def earlier(t: pa.Table, key: int) -> tuple[np.ndarray, np.ndarray]:
        lists = t.column("held").combine_chunks()
        v = np.asarray(lists.flatten())
        owner = np.repeat(np.arange(t.num_rows), np.diff(np.asarray(lists.offsets)))
        before = v < key
        return v[before], owner[before]

    def compare(group: tuple, t: pa.Table) -> pa.Table:
        key, i, j = (g.as_py() for g in group)
        part = t.column("side").to_numpy(zero_copy_only=False) if cross else t.column("part").to_numpy() == i
        left = t.filter(pa.array(part))
        right = t.filter(pa.array(~part)) if cross or i != j else left
        (lv, lo), (rv, ro) = earlier(left, key), earlier(right, key)
        common = np.intersect1d(lv, rv)
        met = np.zeros((left.num_rows, right.num_rows), bool)
        if len(common):
            m = []
            for v, o, n in ((lv, lo, left.num_rows), (rv, ro, right.num_rows)):
                at = np.minimum(np.searchsorted(common, v), len(common) - 1)
                ok = common[at] == v
                m.append(np.zeros((n, len(common)), np.float32))
                m[-1][o[ok], at[ok]] = 1
            met = m[0] @ m[1].T > 0
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        good = ~met & bound.table(left, right)
        if not cross and i == j:
            good &= a[:, None] < b[None, :]
        p, q = np.nonzero(good)
        a, b = a[p], b[q]
        if not cross:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"a": a, "b": b})

    return x.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def colliding(keyed: DataFrame, sides: DataFrame, runs_of: RunsOf, threshold: float, bound: Bound, cross: bool, pairs: int = PAIRS, block: int = BLOCK) -> DataFrame:
    """(a, b) without repeats: texts that share a key and whose codes are within ``bound``.

    ``keyed`` is (side, id, key), ``sides`` (side, id) with the bound's columns,
    one row a text. For ``cross``, a is on side true and b on side false; else there is
    one side, false, and a < b. Of texts that meet in hot keys only, pairs that
    certainly stay below ``threshold`` may be left out.
    """
    rows = _with_partners(keyed, cross)
    found = _paired(rows.where(F.col("pairs") <= pairs), sides, bound, cross)
    hot = rows.where(F.col("pairs") > pairs)
    if hot.take(1):
        runs = materialize(runs_of(materialize(hot.select("side", "id").distinct())))
        rare = materialize(rarest_runs(runs, threshold, cross))
        release(runs)
        divided = _with_partners(rare, cross)
        release(rare)
        found = found.unionByName(_paired(divided.where(F.col("pairs") <= pairs), sides, bound, cross))
        still = divided.where(F.col("pairs") > pairs)
        if still.take(1):
            found = found.unionByName(_by_blocks(still, sides, bound, cross, block))
        found = materialize(found.distinct())
        release(divided)
    else:
        found = materialize(found.distinct())
    release(rows)
    return found


def verified(pairs: DataFrame, runs_of: RunsOf, threshold: float, cross: bool) -> DataFrame:
    """(a, b, jaccard): those of ``pairs`` whose runs reach ``threshold``."""
    end = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))
    ends = pairs.select(F.explode(F.array(end(cross, "a"), end(False, "b"))).alias("e")).select("e.side", "e.id").distinct()
    runs = materialize(runs_of(materialize(ends)))
    a = runs.where(F.col("side") == cross).select(F.col("id").alias("a"), F.col("runs").alias("ra"))
    b = runs.where("not side").select(F.col("id").alias("b"), F.col("runs").alias("rb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("ra"), F.col("rb")).alias("jaccard")).where(F.col("jaccard") >= threshold)
