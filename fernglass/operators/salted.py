"""Aggregation that stays even when a few keys hold most rows.

Keys that hold a good share of the rows are found first, in a bounded random
sample: which keys are taken for heavy decides how the work is divided, and never
what comes out. Their number is at most ``2 / heavy_share``, so the list may be
broadcast whatever the table's size. Rows of a heavy key get a salt and are first
aggregated per (key, salt); the partial results are then merged per key. All other
rows have the one salt 0.

The salt is a hash of the row's place in its partition, so that repeated rows are
spread, too. A task that runs again after an executor is lost must give its rows
the same salts, or rows would be counted twice or not at all; reading the same split
of a table again gives the same places. Give frames that were shuffled to
:func:`~fernglass.runtime.materialize` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 0.002
SALTS = 64
SAMPLE = 200_000  # rows among which heavy keys are sought


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """The keys that hold more than about half of ``share`` of a sample of about ``sample`` rows; at most ``2 / share`` rows."""
    total = df.count()
    taken = df.select(*keys) if total <= sample else df.select(*keys).sample(sample / total, seed)
    per = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.where(F.col("_n") > F.lit(min(total, sample) * share / 2)).select(*keys)


def salted(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE, salts: int = SALTS) -> DataFrame:
    """``df`` with ``_salt``: 0 for ordinary keys, a hash of the row's place modulo ``salts`` for heavy ones."""
    heavy = heavy_keys(df, keys, share).withColumn("_heavy", F.lit(True))
    joined = df.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(heavy), keys, "left")
    salt = F.pmod(F.xxhash64("_place"), F.lit(salts)).cast("int")
    return joined.withColumn("_salt", F.when(F.col("_heavy"), salt).otherwise(F.lit(0))).drop("_heavy", "_place")


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Two-stage aggregation: ``partial`` per (key, salt), ``merge`` over those per key.

    ``merge`` refers to the columns named in ``partial``. Null keys form a group
    of their own here, as in ``groupBy``; a join finds no null key heavy, so
    callers that expect many nulls filter them first. An empty table gives an
    empty result.
    """
    s = salted(df, keys, share, salts)
    one = s.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return one.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
