"""Connected components by minimum propagation over a shrinking graph.

Every round points each vertex at the smallest vertex among itself and its
neighbours, follows the pointers a few steps, and contracts the edges onto the
vertices pointed at. Pointers only ever lead to smaller ids, so the last root of
a component is its smallest id and chains of any length vanish in a logarithmic
number of rounds; plain propagation would need as many rounds as the longest
chain has links. What is left when at most ``TAIL`` edges remain is joined up in one
task, whose input that number bounds: rounds over so little only cost their start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fernglass.runtime import materialize, release

MAX_ROUNDS = 64
TAIL = 100_000


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every proper edge, without repeats; null ends link nothing."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    return e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v").distinct()


def _jump(p: DataFrame) -> DataFrame:
    """One pointer-jumping step; ``p`` has one row per vertex."""
    q = p.select(F.col("u").alias("root"), F.col("root").alias("next"))
    return p.join(q, "root", "left").select("u", F.coalesce("next", "root").alias("root"))


def _joined_up(edges: DataFrame) -> DataFrame:
    """(u, root): every vertex of the few (u, v) with the smallest of its component, in one task."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(u, u)
                up.setdefault(v, v)
                x, y = top(u), top(v)
                up[max(x, y)] = min(x, y)
        us = list(up)
        yield pa.RecordBatch.from_pydict({"u": us, "root": [top(u) for u in us]}, schema=batch_schema)

    batch_schema = pa.schema([("u", to_arrow_type(kind)), ("root", to_arrow_type(kind))])
    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"u {kind.simpleString()}, root {kind.simpleString()}")


def min_propagation(edges: DataFrame, a: str = "a", b: str = "b", both_ways: bool = False, tail: int = TAIL) -> DataFrame:
    """(id, component): every end of a proper edge with the smallest id it is linked to.

    Null ends and loops link nothing and add no row; an empty input gives an
    empty result. The edges are shuffled by both ends in every round, but their
    number falls geometrically; a vertex with very many edges is split by AQE,
    since the other side of that join has one row a vertex. ``both_ways`` says that
    the edges are those of :func:`symmetric` already.
    """
    e = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")) if both_ways else symmetric(edges, a, b))
    levels: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        left = e.limit(tail + 1).count()
        if not left:
            break
        if left <= tail:
            levels.append(materialize(_joined_up(e)))
            break
        p = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root"))
        p = materialize(_jump(_jump(materialize(p))))
        levels.append(p)
        pv = p.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        nxt = materialize(e.join(p, "u").join(pv, "v").where("root <> rv").select(F.col("root").alias("u"), F.col("rv").alias("v")).distinct())
        release(e)
        e = nxt
    else:
        raise RuntimeError("components did not converge")
    if not levels:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = levels[-1]
    for p in reversed(levels[:-1]):
        q = out.select(F.col("u").alias("root"), F.col("root").alias("top"))
        out = p.join(q, "root", "left").select("u", F.coalesce("top", "root").alias("root"))
    return out.select(F.col("u").alias("id"), F.col("root").alias("component"))
