"""Problem 5: pairwise matches consolidated into groups.

The giant component is peeled first: starting from the vertex of highest degree,
a frontier grows by breadth-first joins against the edges. What it reached is
anti-joined away, so that the hub, whose edges may be a third of all rows, is in
no later join. The small components that remain are labelled by minimum
propagation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.plans.components import min_propagation, symmetric
from fernglass.runtime import if_small, materialize

BFS_ROUNDS = 12


def match_edges(removals: DataFrame, replacements: DataFrame) -> DataFrame:
    """(a, b) of every row of both tables, ids cleaned: an empty id is null."""
    both = removals.select("removed_id", "kept_id").unionByName(replacements.select("removed_id", "kept_id"))
    clean = lambda c: F.when(F.col(c) != "", F.col(c))
    return both.select(clean("removed_id").alias("a"), clean("kept_id").alias("b"))


def peel(edges: DataFrame, rounds: int = BFS_ROUNDS) -> tuple[DataFrame | None, str | None]:
    """(ids reached from the vertex of highest degree, their smallest id).

    ``edges`` are symmetric (u, v). The search ends when the frontier is empty.
    If it isn't after ``rounds`` steps (a component that is one long chain), what
    was reached is still one piece of one component; :func:`group_ids` then keeps
    it in the graph as a single vertex, and minimum propagation does the rest.
    """
    top = edges.groupBy("u").agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d"), "u").limit(1).collect()
    if not top:
        return None, None
    spark = edges.sparkSession
    frontier = seen = materialize(spark.createDataFrame([(top[0].u,)], "u string"))
    for _ in range(rounds):
        # each level is written once; what was seen is all levels together
        frontier = materialize(edges.join(if_small(frontier), "u", "left_semi").select(F.col("v").alias("u")).distinct().join(if_small(seen), "u", "left_anti"))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    least = seen.agg(F.min("u").alias("m")).collect()[0].m
    return seen, least


def group_ids(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = BFS_ROUNDS) -> DataFrame:
    """(passage_id, group_id): every id of ``pairs`` with the smallest id of its group.

    Null ids link nothing and get no row; a row that names one id twice, or one
    id and a null, still gives that id a row, alone if nothing else links it.
    Repeated and reversed pairs change nothing; an empty table gives no row.
    """
    ids = pairs.select(F.explode(F.array(a, b)).alias("passage_id")).where("passage_id is not null").distinct()
    edges = materialize(symmetric(pairs, a, b))
    giant, least = peel(edges, rounds)
    if giant is None:
        return ids.select("passage_id", F.col("passage_id").alias("group_id"))
    member = giant.select(F.col("u").alias("id"))
    outside = edges.join(if_small(member.select(F.col("id").alias("u"))), "u", "left_anti")
    inside_v = if_small(member.select(F.col("id").alias("v")))
    # edges that leave what was reached exist only where the search was cut short; they now leave one vertex
    border = outside.join(inside_v, "v", "left_semi").select("u", F.lit(least).alias("v")).distinct()
    border = materialize(border)
    rest = outside.join(inside_v, "v", "left_anti")
    if border.take(1):
        small = min_propagation(rest.unionByName(border), "u", "v")
    else:
        small = min_propagation(outside, "u", "v", both_ways=True)
    small = materialize(small)
    whole = small.where(F.col("id") == F.lit(least)).select("component").collect()  # at most one row
    label = min(whole[0].component, least) if whole else least
    known = small.where(F.col("id") != F.lit(least)).select("id", "component").unionByName(member.select("id", F.lit(label).alias("component")))
    return ids.join(known.withColumnRenamed("id", "passage_id"), "passage_id", "left").select("passage_id", F.coalesce("component", "passage_id").alias("group_id"))
