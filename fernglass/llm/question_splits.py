"""Problem 7: train, validation and test splits that keep linked questions together.

Questions and the passages they name form a graph. Its components are found by
frontier breadth-first search from many seeds at once: adjacency lists are
hash-partitioned by vertex, a hashed fraction of the vertices are seeds, and all
frontiers advance together for a few steps. Where two searches meet, their seeds
are linked in a small graph of seeds, whose components join the searches up.
Vertices that no search reached are their own seeds in that graph. Splits are
then dealt over the components in the order of their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.plans.components import min_propagation
from fernglass.runtime import materialize, release

SEED_ONE_IN = 12
STEPS = 3
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
HASH_BUCKETS = 4096


def question_ids(question_passages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(question_id): of question_passages, and of guids (``<question id>:pos|neg:<number>``; the id may hold colons)."""
    of_guid = F.regexp_extract("guid", r"(?s)^(.*):(?:pos|neg):[0-9]+$", 1)
    fits = F.col("guid").rlike(r"(?s)^.*:(?:pos|neg):[0-9]+$")
    named = pairs.where(fits).select(of_guid.alias("question_id"))
    return question_passages.select("question_id").where("question_id is not null").unionByName(named).distinct()


def question_links(question_passages: DataFrame) -> DataFrame:
    """(question_id, passage_id): ids of passages in lower case without surrounding blanks; null and empty ids link nothing."""
    both = F.concat(F.coalesce("gold", F.array()), F.coalesce("distractors", F.array()))
    ids = F.transform(both, lambda p: F.lower(F.regexp_replace(p["passage_id"], r"(?U)^\s+|\s+$", "")))
    x = question_passages.where("question_id is not null").select("question_id", F.explode(ids).alias("passage_id"))
    return x.where("passage_id is not null and passage_id <> ''").distinct()


def linked_groups(links: DataFrame, left: str = "question_id", right: str = "passage_id", steps: int = STEPS, seed_one_in: int = SEED_ONE_IN) -> DataFrame:
    """(left, group): components of a bipartite graph, the group named by its smallest ``left``."""
    q, p = F.concat(F.lit("q"), F.col(left)), F.concat(F.lit("p"), F.col(right))
    adj = materialize(links.select(F.explode(F.array(F.struct(q.alias("u"), p.alias("v")), F.struct(p.alias("u"), q.alias("v")))).alias("e")).select("e.u", "e.v").distinct())
    vertices = adj.select("u").distinct()
    label = materialize(vertices.where(F.pmod(F.xxhash64("u"), F.lit(seed_one_in)) == 0).select("u", F.col("u").alias("seed")))
    frontier = label
    for _ in range(steps):
        nxt = adj.join(frontier, "u").groupBy("v").agg(F.min("seed").alias("seed")).select(F.col("v").alias("u"), "seed").join(label, "u", "left_anti")
        nxt = materialize(nxt)
        grown = materialize(label.unionByName(nxt))
        if label is not frontier:
            release(label)
        label, frontier = grown, nxt
    every = materialize(vertices.join(label, "u", "left").select("u", F.coalesce("seed", "u").alias("seed")))
    other = every.select(F.col("u").alias("v"), F.col("seed").alias("seed_v"))
    meet = adj.where("u < v").join(every, "u").join(other, "v").where("seed <> seed_v").select(F.least("seed", "seed_v").alias("a"), F.greatest("seed", "seed_v").alias("b")).distinct()
    seeds = materialize(min_propagation(meet, "a", "b"))
    comp = every.where(F.col("u").startswith("q")).join(seeds.withColumnRenamed("id", "seed"), "seed", "left").select(F.expr("substring(u, 2)").alias(left), F.coalesce("component", "seed").alias("component"))
    comp = materialize(comp)
    # one row a component against many: the large side may be uneven, AQE splits it
    least = comp.groupBy("component").agg(F.min(left).alias("group_id"))
    return comp.join(least, "component").select(left, "group_id")


def question_groups(question_passages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(question_id, group_id): every question with the smallest question it may not be separated from.

    A question without passages, or known from a guid only, is alone in its
    group. A null question id gets no row; a guid of another form names no
    question. Null lists, null members and repeated rows change nothing.
    """
    groups = linked_groups(question_links(question_passages))
    every = question_ids(question_passages, pairs)
    return every.join(groups, "question_id", "left").select("question_id", F.coalesce("group_id", "question_id").alias("group_id"))


def assign_splits(groups: DataFrame, proportions: dict[str, float] | None = None, buckets: int = HASH_BUCKETS) -> DataFrame:
    """(question_id, group_id, split): whole groups dealt in the order of a hash of their id.

    The running share of questions decides a group's split: it belongs where the
    middle of its own questions falls. The running sum is taken over at most
    ``buckets`` rows (sums per range of hashes) and then within each range, so no
    task orders all groups. Proportions need not sum to one; they are scaled.
    """
    proportions = proportions or PROPORTIONS
    whole = sum(proportions.values())
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.xxhash64("group_id"), F.lit(1 << 40))
    sizes = sizes.withColumn("h", h).withColumn("bucket", (h / ((1 << 40) // buckets)).cast("int"))
    per = sizes.groupBy("bucket").agg(F.sum("n").alias("m"))
    before = per.withColumn("before", F.sum("m").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))  # at most ``buckets`` rows
    total = per.agg(F.sum("m").alias("total"))
    inner = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1))
    at = sizes.withColumn("inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(before.select("bucket", F.coalesce("before", F.lit(0)).alias("before"))), "bucket").join(F.broadcast(total))
    share = (F.col("before") + F.col("inner") + F.col("n") / 2) / F.col("total")
    split, edge = None, 0.0
    names = list(proportions)
    for name in names[:-1]:
        edge += proportions[name] / whole
        split = F.when(share < edge, name) if split is None else split.when(share < edge, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return groups.join(at.select("group_id", split.alias("split")), "group_id").select("question_id", "group_id", "split")
