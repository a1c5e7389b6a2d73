"""Exact and near duplicates of passages, and the questions that refer to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.params import NEAR_DUPLICATE, SHINGLE
from fernglass.plans.components import min_propagation
from fernglass.runtime import materialize


def exact_duplicates(passages: DataFrame, digest: Column | None = None, key: str = "passage_id") -> DataFrame:
    """(removed, kept): every passage whose text an earlier id has, with the smallest such id.

    Texts are compared by ``digest``, by default that of their normal form.
    Empty texts equal each other; null texts equal nothing.
    """
    x = passages.where(F.col("text").isNotNull()).select(F.col(key).alias("id"), (digest if digest is not None else T.text_hash(F.col("text"))).alias("h")).distinct()
    least = x.groupBy("h").agg(F.min("id").alias("kept"))
    return x.join(least, "h").where("id <> kept").select(F.col("id").alias("removed"), "kept")


def near_pairs(texts: DataFrame, threshold: float = NEAR_DUPLICATE, size: int = SHINGLE) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of (id, text) rows whose runs of words reach ``threshold``; exact.

    Runs are ordered from rare to common. Two texts that reach the threshold share
    one of their first ``n - ceil(threshold * n) + 1`` runs, so only those are
    joined, and only for sizes within the threshold of each other; common runs
    stand last and are hardly ever among them. Pairs are verified on the runs
    themselves, not on hashes of them. Texts of the same set of runs are joined
    through one of them. Empty texts match nothing.
    """
    sets = texts.select("id", F.sort_array(T.shingles(F.col("text"), size)).alias("runs")).where(F.size("runs") > 0)
    sets = materialize(sets.withColumn("form", F.sha2(F.concat_ws("\x1f", "runs"), 256)))
    reps = materialize(sets.groupBy("form").agg(F.min("id").alias("id"), F.first("runs").alias("runs")))
    occ = reps.select("id", F.size("runs").alias("n"), F.explode("runs").alias("run")).withColumn("h", F.xxhash64("run"))
    df = occ.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a run that one text has can join nothing, yet it takes a place in the order
    ranked = occ.join(df, "h").select("id", "n", "h", "df")
    shared = F.count(F.lit(1)).over(Window.partitionBy("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    first = materialize(ranked.withColumn("single", F.col("n") - shared).withColumn("place", place).where(F.col("single") + F.col("place") <= prefix).select("id", "n", "h"))
    a = first.select(F.col("id").alias("a"), F.col("n").alias("na"), "h")
    b = first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h")
    near = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    c = a.join(b, "h").where(F.col("a") < F.col("b")).where(near).select("a", "b").distinct()
    r = reps.select("id", "runs")
    v = c.join(r.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(r.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    v = v.select("a", "b", T.jaccard(F.col("ra"), F.col("rb")).alias("jaccard")).where(F.col("jaccard") >= threshold)
    same = sets.join(reps.select("form", F.col("id").alias("rep")), "form").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return v.unionByName(same)


def dedupe(passages: DataFrame, threshold: float = NEAR_DUPLICATE, size: int = SHINGLE, digest: Column | None = None) -> DataFrame:
    """(removed_id, kept_id, kind, jaccard): one row for every passage removed.

    Exact duplicates go first, the smallest id stays; then near duplicates among
    the survivors, joined into components whose smallest id stays. ``kept_id`` is
    always a survivor of both; ``jaccard`` is against the component's root and may
    lie below the threshold in a chain. One row a passage id is expected.
    """
    exact = materialize(exact_duplicates(passages, digest))
    left = passages.join(exact.select(F.col("removed").alias("passage_id")), "passage_id", "left_anti").where("text is not null").select(F.col("passage_id").alias("id"), "text")
    comp = materialize(min_propagation(near_pairs(left, threshold, size), "a", "b").where("id <> component"))
    # only the texts that stand in a component are cut into runs again
    touched = comp.select(F.explode(F.array("id", "component")).alias("id")).distinct()
    runs = materialize(left.join(touched, "id", "left_semi").select("id", T.shingles(F.col("text"), size).alias("runs")))
    near = comp.join(runs, "id").join(runs.select(F.col("id").alias("component"), F.col("runs").alias("root")), "component")
    near = near.select(F.col("id").alias("removed_id"), F.col("component").alias("kept_id"), F.lit("near").alias("kind"), F.round(T.jaccard(F.col("runs"), F.col("root")), 4).alias("jaccard"))
    root = comp.select(F.col("id").alias("kept"), F.col("component").alias("top"))
    moved = exact.join(root, "kept", "left").select(F.col("removed").alias("removed_id"), F.coalesce("top", "kept").alias("kept_id"), F.lit("exact").alias("kind"), F.lit(1.0).alias("jaccard"))
    return moved.unionByName(near)


def remap(questions: DataFrame, replacements: DataFrame, kept: DataFrame) -> DataFrame:
    """(question_id, status, passage_ids): questions after their passages were deduplicated.

    ``questions`` is (question_id, passage_ids), ``replacements`` (removed_id,
    kept_id) with one row a removed id, ``kept`` (passage_id). An id that is
    neither kept nor replaced drops the question (``dropped_missing``), which is
    tested before fewer than two distinct ids being left (``dropped_collapsed``);
    else it is ``remapped`` if an id changed and ``unchanged`` if none did. Ids
    keep their order; dropped questions have null ids. A question without ids is
    collapsed.
    """
    x = questions.select("question_id", "passage_ids", F.posexplode_outer("passage_ids").alias("k", "id"))
    k = kept.select(F.col("passage_id").alias("id"), F.lit(True).alias("alive")).distinct()
    r = replacements.select(F.col("removed_id").alias("id"), F.col("kept_id").alias("to"))
    x = x.join(k, "id", "left").join(r, "id", "left").withColumn("now", F.when(F.col("alive"), F.col("id")).otherwise(F.col("to")))
    per = x.groupBy("question_id").agg(
        F.coalesce(F.bool_or(F.col("k").isNotNull() & F.col("now").isNull()), F.lit(False)).alias("missing"),
        F.coalesce(F.bool_or(F.col("now") != F.col("id")), F.lit(False)).alias("changed"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("k", "now"))), lambda e: e["now"])).alias("ids"),
    )
    n = F.size(F.filter("ids", lambda i: i.isNotNull()))
    status = F.when(F.col("missing"), "dropped_missing").when(n < 2, "dropped_collapsed").when(F.col("changed"), "remapped").otherwise("unchanged")
    return per.withColumn("status", status).select("question_id", "status", F.when(~F.col("status").startswith("dropped"), F.col("ids")).alias("passage_ids"))


def dangling(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """(question_id, passage_id): ids that no kept passage has; must be empty before a corpus is frozen."""
    x = questions.select("question_id", F.explode("passage_ids").alias("passage_id")).where("passage_id is not null")
    return x.join(kept.select("passage_id"), "passage_id", "left_anti").select("question_id", "passage_id")
