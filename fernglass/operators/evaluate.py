"""Metrics per query, their means per category, intervals and comparisons."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.params import BOOTSTRAP_SEED, CATEGORIES, CONFIDENCE, GRAPH_WIN_DEPTH, LEAST_PAIRS, P50_LIMIT, P95_LIMIT, RESAMPLES, WARM_UP, Z_95
from fernglass.runtime import if_small, materialize

METRICS = ("recall@5", "recall@10", "ndcg@10", "mrr")


def qrels(labeled: DataFrame) -> DataFrame:
    """(query_id, category, passage_id, gain): one row a judgment; queries without any have one with nulls."""
    return labeled.select("query_id", "category", F.explode_outer("relevant").alias("passage_id", "gain"))


def query_scores(labeled: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, category, metric, value) for recall at each k, nDCG at the largest, and MRR over the hits given.

    Recall is the share of a query's judged passages within rank k, 1 for a query
    without any; nDCG discounts the stored gains by log2(rank + 1) and divides by
    the ideal for gains of 1 (1 without judgments); MRR is the inverse of the
    first judged hit's rank, 0 without one. A query is expected once in ``labeled``.
    """
    top = max(ks)
    j = qrels(labeled).join(hits.select("query_id", "passage_id", "rank"), ["query_id", "passage_id"], "left")
    n = F.count("passage_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(top)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    dcg = F.coalesce(F.sum(F.when(F.col("rank") <= top, F.col("gain") / F.log2(F.col("rank") + F.lit(1.0)))), F.lit(0.0))
    per = j.groupBy("query_id", "category").agg(n.alias("n"), dcg.alias("dcg"), F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"in{k}") for k in ks])
    cols = {f"recall@{k}": F.when(F.col("n") == 0, 1.0).otherwise(F.col(f"in{k}") / F.col("n")) for k in ks}
    cols |= {f"ndcg@{top}": F.when(F.col("n") == 0, 1.0).otherwise(F.col("dcg") / F.when(F.col("n") > 0, ideal)), "mrr": F.coalesce(1 / F.col("first"), F.lit(0.0))}
    return per.select("query_id", "category", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in cols.items()])).alias("m")).select("query_id", "category", "m.metric", "m.value")


def mean_scores(scores: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(category, metric, mean, n): by category and ``pooled``; a category without queries has NaN and 0."""
    sets = scores.groupingSets([["category", "metric"], ["metric"]], "category", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.grouping("category").alias("g"))
    got = sets.select(F.when(F.col("g") == 1, "pooled").otherwise(F.col("category")).alias("category"), "metric", "mean", "n")
    spark = scores.sparkSession
    want = spark.createDataFrame([(c,) for c in (*categories, "pooled")], "category string").join(scores.select("metric").distinct())
    out = want.join(got, ["category", "metric"], "full")
    return out.select("category", "metric", F.coalesce("mean", F.lit(float("nan"))).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


# --- comparisons -------------------------------------------------------------


class PairingError(ValueError):
    """Two systems weren't scored on the same queries, or on too few, or not by numbers."""


def paired(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("category", "metric")) -> DataFrame:
    """(keys, query_id, a, b): both scores of every query; a query that one side lacks fails the query."""
    on = [*keys, "query_id"]
    x = a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), on, "full")
    sure = lambda c: F.coalesce(c, F.raise_error(F.concat(F.lit("not scored by both: "), F.col("query_id"))).cast("double")).alias(c)
    return x.select(*on, sure("a"), sure("b"))


def bootstrap_interval(diffs: np.ndarray, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED, confidence: float = CONFIDENCE) -> tuple[float, float, float]:
    """(mean, low, high) of paired differences in the order of their query ids, resampled by numpy's generator."""
    if len(diffs) < LEAST_PAIRS:
        raise PairingError(f"{len(diffs)} pairs; {LEAST_PAIRS} are needed")
    if not np.isfinite(diffs).all():
        raise PairingError("a score isn't finite")
    rng = np.random.default_rng(seed)
    means = diffs[rng.integers(0, len(diffs), (resamples, len(diffs)))].mean(axis=1)
    tail = (1 - confidence) / 2 * 100
    low, high = np.percentile(means, [tail, 100 - tail])
    return float(diffs.mean()), float(low), float(high)


def derived_seed(seed: int, category: str, metric: str) -> int:
    """A seed of its own for every comparison."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{category}:{metric}".encode()).digest()[:4], "big")


def paired_bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """(category, metric, diff, ci_low, ci_high, excludes_zero, n): the same intervals as numpy gives, one group of the query set at a time."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        mean, low, high = bootstrap_interval((pdf.a - pdf.b).to_numpy(), resamples, derived_seed(seed, *key), confidence)
        return pd.DataFrame([(*key, mean, low, high, low > 0 or high < 0, len(pdf))])

    return pairs.groupBy("category", "metric").applyInPandas(run, "category string, metric string, diff double, ci_low double, ci_high double, excludes_zero boolean, n long")


def hashed_bootstrap(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """As :func:`paired_bootstrap`, with indices drawn by md5 of seed, resample and position, so that any engine draws the same.

    Nothing is gathered: queries are numbered, draws exploded and joined, and means
    and percentiles aggregated. Groups of as many queries share their draws, which
    become very many after they were few and are therefore never broadcast.
    """
    keys = ["category", "metric"]
    w = Window.partitionBy(*keys).orderBy("query_id")
    x = materialize(pairs.withColumn("i", F.row_number().over(w) - 1).withColumn("d", F.col("a") - F.col("b")).select(*keys, "i", "d"))
    n = materialize(x.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.avg("d").alias("diff")))
    draw = n.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    # a few rows become very many: spread over all cores before they do
    draw = draw.repartition(pairs.sparkSession.sparkContext.defaultParallelism, "n", "r").select("n", "r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("p").cast("string"))), 1, 8), 16, 10).cast("long")
    draw = draw.select("n", "r", (h % F.col("n")).cast("int").alias("i")).hint("merge")
    drawn = if_small(x.join(F.broadcast(n.select(*keys, "n")), keys).select(*keys, "n", "i", F.round("d", 12).cast("decimal(28,12)").alias("d")))  # n: a row a group
    means = draw.join(drawn, ["n", "i"]).groupBy(*keys, "r").agg((F.sum("d") / F.count(F.lit(1))).cast("double").alias("m"))
    tail = (1 - confidence) / 2
    ci = means.groupBy(*keys).agg(F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1 - tail)).alias("ci_high"))
    return n.join(ci, keys).select(*keys, "diff", "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("excludes_zero"), F.col("n").cast("long").alias("n"))


def pick_baseline(means: DataFrame, metric: str = "ndcg@10", candidates: tuple[str, ...] = ("bm25", "dense")) -> DataFrame:
    """(category, config): the better of the candidates by their mean of (config, category, metric, mean); a tie goes to the first named."""
    order = F.array_position(F.array(*map(F.lit, candidates)), F.col("config"))
    x = means.where(F.col("config").isin(*candidates) & (F.col("metric") == metric))
    return x.groupBy("category").agg(F.max_by("config", F.struct("mean", -order)).alias("config"))


def compare_to_baseline(scores: dict[str, DataFrame], configs: tuple[str, ...], resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(config, baseline, category, metric, diff, ci_low, ci_high, excludes_zero, n): each configuration against each category's better baseline.

    ``scores`` has (query_id, category, metric, value) of every configuration and of
    the candidates of :func:`pick_baseline`. All queries together are the category
    ``pooled``. Categories of fewer than two queries have no interval and no row.
    """
    pooled = lambda s: s.unionByName(s.withColumn("category", F.lit("pooled")))
    every = {n: pooled(s.where("category is not null")) for n, s in scores.items()}
    means = [mean_scores(scores[n]).where("n > 0").withColumn("config", F.lit(n)) for n in ("bm25", "dense")]
    best = pick_baseline(means[0].unionByName(means[1])).withColumnRenamed("config", "baseline")
    base = reduce(DataFrame.unionByName, [every[n].withColumn("baseline", F.lit(n)) for n in ("bm25", "dense")]).join(F.broadcast(best), ["category", "baseline"])  # a row a category
    base = materialize(base)
    out = []
    for name in configs:
        pairs = materialize(paired(every[name], base.drop("baseline")))
        enough = pairs.groupBy("category", "metric").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAIRS).select("category", "metric")
        out.append(paired_bootstrap(pairs.join(F.broadcast(enough), ["category", "metric"]), resamples, seed).withColumn("config", F.lit(name)))
    x = reduce(DataFrame.unionByName, out).join(best, "category")
    return x.select("config", "baseline", "category", "metric", "diff", "ci_low", "ci_high", "excludes_zero", "n")


def before_and_after(before: DataFrame, after: DataFrame, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(category, metric, before, after, diff, ci_low, ci_high, excludes_zero, n) of one configuration's scores before and after a change."""
    pooled = lambda s: s.unionByName(s.withColumn("category", F.lit("pooled")))
    pairs = materialize(paired(pooled(after), pooled(before)))
    mean = pairs.groupBy("category", "metric").agg(F.avg("b").alias("before"), F.avg("a").alias("after"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= LEAST_PAIRS).drop("m")
    ci = paired_bootstrap(pairs.join(F.broadcast(mean.select("category", "metric")), ["category", "metric"]), resamples, seed)
    return mean.join(ci, ["category", "metric"]).select("category", "metric", "before", "after", "diff", "ci_low", "ci_high", "excludes_zero", "n")


# --- graph wins ----------------------------------------------------------------


def graph_wins(labeled: DataFrame, dense_hits: DataFrame, fused_hits: DataFrame, depth: int = GRAPH_WIN_DEPTH) -> DataFrame:
    """(query_id, passage_id, dense_rank, fused_rank, graph_provenance, graph_win, verdict) of every judged passage of a multi-hop query.

    A win is a passage that fusion ranks within ``depth`` with a share of the
    graph, and dense search doesn't.
    """
    j = qrels(labeled.where("category = 'multi-hop-relational'")).where("passage_id is not null").select("query_id", "passage_id")
    d = dense_hits.where(F.col("rank") <= depth).select("query_id", "passage_id", F.col("rank").alias("dense_rank"))
    f = fused_hits.where(F.col("rank") <= depth).select("query_id", "passage_id", F.col("rank").alias("fused_rank"), F.col("prov_graph").alias("g"))
    x = j.join(d, ["query_id", "passage_id"], "left").join(f, ["query_id", "passage_id"], "left")
    g, fr, dr = F.coalesce("g", F.lit(0.0)), F.col("fused_rank").isNotNull(), F.col("dense_rank").isNotNull()
    win = fr & (g > 0) & ~dr
    verdict = F.when(win, "graph-win").when(dr, "dense-wins").when(fr, "fused-only (no graph)").otherwise("neither")
    return x.select("query_id", "passage_id", "dense_rank", "fused_rank", g.alias("graph_provenance"), win.alias("graph_win"), verdict.alias("verdict"))


def win_rate(wins: DataFrame) -> DataFrame:
    """(n_queries, n_wins, rate): queries with a win; the rate of no queries is NaN."""
    per = wins.groupBy("query_id").agg(F.bool_or("graph_win").alias("w"))
    n = F.count(F.lit(1))
    return per.agg(n.alias("n_queries"), F.count_if("w").alias("n_wins"), F.when(n > 0, F.count_if("w") / n).otherwise(float("nan")).alias("rate"))


def link_failure(queries: DataFrame, links: DataFrame) -> DataFrame:
    """(n_queries, n_unlinked, rate): queries without a linked name; the rate of no queries is NaN."""
    q = queries.select("query_id").distinct().join(links.select("query_id", F.lit(1).alias("l")).distinct(), "query_id", "left")
    n, u = F.count(F.lit(1)), F.count_if(F.col("l").isNull())
    return q.agg(n.alias("n_queries"), u.alias("n_unlinked"), F.when(n > 0, u / n).otherwise(float("nan")).alias("rate"))


# --- intervals and percentiles -----------------------------------------------------


def z_score(confidence: float) -> float:
    """The two-sided normal quantile, by bisection on the error function."""
    if confidence == 0.95:
        return Z_95
    low, high = 0.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < confidence else (low, mid)
    return (low + high) / 2


def wilson(successes: Column, n: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column, Column]:
    """(point, low, high) of a share; NaN without trials."""
    z = z_score(confidence)
    p = successes / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    nan = F.lit(float("nan"))
    guard = lambda c: F.when(n > 0, c).otherwise(nan)
    return guard(p), guard(F.greatest(F.lit(0.0), mid - half)), guard(F.least(F.lit(1.0), mid + half))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95), buckets: int = 1024) -> DataFrame:
    """(keys, percent, value): the element at index ``round(p / 100 * n) - 1`` (half to even) of each group's sorted values; nulls are left out.

    No group is sorted whole. Values are first counted in ``buckets`` equal ranges
    a group; the running counts tell which range holds the wanted place, and only
    that range's values are counted one by one.
    """
    x = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    lim = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    b = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(buckets - 1))).otherwise(0)
    y = x.join(F.broadcast(lim), keys) if not keys else x.join(lim, keys)
    y = y.withColumn("b", b)
    run = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = y.groupBy(*keys, "b", "n").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(run))
    place = F.greatest(F.least(F.bround(F.col("p") / 100 * F.col("n")).cast("long") - 1, F.col("n") - 1), F.lit(0))
    want = per.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("at", place)
    want = want.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("m"))).select(*keys, "b", F.col("p").alias("percent"), (F.col("at") - F.col("upto") + F.col("m")).alias("at"))
    vals = y.join(want.select(*keys, "b").distinct(), [*keys, "b"], "left_semi").groupBy(*keys, "b", "v").agg(F.count(F.lit(1)).alias("c"))
    inner = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vals = vals.withColumn("c_upto", F.sum("c").over(inner))
    hit = want.join(vals, [*keys, "b"]).where((F.col("at") < F.col("c_upto")) & (F.col("at") >= F.col("c_upto") - F.col("c")))
    return hit.select(*keys, "percent", F.col("v").alias("value"))


def latency(run: Callable[[str], object], texts: list[str], warm_up: int = WARM_UP) -> dict:
    """Sequential wall-clock times of ``run``: percentiles by nearest rank, throughput, and whether the limits hold.

    The first ``warm_up`` queries aren't counted; there must be more than those.
    """
    if len(texts) <= warm_up:
        raise ValueError(f"{len(texts)} queries; more than {warm_up} are needed")
    for t in texts[:warm_up]:
        run(t)
    times = []
    began = time.perf_counter()
    for t in texts[warm_up:]:
        s = time.perf_counter()
        run(t)
        times.append(time.perf_counter() - s)
    total = time.perf_counter() - began
    times.sort()
    at = lambda p: times[min(max(round(p / 100 * len(times)) - 1, 0), len(times) - 1)]
    p50, p95 = at(50), at(95)
    return {"n": len(times), "p50": p50, "p95": p95, "throughput": len(times) / total, "within_limits": p50 < P50_LIMIT and p95 < P95_LIMIT}


def swap_counts() -> tuple[int, int] | None:
    """(pages swapped in, out) since the machine started, where the system tells."""
    try:
        with open("/proc/vmstat", encoding="ascii") as f:
            got = dict(line.split() for line in f)
        return int(got["pswpin"]), int(got["pswpout"])
    except (OSError, KeyError, ValueError):
        return None


def markdown(df: DataFrame, formats: dict[str, str] | None = None) -> str:
    """A small table as markdown, columns formatted by ``formats``."""
    formats = formats or {}
    rows = df.collect()
    show = lambda c, v: "n/a" if v is None or v != v else format(v, formats[c]) if c in formats else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(c, r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def stub_hits(spark: SparkSession, queries: DataFrame, k: int = 10) -> DataFrame:
    """Hits of pseudo passages by digest, to exercise the evaluation without an index."""
    h = F.sha2(F.concat_ws("\x00", "query_id", F.col("rank").cast("string")), 256)
    x = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return x.select("query_id", F.substring(h, 1, 16).alias("passage_id"), (1.0 / F.col("rank")).alias("score"), "rank")
