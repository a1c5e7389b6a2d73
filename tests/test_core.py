"""Components, salted aggregation and hot names."""

import random

import pytest
from pyspark.sql import functions as F

from fernglass.operators import hot_keys
from fernglass.operators.salted import heavy_keys, salted, salted_aggregate
from fernglass.plans.components import min_propagation

TRIPLE = "subject string, relation string, object string, batch int, extracted_at timestamp, role string, name string, _salt int"


def smallest(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(("seed", "tail"), [(1, 0), (2, 20), (2, 100_000)])
def test_components_of_random_graphs(spark, rows, seed, tail):
    rng = random.Random(seed)
    ids = [f"{rng.randrange(16**6):06x}" for _ in range(150)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)]
    chain = [f"c{rng.randrange(16**6):06x}" for _ in range(60)]
    pairs += list(zip(chain, chain[1:], strict=False)) + [(None, "x"), ("y", None)]
    got = dict(rows(min_propagation(spark.createDataFrame(pairs, "a string, b string"), tail=tail)))
    want = {k: v for k, v in smallest([(a, b) for a, b in pairs if a != b]).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert got == {k: v for k, v in want.items()}


def test_components_of_nothing(spark):
    assert min_propagation(spark.createDataFrame([], "a string, b string")).collect() == []


def test_salted_aggregate_equals_plain(spark, rows):
    data = [("hot", i % 7) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(400)] + [(None, 5)] * 4
    df = spark.createDataFrame(data, "k string, v int")
    got = rows(salted_aggregate(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}))
    assert got == rows(df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")))
    assert "hot" in {r.k for r in heavy_keys(df, ["k"], 0.1).collect()} and {r.k for r in heavy_keys(df, ["k"], 0.5, sample=500).collect()} == {"hot"}
    # repeated rows are spread over the salts
    same = spark.range(2000).selectExpr("'hot' AS k", "1 AS v")
    assert salted(same, ["k"], salts=8).select("_salt").distinct().count() == 8


def test_names_holding(spark, rows):
    data = [("big", "r", f"o{i}", 1, None, "x", "y", 0) for i in range(50)] + [(f"s{i}", "r", None, 2, None, None, None, None) for i in range(48)] + [(None, None, "", None, None, None, None, None)] * 2
    t = spark.createDataFrame(data, TRIPLE)
    # 2 of 100 rows reach the share, repeats counted; the empty string is a name as written
    assert rows(hot_keys.names_holding(t)) == [("object", ""), ("subject", "big")]
    assert hot_keys.names_holding(t.limit(0)).collect() == []


def test_summary_counts(spark, rows):
    t = spark.createDataFrame([("a", "r", "b", 1, None, "", "", 1), ("a", "q", "b", 3, None, "", "", 1), ("a", None, None, 2, None, "", "", 1)], TRIPLE)
    got = {(r.role, r.name): (r.n_rows, r.n_partners, r.n_relations, r.last_batch) for r in hot_keys.summarise_names(t).collect()}
    assert got == {("subject", "a"): (3, 1, 2, 3), ("object", "b"): (2, 1, 2, 3)}
    assert hot_keys.summarise_names(t.limit(0)).collect() == []
