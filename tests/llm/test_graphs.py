"""Problems 5 and 7."""

import random

import pytest

from fernglass.llm import match_groups as M
from fernglass.llm import question_splits as S


def smallest(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ends = [x for x in (a, b) if x]
        for x in ends:
            find(x)
        if len(ends) == 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


REMOVAL = "run_id int, removed_id string, kept_id string, jaccard double, passage_id string, group_id string, u string"


@pytest.mark.parametrize("rounds", [1, 12])
def test_groups_against_union_find(spark, rows, rounds):
    rng = random.Random(5)
    hub = [("hub", f"h{i}") for i in range(60)]
    tail = [(f"h{i}", f"t{i}") for i in range(10)] + [(f"t{i}", f"s{i}") for i in range(10)]
    chain = [f"c{rng.randrange(10**6)}" for _ in range(40)]
    pairs = hub + tail + list(zip(chain, chain[1:], strict=False)) + [(f"x{rng.randrange(60)}", f"x{rng.randrange(60)}") for _ in range(40)]
    pairs += [("a", "a"), ("lonely", None), (None, "left"), (None, None), ("e", ""), ("", "f"), ("hub", "h1"), ("h1", "hub")]
    rng.shuffle(pairs)
    r = spark.createDataFrame([(1, a, b, float("nan"), "", "", "") for a, b in pairs[::2]], REMOVAL)
    p = spark.createDataFrame(pairs[1::2], "removed_id string, kept_id string")
    assert dict(rows(M.group_ids(M.match_edges(r, p), rounds=rounds))) == smallest(pairs)


def test_groups_of_nothing(spark):
    e = spark.createDataFrame([], "removed_id string, kept_id string")
    assert M.group_ids(M.match_edges(e, e)).collect() == []
    only = spark.createDataFrame([("a", None), ("b", "b")], "removed_id string, kept_id string")
    assert sorted(map(tuple, M.group_ids(M.match_edges(only, e)).collect())) == [("a", "a"), ("b", "b")]


QP = "question_id string, gold array<struct<passage_id:string,title:string,text:string>>, distractors array<struct<passage_id:string,title:string,text:string>>, u string, seed string"


def qp(spark, data):
    s = lambda ids: None if ids is None else [(i, None, None) for i in ids]
    return spark.createDataFrame([(q, s(g), s(d), "", "") for q, g, d in data], QP)


def test_question_groups(spark, rows):
    data = [("q2", ["P1"], ["p9"]), ("q1", [" p1 "], None), ("2hop:a", ["p3", None, ""], ["P9"]), ("q4", ["", None], []), ("q5", None, None), (None, ["p1"], None), ("q1", [" p1 "], None)]
    pairs = spark.createDataFrame([("q4:pos:0", ""), ("cmp:z:neg:12", ""), ("odd", ""), (None, ""), ("q4:pos:0", "")], "guid string, group_id string")
    got = dict(rows(S.question_groups(qp(spark, data), pairs)))
    assert got == {"q2": "2hop:a", "q1": "2hop:a", "2hop:a": "2hop:a", "q4": "q4", "q5": "q5", "cmp:z": "cmp:z"}


@pytest.mark.parametrize("one_in", [1, 4, 1000])
def test_linked_groups_against_union_find(spark, rows, one_in):
    rng = random.Random(2)
    links = [(f"q{rng.randrange(120):03d}", f"p{rng.randrange(110)}") for _ in range(150)] + [(f"c{i:03d}", f"k{j}") for i in range(50) for j in (i, i + 1)]
    want = {k[1:]: v[1:] for k, v in smallest([("a" + q, "b" + p) for q, p in links]).items() if k[0] == "a"}
    df = spark.createDataFrame(links, "question_id string, passage_id string")
    assert dict(rows(S.linked_groups(df, seed_one_in=one_in))) == want


def test_splits(spark):
    data = [(f"q{i:04d}", f"q{i - i % 4:04d}") for i in range(2000)] + [(f"z{i:04d}", "zz") for i in range(300)]
    out = S.assign_splits(spark.createDataFrame(data, "question_id string, group_id string")).collect()
    by, n = {}, {}
    for r in out:
        by.setdefault(r.group_id, set()).add(r.split)
        n[r.split] = n.get(r.split, 0) + 1
    assert len(out) == 2300 and all(len(v) == 1 for v in by.values())
    assert abs(n["train"] / 2300 - 0.8) < 0.15 and set(n) == {"train", "validation", "test"}
    assert S.assign_splits(spark.createDataFrame([], "question_id string, group_id string")).collect() == []
    assert S.question_groups(qp(spark, []), spark.createDataFrame([], "guid string")).collect() == []
