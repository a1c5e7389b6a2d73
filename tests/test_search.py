"""Indexes, retrieval and evaluation."""

import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglass.operators import evaluate as E
from fernglass.operators import index as I
from fernglass.operators import retrieve as R

HITS = "query_id string, passage_id string, score double, rank int"


def hits(spark, **lists):
    return spark.createDataFrame([(q, p, float(10 - i), i + 1) for q, ps in lists.items() for i, p in enumerate(ps)], HITS)


def test_fusion(spark):
    f = R.fuse(hits(spark, q=["d1", "d2"]), hits(spark, q=["d2", "d3"]), hits(spark, q=["d1"]))
    got = {r.passage_id: (r.score, r.rank, r.prov_bm25, r.prov_graph) for r in f.collect()}
    assert got["d1"][:2] == (2 / 61, 1) and got["d2"][:2] == (1 / 62 + 1 / 61, 2) and got["d3"][:2] == (1 / 62, 3)
    assert got["d1"][2:] == (10.0, 10.0) and got["d3"][2:] == (0.0, 0.0)
    assert R.contract_problems(f, 10).collect() == []
    assert set(R.provenance(f).first().provenance) == {"bm25", "dense", "graph"}


def test_contract_breaks(spark):
    bad = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "", 2.0, 3)], HITS)
    assert {r.problem for r in R.contract_problems(bad, 2).collect()} == {"ranks aren't 1..n", "more than k hits", "scores rise", "empty id"}


def corpus(spark):
    rows = [("p1", "Sinister", "a film by Scott Derrickson"), ("p2", None, "Ed Wood is a film film film"), ("p3", "Other", "nothing to see"), ("p4", "", None)]
    return spark.createDataFrame(rows, "passage_id string, title string, text string")


def test_bm25_against_formula(spark):
    c = corpus(spark)
    q = spark.createDataFrame([("q", "Film film Sinister"), ("blank", "  "), ("null", None)], "query_id string, text string")
    got = {r.passage_id: r.score for r in R.bm25(q, c).collect()}
    docs = {"p1": 5, "p2": 7, "p3": 3}
    avg = sum(docs.values()) / 3
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    text = lambda tf, dl: 2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    title = math.log(1 + (2 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 1))
    assert got["p2"] == pytest.approx(text(3, 7), abs=1e-6)
    assert got["p1"] == pytest.approx(max(text(1, 5), title), abs=1e-6)
    assert set(got) == {"p1", "p2"}
    assert R.bm25(q, c.limit(0)).collect() == []


def test_bm25_of_many_queries_joins_no_postings(spark, rows, tmp_path, monkeypatch):
    r = random.Random(7)
    words = ["the", "of", "film", "é", *(f"w{i}" for i in range(40))]
    some = lambda n: " ".join(r.choice(words[: r.choice((3, 44))]) for _ in range(r.randrange(n)))
    texts = [(some(4), some(30)) for _ in range(150)]
    c = spark.createDataFrame([(f"p{i:03d}", *texts[i // 2]) for i in range(300)] + [("none", None, None)], "passage_id string, title string, text string")
    q = spark.createDataFrame([(f"q{i}", some(8)) for i in range(60)] + [("all", "the of the"), ("gone", "zzz"), ("blank", " "), ("long", " ".join(["the"] * 300))], "query_id string, text string")
    store = I.SearchStore(spark, str(tmp_path))
    store.build(c, spark.createDataFrame([("a", "b", "r", "p000", 0)], "subject string, object string, relation string, passage_id string, sentence_index int"))
    distinct = {(f, t, i) for i, x in enumerate(texts) for f in (0, 1) for t in x[f].split()}
    assert store.health().first()["count"] == 2 * len(distinct)
    assert store.table("postings").count() < 2 * len(distinct)
    want = {k: rows(R.search_store("bm25", q, store, k)) for k in (3, 100)}
    assert len(want[3]) > 150 and want[100] == rows(R.bm25(q, c))
    monkeypatch.setattr(R, "JOINED", 0)
    for block in (7, 2048):
        monkeypatch.setattr(R, "PASSAGE_BLOCK", block)
        monkeypatch.setattr(R, "QUERY_BLOCK", 11 * block)
        monkeypatch.setattr(R, "QUERIES_A_SCAN", 40)
        got = R.search_store("bm25", q, store, 3)
        assert rows(got) == want[3]
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(R.bm25(q, c)) == want[100]
    assert R.search_store("bm25", q.limit(0), store, 3).collect() == []


def test_weights_are_rounded_as_by_spark(spark):
    w = [0.0, 4e-10, 5e-10, 0.1234567885, 1.0000000005, 2.5000000015, 17.123456789499999, 0.0000000025]
    want = [int(r[0].scaleb(9)) for r in spark.createDataFrame([(x,) for x in w], "w double").select(F.round("w", 9).cast("decimal(28,9)")).collect()]
    assert np.floor(R._whole(np.array(w))).astype(int).tolist() == want


def test_dense_is_exact(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)] + [(999, None), (1000, m[0].tolist())], "id long, embedding array<double>")
    q = v.where("id in (0, 7)").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.passage_id for r in R.dense(q, v, 5, "id").collect()}
    for k in (0, 7):
        s = np.append(m @ m[k], m[0] @ m[k])
        order = sorted(range(301), key=lambda i: (-round(s[i], 9), i))[:5]
        assert [got[k, j + 1] for j in range(5)] == [1000 if i == 300 else i for i in order]
    assert R.dense(q.limit(0), v, 5, "id").collect() == []


def test_links(spark, rows):
    names = spark.createDataFrame([("Scott Derrickson",), ("Sinister",), ("Ed Wood",), ("SINISTER",), ("x",), (None,)], "name string")
    q = spark.createDataFrame([("q", "Did Scott  Derrickson direct sinister?"), ("n", "Edwood"), ("z", None)], "query_id string, text string")
    assert rows(R.entity_links(q, names)) == [("q", "SINISTER"), ("q", "Scott Derrickson"), ("q", "Sinister")]


def brute_graph(edges, start, cap, hub):
    adj = {}
    for s, d, r, p, i in edges:
        adj.setdefault(s, []).append((p, i, r, d))
        if s != d:
            adj.setdefault(d, []).append((p, i, r, s))
    ok = {n for n, a in adj.items() if len(a) <= hub}
    out = {}
    for s in start & ok:
        for p1, _, _, n1 in sorted(e for e in adj[s] if e[3] in ok)[:cap]:
            two = sorted(e for e in adj[n1] if e[3] in ok and e[3] != s)[:cap]
            out[p1] = out.get(p1, 0) + max(1, len(two))
            for e in two:
                out[e[0]] = out.get(e[0], 0) + 0.5
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = list({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("rs"), f"p{rng.randrange(9)}", rng.randrange(3)) for _ in range(45)})
    e = spark.createDataFrame(edges, "src string, dst string, relation string, passage_id string, sentence_index int")
    links = spark.createDataFrame([("q", "n0"), ("q", "n1"), ("q", "nowhere")], "query_id string, name string")
    got = {r.passage_id: r.score for r in R.graph(links, e, 50, 3, 9).collect()}
    assert got == brute_graph(edges, {"n0", "n1"}, 3, 9)


def test_graph_tables(spark, rows):
    t = "subject string, relation string, object string, passage_id string, sentence_index int, subject_type string, object_type string, batch int"
    data = [("a", "r", "b", "p", 0, "PERSON", None, 1), ("a", "r", "b", "p", 0, None, "ORG", 2), ("a", "s", "b", "p", 0, None, None, 1), (None, "r", "b", "p", 0, None, None, 1), ("c", "r", "c", "p", 1, None, None, 1)]
    tr = spark.createDataFrame(data, t)
    assert I.graph_edges(tr).count() == 3
    assert rows(I.graph_nodes(tr)) == [("a", "PERSON"), ("b", "ORG"), ("c", None)]
    assert rows(I.degrees(I.graph_edges(tr))) == [("a", 2), ("b", 2), ("c", 1)]


def test_rerank(spark):
    q = spark.createDataFrame([("q", "film by scott")], "query_id string, text string")
    base = hits(spark, q=["p2", "p1"])
    got = [(r.passage_id, r.score, r["rank"]) for r in R.rerank(q, base, corpus(spark), k=2).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["p1", "p2"] and got[0][1] == 1.0
    with pytest.raises(Exception, match="no passage gone"):
        R.rerank(q, hits(spark, q=["gone"]), corpus(spark)).collect()


def test_registry(spark):
    with pytest.raises(ValueError):
        R.search("nope", None, None, None)
    R.register_retriever("bm25", lambda **k: "mine")
    assert R.search("bm25", None, None, None) == "mine"
    R.unregister_retriever("bm25")


def test_stored_indexes(spark, tmp_path):
    c = spark.createDataFrame([(f"p{i:02d}", f"t{i}", f"text number {i}") for i in range(15)], "passage_id string, title string, text string")
    for kind in (I.LexicalIndex, I.VectorIndex):
        ix = kind(spark, f"{tmp_path}/{kind.name}")
        assert ix.health().first().state == "down"
        assert ix.build(c.limit(10)) == 10
        before = sorted(map(str, ix.read().collect()))
        assert ix.add(c) == 15 and ix.add(c) == 15
        assert set(before) <= set(map(str, ix.read().collect()))
        assert ix.health().first().state == "populated"
    assert I.vector_problems(I.VectorIndex(spark, f"{tmp_path}/dense").read(), "passage_id", 64).collect() == []


LABELED = "query_id string, category string, relevant map<string,int>"


def scores(spark, order, relevant, ks=(1, 2, 3)):
    q = spark.createDataFrame([("q", "paraphrase", relevant)], LABELED)
    return {r.metric: r.value for r in E.query_scores(q, hits(spark, q=order), ks).collect()}


def test_metrics(spark):
    s = scores(spark, ["b", "a", "c"], {"a": 1})
    assert (s["recall@1"], s["recall@2"], s["mrr"]) == (0, 1, 0.5) and s["ndcg@3"] == pytest.approx(1 / math.log2(3))
    s = scores(spark, ["a", "c", "b"], {"a": 1, "b": 1})
    assert s["ndcg@3"] == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert scores(spark, ["a", "b"], {"a": 1, "b": 1, "c": 1}, (2,))["ndcg@2"] == 1
    s = scores(spark, ["a"], {})
    assert (s["recall@1"], s["ndcg@3"], s["mrr"]) == (1, 1, 0)
    assert scores(spark, ["a"], None)["recall@1"] == 1


def test_means(spark):
    x = spark.createDataFrame([("a", "exact-term", "mrr", 1.0), ("b", "exact-term", "mrr", 0.0), ("c", "paraphrase", "mrr", 1.0)], "query_id string, category string, metric string, value double")
    got = {r.category: (r["mean"], r.n) for r in E.mean_scores(x).collect()}
    assert got["exact-term"] == (0.5, 2) and got["paraphrase"] == (1.0, 1) and got["pooled"][0] == pytest.approx(2 / 3)
    assert math.isnan(got["multi-hop-relational"][0]) and got["multi-hop-relational"][1] == 0


def frame(spark, values):
    return spark.createDataFrame([(f"q{i}", "pooled", "mrr", v) for i, v in enumerate(values)], "query_id string, category string, metric string, value double")


def test_hashed_bootstrap_never_sends_its_draws_around(spark):
    r = random.Random(3)
    d = {"mrr": [r.random() for _ in range(9)], "recall@5": [r.random() for _ in range(9)], "ndcg@10": [r.random() for _ in range(4)]}
    pairs = spark.createDataFrame([(f"q{i}", "pooled", m, v, 0.25) for m, x in d.items() for i, v in enumerate(x)], "query_id string, category string, metric string, a double, b double")
    got = E.hashed_bootstrap(pairs, 40)
    assert re.search(r"BroadcastHashJoin \[n#\d+, i#\d+\].*BuildRight", got._jdf.queryExecution().executedPlan().toString())
    place = lambda i, p, n: int(hashlib.md5(f"{E.BOOTSTRAP_SEED}:{i}:{p}".encode()).hexdigest()[:8], 16) % n
    for row in got.collect():
        x = np.array(d[row.metric]) - 0.25
        means = [np.mean([x[place(i, p, len(x))] for p in range(len(x))]) for i in range(40)]
        assert (row.ci_low, row.ci_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5]))) and row["diff"] == pytest.approx(x.mean()) and row.n == len(x)
    assert got.count() == 3


def test_bootstrap(spark):
    a, b = [0.1 * i for i in range(8)], [0.1 * i - 0.2 for i in range(8)]
    r = E.paired_bootstrap(E.paired(frame(spark, a), frame(spark, b))).first()
    assert r["diff"] == pytest.approx(0.2) and r.ci_low == pytest.approx(0.2) and r.ci_high == pytest.approx(0.2) and r.excludes_zero
    h = E.hashed_bootstrap(E.paired(frame(spark, a), frame(spark, a)), 50).first()
    assert (h.ci_low, h.ci_high, h.excludes_zero, h.n) == (0, 0, False, 8)
    with pytest.raises(Exception, match="not scored by both"):
        E.paired(frame(spark, a), frame(spark, b[:-1])).collect()
    with pytest.raises(E.PairingError):
        E.bootstrap_interval(np.array([1.0]))
    with pytest.raises(E.PairingError):
        E.bootstrap_interval(np.array([1.0, float("nan")]))
    assert E.derived_seed(0, "pooled", "mrr") != E.derived_seed(0, "pooled", "ndcg@10")


def test_wilson(spark):
    f = lambda k, n: spark.range(1).select(*E.wilson(F.lit(k), F.lit(n))).first()
    p, lo, hi = f(8, 20)
    assert (p, round(lo, 4), round(hi, 4)) == (0.4, 0.2188, 0.6134)
    assert all(math.isnan(x) for x in f(0, 0))
    assert f(0, 5)[1] == 0 and E.z_score(0.9) == pytest.approx(1.6448536, abs=1e-6)


def test_nearest_rank(spark):
    rng = random.Random(3)
    data = [("a", rng.choice([rng.random() * 100, 5.0])) for _ in range(501)] + [("b", 1.0), ("c", None)] + [("d", float(i)) for i in range(10)]
    got = {(r.k, r.percent): r.value for r in E.nearest_rank(spark.createDataFrame(data, "k string, v double"), ["k"], "v", (5, 50, 95), 16).collect()}
    for k in "abd":
        v = sorted(x for kk, x in data if kk == k)
        for p in (5, 50, 95):
            assert got[k, p] == v[min(max(round(p / 100 * len(v)) - 1, 0), len(v) - 1)]
    assert ("c", 50) not in got


def test_graph_wins(spark):
    q = spark.createDataFrame([("q", "multi-hop-relational", {"a": 1, "b": 1, "c": 1}), ("r", "paraphrase", {"a": 1})], LABELED)
    fused = R.fuse(hits(spark, q=["b", "z"]), hits(spark, q=["b"]), hits(spark, q=["a"]))
    w = E.graph_wins(q, hits(spark, q=["b"]), fused)
    assert {r.passage_id: r.verdict for r in w.collect()} == {"a": "graph-win", "b": "dense-wins", "c": "neither"}
    assert tuple(E.win_rate(w).first()) == (1, 1, 1.0)
    assert math.isnan(E.win_rate(w.limit(0)).first().rate)


def test_latency_and_reports(spark):
    with pytest.raises(ValueError):
        E.latency(lambda t: None, ["a"] * 10)
    r = E.latency(lambda t: None, ["a"] * 15)
    assert r["n"] == 5 and r["within_limits"]
    assert "| 0.50 |" in E.markdown(spark.createDataFrame([(0.5,)], "x double"), {"x": ".2f"})
    b = spark.createDataFrame([("bm25", "p", "ndcg@10", 0.5), ("dense", "p", "ndcg@10", 0.5)], "config string, category string, metric string, mean double")
    assert E.pick_baseline(b).first().config == "bm25"
    assert E.stub_hits(spark, spark.createDataFrame([("q",)], "query_id string"), 3).count() == 3


def test_a_build_leaves_no_shuffle_files(spark, tmp_path):
    c = spark.createDataFrame([(f"p{i}", "t", f"w{i % 7} of") for i in range(50)], "passage_id string, title string, text string").repartition(5, "passage_id")
    t = spark.createDataFrame([(f"a{i % 9}", f"b{i}", "r", f"p{i}", 0) for i in range(50)], "subject string, object string, relation string, passage_id string, sentence_index int")
    files = lambda: sum("shuffle_" in str(f) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    store, before = I.SearchStore(spark, str(tmp_path)), files()
    store.build(c, t, hub=5)
    assert files() <= before
    assert {r.node for r in store.table("links").collect()} == {f"a{i}" for i in range(5, 9)} | {f"b{i}" for i in range(50) if i % 9 > 4}


def test_comparison_searches_each_source_once(spark, monkeypatch):
    from fernglass.plans import queries as Q

    asked, search = [], R.search_store
    monkeypatch.setattr(R, "search_store", lambda name, *a, **k: asked.append(name) or search(name, *a, **k))
    got = Q.comparison_table(spark, "/root/testdata/sf0.01").collect()
    assert sorted(asked) == ["bm25", "dense", "graph"] and got


def test_dense_takes_few_passages_at_once(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(600)], "id int, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    want = [i for i in range(600) if i % 7 == 6][:3]
    for block in (2, 2048):
        monkeypatch.setattr(R, "PASSAGE_BLOCK", block)
        assert [r.passage_id for r in R.dense(q, v, 3, "id").orderBy("rank").collect()] == want


@pytest.fixture
def parts(spark, monkeypatch):
    """The parts of the index that stand after queries over tables of which nothing is stored yet, as where searches are many."""
    from fernglass.plans import queries as Q

    monkeypatch.setattr(R, "JOINED", 0)
    monkeypatch.setattr(Q, "_STORES", {})

    def run(*names):
        d = "/root/testdata/sf0.001"
        for n in names:
            assert getattr(Q, n)(spark, d).collect()
        (store,) = Q._STORES.values()
        assert all(f.suffixes[-2:] == [".zstd", ".parquet"] for f in Path(store.folder.removeprefix("file:")).rglob("*.parquet"))
        return {f.name for f in Path(store.folder.removeprefix("file:")).iterdir()}

    return run


def test_mean_metrics_store_what_they_read(parts):
    assert parts("mean_metrics") == {"texts", "terms", "fields"}


def test_query_metrics_store_what_they_read(parts):
    assert parts("query_metrics") == {"texts", "terms", "fields", "vectors"}


def test_fused_search_stores_no_postings(parts):
    assert parts("fused_search") == {"texts", "terms", "fields", "vectors", "names", "links"}


def test_parts_that_are_built_when_read(spark, rows, tmp_path, monkeypatch):
    c = spark.createDataFrame([(f"p{i:02d}", f"Name{i % 7}", f"w{i % 5} of Name{i}") for i in range(40)], "passage_id string, title string, text string")
    t = spark.createDataFrame([(f"Name{i}", f"Name{i * 3 % 40}", "r", f"p{i:02d}", 0) for i in range(40)] + [("Name1", None, "r", "p01", 0)], "subject string, object string, relation string, passage_id string, sentence_index int")
    q = spark.createDataFrame([(f"q{i}", f"w{i} of Name{i} and Name{i + 20}") for i in range(9)], "query_id string, text string")
    whole, lazy = I.SearchStore(spark, f"{tmp_path}/whole"), I.SearchStore(spark, f"{tmp_path}/lazy")
    whole.build(c, t)
    lazy.over(c, t)
    for joined, n, due in ((0, "fused-rerank", {"postings"}), (10**9, "bm25", set())):
        monkeypatch.setattr(R, "JOINED", joined)
        want = rows(R.search_store(n, q, whole))
        assert want and rows(R.search_store(n, q, lazy)) == want
        assert lazy.due == due
    assert rows(lazy.health()) == rows(whole.health())


@pytest.fixture
def searched(spark, monkeypatch):
    """Runs a query over the smallest tables; every source must be asked for every labeled query that has a text."""
    from fernglass.plans import queries as Q
    from fernglass.runtime import read

    def run(name):
        asked, search, d = [], R.search_store, "/root/testdata/sf0.001"
        monkeypatch.setattr(R, "search_store", lambda n, q, *a, **k: asked.append({r.query_id for r in q.collect()}) or search(n, q, *a, **k))
        got = getattr(Q, name)(spark, d).collect()
        every = {r.query_id for r in read(spark, d, "labeled_queries").where("text is not null").collect()}
        assert len(every) == 20 and asked and all(x == every for x in asked)
        return got

    return run


def test_baseline_choice_searches_all_labeled_queries(searched):
    searched("baseline_choice")


def test_bm25_search_searches_all_labeled_queries(searched):
    searched("bm25_search")


def test_contract_checks_searches_all_labeled_queries(searched):
    searched("contract_checks")


def test_contract_checks_broken_searches_all_labeled_queries(searched):
    searched("contract_checks_broken")


def test_fused_search_searches_all_labeled_queries(searched):
    searched("fused_search")


def test_graph_wins_searches_all_labeled_queries(searched):
    searched("graph_wins")


def test_mean_metrics_searches_all_labeled_queries(searched):
    searched("mean_metrics")


def test_query_metrics_searches_all_labeled_queries(searched):
    searched("query_metrics")


def test_reranked_search_searches_all_labeled_queries(searched):
    searched("reranked_search")


def test_tuned_search_searches_all_labeled_queries(searched):
    searched("tuned_search")


def test_comparison_table_searches_all_labeled_queries(searched):
    searched("comparison_table")


def test_dense_stores_each_of_several_scans(spark, rows, monkeypatch):
    m = np.random.default_rng(5).integers(-2, 3, (400, 4)).astype(float)
    v = spark.createDataFrame([(f"p{i:03d}", x.tolist()) for i, x in enumerate(m)], "passage_id string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i % 50}", m[i].tolist()) for i in range(60)], "query_id string, embedding array<double>")
    want = rows(R.dense(q, v, 7))
    for i in range(10, 50):
        best = sorted((-round(float(s), 9), f"p{j:03d}") for j, s in enumerate(m @ m[i]))[:7]
        assert [(-s, p) for s, p in best] == [(s, p) for x, p, s, r in sorted(want, key=lambda x: x[3]) if x == f"q{i}"]
    stored = []
    monkeypatch.setattr(R, "QUERIES_A_SCAN", 9)
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "PASSAGE_BLOCK", 3)
    monkeypatch.setattr(R, "materialize", lambda df, *a, f=R.materialize: stored.append(df) or f(df, *a))
    assert rows(R.dense(q, v, 7)) == want and len(stored) > 4
