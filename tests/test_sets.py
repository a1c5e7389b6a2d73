"""Query sets, extraction and training pairs."""

import pytest
from pyspark.sql import functions as F

from fernglass import schemas
from fernglass.operators import extract as X
from fernglass.operators import queryset as Q
from fernglass.operators import training_pairs as P


def corpus(spark):
    rows = [("p1", "First", "The band Alpha Beta recorded 1984 songs in London Town."), ("p2", "Second", "Gamma Delta and Alpha Beta met in 1985."), ("p3", None, None)]
    return spark.createDataFrame(rows, "passage_id string, title string, text string")


def labeled(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.LABELED_QUERY)


GOOD = (("pp", "utterly different wording", "paraphrase", {"p1": 1}, "agent-drafted", None), ("mh", "which two", "multi-hop-relational", {"p1": 1, "p2": 1}, "hotpotqa", "s1"))


def test_valid_set(spark):
    assert Q.problems(labeled(spark, *GOOD), corpus(spark)).collect() == []


@pytest.mark.parametrize(
    ("row", "problem"),
    [
        (("x", "t", "odd", {"p1": 1}, "hotpotqa", None), "unknown category"),
        (("x", " ", "paraphrase", {"p1": 1}, "agent-drafted", None), "empty text"),
        (("x", None, "paraphrase", {"p1": 1}, "agent-drafted", None), "empty text"),
        (("x", "zzz", "exact-term", None, "agent-drafted", None), "no relevant passages"),
        (("x", "zzz", "exact-term", {"p1": 2}, "agent-drafted", None), "gain is not 1"),
        (("x", "zzz", "exact-term", {"p9": 1}, "agent-drafted", None), "passage not in the corpus: p9"),
        (("x", "zzz", "exact-term", {"p1": 1}, "hotpotqa", None), "wrong origin"),
        (("x", "zzz", "multi-hop-relational", {"p1": 1, "p2": 1}, "hotpotqa", None), "no source question"),
        (("x", "zzz", "multi-hop-relational", {"p1": 1}, "hotpotqa", "s"), "fewer than two passages"),
        (("x", "zzz", "exact-term", {"p1": 1, "p2": 1}, "agent-drafted", None), "not exactly one passage"),
        (("pp", "zzz", "paraphrase", {"p1": 1}, "agent-drafted", None), "repeated query id"),
        (("x", "the bands recorded", "paraphrase", {"p1": 1}, "agent-drafted", None), "shares content words without an override"),
    ],
)
def test_broken_sets(spark, row, problem):
    assert problem in {r.problem for r in Q.problems(labeled(spark, *GOOD, row), corpus(spark)).collect()}


def test_reviews(spark):
    over = ("r", "t", "why", ["band", "record"])
    q = labeled(spark, ("pp", "the bands recorded", "paraphrase", {"p1": 1}, "agent-drafted", None), ("no", "zzz", "exact-term", {"p1": 1}, "agent-drafted", None))
    rec = lambda *a: spark.createDataFrame(list(a), schemas.REVIEW)
    ok = ("pp", "p1", "draft", "the bands recorded", "me", "now", "accepted", "", over)
    got = {tuple(r) for r in Q.problems(q, corpus(spark), rec(ok)).collect()}
    assert got == {("no", "no review record")}
    bad = ("pp", "p9", " ", "other", "", "now", "edited", " ", ("r", "t", "why", ["band"]))
    got = {r.problem for r in Q.problems(q, corpus(spark), rec(bad, ("ghost", "p1", "d", "f", "m", "n", "accepted", "", None))).collect()}
    assert {"disposition without a reason", "no reviewer or time", "no draft text", "final text differs", "source passage not in the corpus", "override lists other words", "review of no such query"} <= got


def test_balance(spark):
    got = {r.problem for r in Q.problems(labeled(spark, *GOOD), corpus(spark), per_category=1, locked_size=3).collect()}
    assert got == {"category count: exact-term", "size differs from the locked one"}


def test_builders(spark):
    c = corpus(spark)
    e = Q.exact_term_queries(c, limit=5)
    got = {r.query_id: (list(r.relevant), r.text) for r in e.collect()}
    assert set(got) == {"et-p1", "et-p2"} and "London Town" in got["et-p1"][1]
    q = spark.createDataFrame([("b", "B?", ["p1", "p2"]), ("a", "A?", ["p1", "p1"]), ("c", "C?", None), ("b", "B?", ["p1", "p2"])], "question_id string, text string, passage_ids array<string>")
    assert [r.query_id for r in Q.multi_hop_queries(q).collect()] == ["mh-b"]
    assert {r.passage_id for r in Q.paraphrase_sample(c, labeled(spark, GOOD[0])).collect()} == {"p2", "p3"}
    assert {r.term: r.n for r in Q.occurrences(spark.createDataFrame([("Alpha",), ("Zeta",)], "term string"), c).collect()} == {"Alpha": 2, "Zeta": 0}
    assert Q.exact_term_queries(c.limit(0)).collect() == []


def sentence(spark, *tokens, sid=0):
    """Tokens as (text, lemma, pos, tag, dep, head)."""
    return spark.createDataFrame([("p", sid, i, *t[:5], t[5]) for i, t in enumerate(tokens)], schemas.TOKEN)


V = lambda w, lemma: (w, lemma, "VERB", "VBD", "ROOT")


def found(spark, df):
    return sorted((r.subject_text, r.relation, r.object_text, r.pattern) for r in X.relations(df).collect())


def test_active_with_conjuncts(spark):
    s = sentence(
        spark,
        ("The", "the", "DET", "DT", "det", 1),
        ("director", "director", "NOUN", "NN", "nsubj", 4),
        ("and", "and", "CCONJ", "CC", "cc", 1),
        ("Cross", "Cross", "PROPN", "NNP", "conj", 1),
        (*V("wrote", "write"), 4),
        ("films", "film", "NOUN", "NNS", "dobj", 4),
        (".", ".", "PUNCT", ".", "punct", 4),
    )
    assert found(spark, s) == [("Cross", "write", "films", "active_svo"), ("director", "write", "films", "active_svo")]


def test_passive_copular_and_preposition(spark):
    passive = sentence(spark, ("Film", "film", "NOUN", "NN", "nsubjpass", 1), (*V("made", "make"), 1), ("by", "by", "ADP", "IN", "agent", 1), ("Scott", "Scott", "PROPN", "NNP", "pobj", 2))
    assert found(spark, passive) == [("Scott", "make", "Film", "passive")]
    copular = sentence(spark, ("Ed", "Ed", "PROPN", "NNP", "nsubj", 1), ("is", "be", "AUX", "VBZ", "ROOT", 1), ("a", "a", "DET", "DT", "det", 3), ("film", "film", "NOUN", "NN", "attr", 1))
    assert found(spark, copular) == [("Ed", "be", "film", "copular")]
    prep = sentence(spark, ("With", "with", "ADP", "IN", "prep", 3), ("care", "care", "NOUN", "NN", "pobj", 0), ("Kamen", "Kamen", "PROPN", "NNP", "nsubj", 3), (*V("worked", "work"), 3))
    assert found(spark, prep) == [("Kamen", "work with", "care", "prep_object")]


def test_silent_sentences(spark):
    ask = sentence(spark, ("Who", "who", "PRON", "NN", "nsubj", 1), (*V("directed", "direct"), 1), ("Sinister", "Sinister", "PROPN", "NNP", "dobj", 1), ("?", "?", "PUNCT", ".", "punct", 1))
    assert found(spark, ask) == []
    wh = sentence(spark, ("which", "which", "PRON", "WDT", "nsubj", 1), (*V("aired", "air"), 1), ("ABC", "ABC", "PROPN", "NNP", "dobj", 1))
    assert found(spark, wh) == []
    assert X.relations(ask.limit(0)).collect() == []


def test_types_and_matches(spark):
    raw = spark.createDataFrame([(1, "p", 0, "director Mike Nichols", "Sony Corp")], "raw_id int, passage_id string, sentence_index int, subject_text string, object_text string")
    ents = spark.createDataFrame([("p", 0, "Mike Nichols", "PERSON", 0, 5), ("p", 0, "Sony", "ORG", 9, 12), ("p", 0, "Sony Corp", "COMPANY", 9, 17)], schemas.ENTITY)
    r = X.attach_types(raw, ents).first()
    assert (r.subject_type, r.object_type) == ("PERSON", "COMPANY")
    t = "passage_id string, sentence_index int, subject string, relation string, object string, pos int"
    gold = spark.createDataFrame([("p", 0, "Mike", "be", "x", 0), ("p", 0, "Nichols", "be", "x", 1), ("p", 1, None, "be", "x", 0)], t)
    got = spark.createDataFrame([("p", 0, "Mike Nichols", "BE", "X", 0), ("p", 7, "q", "be", "x", 0)], t)
    q = X.quality(X.greedy_matches(gold, got)).first()
    assert (q.n_gold, q.n_extracted, q.n_correct) == (3, 1, 1) and q.precision == 1.0


QP = "question_id string, question string, gold array<struct<passage_id:string,title:string,text:string>>, distractors array<struct<passage_id:string,title:string,text:string>>, source string"


def questions(spark):
    g = lambda i, t: (i, "T", t)
    return spark.createDataFrame(
        [
            ("ev", "E?", [g("e1", "eval gold")], [g("e2", "eval distractor")], ""),
            ("ok", "O?", [g("o1", "fine"), ("o2", None, "fine too")], [g("o3", "also")], ""),
            ("ok", "O?", [g("o1", "fine"), ("o2", None, "fine too")], [g("o3", "also")], ""),
            ("id", "I?", [g("i1", "new")], [g("e2", "other")], ""),
            ("tx", "T?", [g("t1", "Eval  GOLD")], None, ""),
            ("no", "N?", None, [g("n1", "x")], ""),
        ],
        QP,
    )


def test_pool(spark):
    lq = labeled(spark, ("mh", "which", "multi-hop-relational", {"p1": 1}, "hotpotqa", "ev"))
    got = {r.question_id: r.status for r in P.training_pool(lq, questions(spark), corpus(spark)).collect()}
    assert got == {"ev": "evaluation", "ok": "kept", "id": "id overlap", "tx": "text overlap", "no": "no gold"}
    with pytest.raises(P.LeakageError):
        P.training_pool(labeled(spark, ("m", "w", "multi-hop-relational", {"p9": 1}, "hotpotqa", "gone")), questions(spark), corpus(spark), strict=True)
    chosen = P.training_questions(P.training_pool(lq, questions(spark), corpus(spark)))
    P.assert_no_leakage(chosen, lq, questions(spark), corpus(spark))
    with pytest.raises(P.LeakageError):
        P.assert_no_leakage(spark.createDataFrame([("id",)], "question_id string"), lq, questions(spark), corpus(spark))


def test_pairs(spark):
    got = {r.guid: (r.passage, r.label) for r in P.build_pairs(questions(spark)).where("query = 'O?'").collect()}
    assert got == {"ok:pos:0": ("T: fine", 1), "ok:pos:1": ("fine too", 1), "ok:neg:0": ("T: also", 0)}
    r = P.pair_report(P.build_pairs(questions(spark))).first()
    assert (r.n_pos, r.n_neg) == (5, 4) and r.majority == pytest.approx(5 / 9)


def test_split(spark):
    rows = [(f"x:y{i}:{s}:{k}", f"q{i}", f"passage {i} {k}" if k else "shared", k) for i in range(20) for s in ("pos", "neg") for k in range(2)]
    pairs = spark.createDataFrame(rows, "guid string, query string, passage string, label int")
    out = P.split_pairs(pairs, 0.1).collect()
    of = {}
    for r in out:
        of.setdefault(r.guid.rsplit(":", 2)[0], set()).add(r.split)
    assert sum("train" in v for v in of.values()) == 18 and len(out) == len(rows)
    assert all(v == {"train"} or v == {"dev", "dropped"} for v in of.values())
    assert P.split_pairs(pairs.limit(0)).collect() == []


def test_scorer(spark):
    rows = [(f"q{i}:pos:0", f"alpha{i} beta", f"T: alpha{i} beta gamma", 1) for i in range(20)] + [(f"q{i}:neg:0", f"alpha{i} beta", "T: unrelated words", 0) for i in range(20)]
    pairs = spark.createDataFrame(rows, "guid string, query string, passage string, label int")
    s = P.linear_scorer(P.train_scorer(pairs))
    got = pairs.select("label", s(F.col("query"), F.col("passage")).alias("p")).groupBy("label").agg(F.avg("p").alias("p")).collect()
    p = {r.label: r.p for r in got}
    assert p[1] > 0.7 > 0.3 > p[0]
