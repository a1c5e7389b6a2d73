"""Problems 1, 3, 6."""

import random

import pytest

from fernglass.llm import near_duplicates as N
from fernglass.llm import split_overlap as O
from fernglass.llm import visual_forms as V
from fernglass.llm.lookalike import fold, words
from fernglass.llm.shingles import hashed_runs

PASSAGE = "passage_id string, title string, text string, source string, rep string, key string, runs string, n int"


def passages(spark, data):
    return spark.createDataFrame([(*d, "s", "", "", "", 1) for d in data], PASSAGE)


def runs(text):
    w = words(text)
    return set(zip(w, w[1:], w[2:], strict=False))


def alike(a, b, threshold=0.5):
    return bool(a | b) and len(a & b) / len(a | b) >= threshold


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], ["new" + str(rng.randrange(999))], [w[k], "extra"]])
    return " ".join(w)


def family(rng, n, size):
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, size))]
        out += [edited(rng, base, rng.randrange(0, max(1, len(base) // 8) + 1)) for _ in range(4)]
    return out


def test_fold():
    assert fold("Мirosanth e‍́ a b‑c Ｆｉn﻿ ﬁ Ⅳ") == "Mirosanth é a b-c Fin fi IV"
    assert fold("Féstival") == "Féstival" and fold("a  b") == "a  b" and fold("“x”–") == "“x”–"
    assert words("Rаilwaу's no_1, Ünï") == ["railway", "s", "no", "1", "ünï"]


def test_runs_stay_within_texts(spark):
    df = spark.createDataFrame([("a", "one two three four"), ("b", None), ("c", ""), ("d", "one two"), ("e", "Two, THREE four!"), ("f", "x " * 5000)], "id string, text string")
    got = {r.id: (r.words, len(r.runs), set(r.runs)) for r in hashed_runs(df, 3, ["id"]).collect()}
    assert [got[k][:2] for k in "abcdef"] == [(4, 2), (0, 0), (0, 0), (2, 0), (3, 1), (5000, 1)]
    assert got["e"][2] < got["a"][2]


@pytest.mark.parametrize("options", [{}, {"pairs": 3}, {"pairs": 3, "block": 2}])
def test_near_duplicates_against_all_pairs(spark, rows, options):
    rng = random.Random(11)
    texts = family(rng, 30, 60)
    data = [(f"p{i:03d}", None if i % 5 else "Title here", t) for i, t in enumerate(texts)]
    data += [("x1", "T", "short"), ("x2", "T", "short"), ("n1", "t", None), ("n2", "t", ""), (None, "t", texts[0]), ("p000", "Title here", texts[0].upper())]
    want = set()
    own = {}
    for p, t, x in data:
        if p and x:
            own[p] = runs((t or "") + " " + x)
    for a in own:
        for b in own:
            if a < b and alike(own[a], own[b]):
                want.add((a, b))
    got = set(rows(N.near_duplicate_pairs(passages(spark, data), **options)))
    assert got <= want and len(got) >= 0.99 * len(want) > 50


def test_copies_beyond_the_limit_are_a_star(spark, rows):
    data = [(f"p{i}", None, "one two three four five" + "!" * i) for i in range(6)] + [("q", None, "one two three four five six")]
    got = rows(N.near_duplicate_pairs(passages(spark, data), expanded=3))
    assert got == [("p0", f"p{i}") for i in range(1, 6)] + [("p0", "q")]
    assert len(N.near_duplicate_pairs(passages(spark, data)).collect()) == 21
    groups = {r.passage_id: (r.class_id, r.n_links) for r in N.near_duplicate_groups(passages(spark, data)).collect()}
    assert groups["p3"] == ("p0", 1) and groups["q"] == ("q", 1)


def all_pairs(own, threshold=0.5):
    return {(f"p{i:04d}", f"p{j:04d}") for j in range(len(own)) for i in range(j) if alike(own[i], own[j], threshold)}


@pytest.mark.parametrize("options", [{}, {"pairs": 50}, {"pairs": 50, "block": 7}])
def test_boilerplate(spark, rows, options):
    # all share a beginning, so that some keys are everybody's; two and two are alike
    texts = ["the same beginning of all these texts " + " ".join(f"u{i // 2}x{k}" for k in range(30)) + f" end{i}" for i in range(60)]
    want = all_pairs([runs(t) for t in texts])
    assert len(want) == 30
    assert set(rows(N.near_duplicate_pairs(passages(spark, [(f"p{i:04d}", None, t) for i, t in enumerate(texts)]), **options))) == want


@pytest.mark.parametrize("n", [50, 99, 100, 101, 500])
def test_families_of_edited_copies(spark, rows, n):
    rng = random.Random(n)
    base = [f"w{k}" for k in range(100)]
    texts = [edited(rng, base, rng.randrange(1, 7)) + f" own{i}" for i in range(n)]
    want = all_pairs([runs(t) for t in texts])
    got = set(rows(N.near_duplicate_pairs(passages(spark, [(f"p{i:04d}", None, t) for i, t in enumerate(texts)]))))
    assert got <= want and len(got) >= 0.99 * len(want) > n


@pytest.mark.parametrize("edits", [1, 3])
def test_hot_families_by_blocks(spark, rows, edits):
    rng = random.Random(edits)
    texts = []
    for f in range(2):
        base = [f"w{f}x{k}" for k in range(60)]
        texts += [edited(rng, base, edits) + f" own{f}x{i}" for i in range(75)]
    want = all_pairs([runs(t) for t in texts])
    p = passages(spark, [(f"p{i:04d}", None, t) for i, t in enumerate(texts)])
    for block in (20, 1000):
        got = rows(N.near_duplicate_pairs(p, pairs=100, block=block))
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    groups = {r.passage_id: r.n_links for r in N.near_duplicate_groups(p).collect()}
    assert groups["p0000"] == sum("p0000" in x for x in want)


def test_nothing(spark):
    empty = passages(spark, [])
    assert N.near_duplicate_pairs(empty).collect() == [] and N.near_duplicate_groups(empty).collect() == []
    none = passages(spark, [("a", None, None), (None, None, "x y z")])
    assert N.near_duplicate_pairs(none).collect() == []


LQ = "query_id string, text string, relevant map<string,int>, split string, source string, side boolean, rep string"
PR = "guid string, query string, passage string, source string, key string"


def test_overlaps_against_all_pairs(spark, rows):
    rng = random.Random(8)
    texts = family(rng, 25, 50)
    asked = family(rng, 25, 14)
    ps = [(f"p{i}", "T", t) for i, t in enumerate(texts[::2])] + [("p0", "T", texts[0] + "  "), ("nul", None, None)]
    lq = [(f"q{i}", a if i % 9 else None, {f"p{i}": 1, "gone": 1} if i % 4 else None, "test", None) for i, a in enumerate(asked[::2])] + [("q1", asked[2], {}, "test", "s")]
    pr = [(f"g{i}:pos:0", a if i % 7 else None, "T: " + t if i % 5 else None, "s") for i, (a, t) in enumerate(zip(asked[1::2], texts[1::2], strict=False))] + [(None, asked[0], texts[0], "s")]
    want = set()
    of = {}
    for p, t, x in ps:
        of.setdefault(p, []).append(runs((t or "") + " " + (x or "")))
    for q, text, rel, *_ in lq:
        for g, query, passage, _s in pr:
            if g is None:
                continue
            if text and query and alike(set(words(text)), set(words(query)), 0.7):
                want.add(("query", q, g))
            if passage and any(alike(r, runs(passage)) for p in rel or {} for r in of.get(p, [])):
                want.add(("passage", q, g))
    a = spark.createDataFrame([(*r, True, "") for r in lq], LQ)
    b = spark.createDataFrame([(*r, "") for r in pr], PR)
    found = O.overlaps(a, b, passages(spark, ps))
    got = set(rows(found))
    assert got <= want and len(got) >= 0.97 * len(want) > 20
    report = O.overlap_report(found, a, b).collect()
    assert sum(r.n_links for r in report) >= len(got)
    assert O.overlaps(a.limit(0), b, passages(spark, ps)).collect() == []
    assert O.overlaps(a, b.limit(0), passages(spark, [])).collect() == []


def copies(n, edits):
    """A text of 100 words, and ``n`` copies with ``edits`` words substituted in each."""
    base = [f"w{k}" for k in range(100)]
    out = []
    for i in range(n):
        w = list(base)
        for e in range(edits):
            w[(7 * i + 40 * e) % 96 + 2] = f"own{i}x{e}"
        out.append(" ".join(w))
    return " ".join(base), out


def across(spark, held, texts, scheme, **options):
    a = spark.createDataFrame([("q", held)], "id string, text string")
    b = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "id string, text string")
    return O.similar_across(a, b, scheme, **options).count()


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("options", [{}, {"pairs": 20}, {"pairs": 20, "block": 40}])
def test_copies_with_edits_across_splits(spark, edits, options):
    held, texts = copies(150, edits)
    assert across(spark, held, texts, O.PASSAGES, **options) == 150


def test_questions_of_shared_words(spark):
    # 24 words that all texts share, 4 of each alone
    shared = " ".join(f"w{k}" for k in range(24))
    asked = [shared + " " + " ".join(f"o{i}x{k}" for k in range(4)) for i in range(500)]
    assert across(spark, shared + " a b c", asked[:1], O.QUERIES) == 1
    assert across(spark, shared + " a b c", asked, O.QUERIES) == 500
    assert across(spark, shared + " a b c", asked, O.QUERIES, pairs=10) == 500


@pytest.mark.parametrize("options", [{}, {"pairs": 5}, {"pairs": 5, "block": 6}])
def test_question_templates(spark, options):
    # half of the words are the template's; copies differ in one word
    names = [" ".join(f"n{i}x{k}" for k in range(7)) for i in range(60)]
    asked = spark.createDataFrame([(f"a{i}", f"in which year was the place of {n} built") for i, n in enumerate(names)], "id string, text string")
    train = spark.createDataFrame([(f"b{i}", f"in which year was the place of {n} founded") for i, n in enumerate(names)], "id string, text string")
    got = {(r.a, r.b) for r in O.similar_across(asked, train, O.QUERIES, **options).collect()}
    assert got == {(f"a{i}", f"b{i}") for i in range(60)}


def test_trie():
    t = V.Trie()
    for w, n in (("Railway", 5), ("Москва", 3), ("Féte", 2), ("café", 9)):
        t.add(w, n)
    assert t.match("Rаilwa​у") == "Railway" and t.match("Mосква") == "Москва"
    assert t.match("café") == "café" and t.match("Railways") is None
    assert t.match("Railways", 1) == "Railway" and t.match("Ralway", 1) == "Railway" and t.match("Railwax", 1) == "Railway" and t.match("Rilways", 1) is None
    # arcs over raw characters: full width, marks apart, invisible characters, a ligature
    t.add("fin", 4)
    assert t.match("Ｒａｉｌｗａｙ") == "Railway" and t.match("cafe\u0301") == "café" and t.match("c\u200baf\u00ade\u0301") == "café" and t.match("ﬁn") == "fin" and t.match("cafe") is None
    assert V.visible("ﬁn") == V.visible("fin") and V.visible("Rаilwa\u200bу") == V.visible("Railway")
    assert V.is_clean("Москва") and not V.is_clean("Mосква") and not V.is_clean("ａ") and V.is_clean("é")


TRIPLE = "subject string, relation string, form string, vid string"


def test_look_alikes(spark, rows):
    data = [("a", "Café Bar", "x y"), ("b", "Café Bar", "x y"), ("c", "Сafé​ Bar", "x  y"), ("d", "cafe bar", "X y"), ("e", None, ""), ("f", "Café Bar", None), ("a", "Café Bar", "x y"), (None, "Café Bar", "x y")]
    t = spark.createDataFrame([("Ann Lee", "r", "", ""), ("Ann Lее", "r", "", ""), (None, "r", "", ""), ("ann lee", "r", "", ""), ("Ann Lее", "q", "", "")], TRIPLE)
    got = rows(V.look_alike_pairs(passages(spark, data), t))
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "f"), ("c", "f")]
    assert got == sorted([("subject", "Ann Lee", "Ann Lее"), ("text", "a", "b"), ("text", "a", "c"), ("text", "b", "c")] + [("title", *p) for p in pairs], key=repr)
    star = rows(V.look_alike_pairs(passages(spark, data), t, expanded=0))
    assert set(star) <= set(got) and {x for r in star if r[0] == "title" for x in r[1:]} == {"a", "b", "c", "f"}
    forms = {(r.field, r.key): r.form for r in V.all_forms(passages(spark, data), t).collect()}
    assert forms["title", "a"] == forms["title", "b"] == forms["title", "c"] == "Café Bar" and forms["subject", "Ann Lее"] == "Ann Lee"
    empty = passages(spark, [])
    assert V.look_alike_pairs(empty, t.limit(0)).collect() == []


def test_blanks(spark, rows):
    data = [("a", "two  blanks", "x"), ("b", "two blanks", "x"), ("c", "two\u2007blanks", " x"), ("d", " ", ""), ("e", "", None), ("f", "twoblanks", "x\u200b ")]
    got = rows(V.look_alike_pairs(passages(spark, data), spark.createDataFrame([], TRIPLE)))
    title = [("title", "a", "b"), ("title", "a", "c"), ("title", "b", "c"), ("title", "d", "e")]
    assert got == [("text", "a", "c"), ("text", "a", "f"), ("text", "b", "c"), ("text", "b", "f"), ("text", "c", "f"), *title]
    forms = {(r.field, r.key): r.form for r in V.all_forms(passages(spark, data), spark.createDataFrame([], TRIPLE)).collect()}
    assert forms["title", "a"] == forms["title", "c"] == "two blanks" and forms["text", "f"] == "x" and forms["title", "d"] == ""


def test_look_alikes_of_large_groups(spark):
    data = [(f"a{i:02d}", "Café Bar", f"x{i}") for i in range(60)] + [(f"b{i:02d}", "Сafé Bar", f"y{i}") for i in range(50)]
    got = V.look_alike_pairs(passages(spark, data), spark.createDataFrame([], TRIPLE)).collect()
    assert len(got) == len(set(got)) == 3000
