"""Problem 4."""

import pytest

from fernglass.llm import name_variants as V

ALIASES = {"tirry": "bastirel", "basti": "bastirel"}


@pytest.mark.parametrize(
    ("name", "tokens"),
    [
        ("Dr. Bastirel Fomvesselkan", ["bastirel", "fomvesselkan"]),
        ("Fomvesselkan, Tirry", ["bastirel", "fomvesselkan"]),
        ("Bastirel “Tirry” Fomvesselkan", ["bastirel", "fomvesselkan"]),
        ("producer Bastirel K. Fomvesselkan", ["bastirel", "fomvesselkan"]),
        ("B Fomvesserkan", ["b", "fomvesserkan"]),
        ("The Kakunrunbul Bros. & Sons", ["bros", "kakunrunbul", "sons"]),
        ("Valbo B.C.", ["b", "c", "valbo"]),
        ("Vumzol Int'l Airport", ["airport", "intl", "vumzol"]),
        ("A. Fomvesselkan", ["a", "fomvesselkan"]),
        ("Valbospanpom UAA", ["a", "a", "u", "valbospanpom"]),
        ("he", ["he"]),
        ("the", ["the"]),
        ("...", []),
    ],
)
def test_tokens(name, tokens):
    assert V.name_tokens(name, ALIASES) == sorted(tokens)


def test_common_subsequence():
    def slow(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            u = [0]
            for j, y in enumerate(b):
                u.append(t[j] + 1 if x == y else max(t[j + 1], u[j]))
            t = u
        return t[-1]

    for a, b in [("theatre", "theater"), ("abc", ""), ("", ""), ("kakunrunbul", "kkaunrunbul"), ("aaa", "aa"), ("xyz", "abc")]:
        assert V.common_subsequence(a, b) == slow(a, b)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("bastirel fomvesselkan", "b fomvesselkan", True),
        ("bastirel fomvesselkan", "bas fomveselkan", True),
        ("bastirel fomvesselkan", "gwestina fomvesselkan", False),
        ("kakunrunbul records incorporated", "inc kakunrunbul recs", True),
        ("kakunrunbul theatre association", "assn kakunrunbul theater", True),
        ("kakunrunbul theatre association", "kakunrunbul records incorporated", False),
        ("valbospanpom broadcasting corporation", "b c valbospanpom", True),
        ("simborminmas brothers sons", "susfonvitsin brothers sons", False),
        ("a zumfiditza", "abrelin zumfiditza", True),
        ("b c", "b c d", False),
        ("b c", "b d", False),
        ("single", "single", True),
        ("kakunrunbul", "kakunrunbull", True),
        ("valbospan", "valbospann", True),
        ("theme", "theme's", False),
        ("bo fox", "b fox", True),
        ("bo fox", "b foxx", False),
        ("bastirel fomvesselkan", "bastirel anna fomvesselkan", True),
        ("bastirel fomvesselkan", "gwestina anna fomvesselkan", False),
        ("bo fox", "bo ann fox", False),
    ],
)
def test_match(a, b, same):
    assert V.names_match(sorted(a.split()), sorted(b.split())) == same


TR = "subject string, object string, subject_type string, object_type string, name string, entity string"
RAW = "subject_text string, object_text string, node string"


def test_variants(spark, rows):
    t = spark.createDataFrame(
        [
            ("Bastirel Fomvesselkan", "Kakunrunbul Records Incorporated", "PERSON", "ORG", "", ""),
            ("Tirry Fomvesselkan", "the silent cup", None, None, "", ""),
            ("BASTIREL FOMVESSELKAN", "Ristitgisses Bridge", None, "WORK_OF_ART", "", ""),
            ("Bаstirel Fomvesselkan", "Ristitgises Bridge", None, None, "", ""),
            ("Gwestina Fomvesselkan", None, "PERSON", None, "", ""),
            (None, None, None, None, None, None),
        ]
        * 2,
        TR,
    )
    r = spark.createDataFrame([("Fomvesselkan, B.", "Kakunrunbul Recs. Inc.", ""), ("he", "", ""), ("Basirel Fomvesselkan", None, "")], RAW)
    al = spark.createDataFrame([("Tirry", "Bastirel"), (None, "x"), ("Tirry", "Bastirel")], "short_form string, long_form string")
    got = set(rows(V.variant_pairs(t, r, al)))
    person = ["Bastirel Fomvesselkan", "Tirry Fomvesselkan", "BASTIREL FOMVESSELKAN", "Bаstirel Fomvesselkan", "Fomvesselkan, B.", "Basirel Fomvesselkan"]
    same_look = {tuple(sorted(("Bastirel Fomvesselkan", "Bаstirel Fomvesselkan")))}
    want = {tuple(sorted((a, b))) for a in person for b in person if a != b} - same_look | {("Kakunrunbul Records Incorporated", "Kakunrunbul Recs. Inc.")}
    assert got == want
    star = set(rows(V.variant_pairs(t, r, al, expanded=2)))
    assert star < got and len(star) == 6
    ent = {x.name: x.type for x in V.name_entities(t, r, al).collect()}
    assert "Ristitgisses Bridge" not in ent and ent["Kakunrunbul Recs. Inc."] == "ORG"
    assert V.variant_pairs(t.limit(0), r.limit(0), al.limit(0)).collect() == []


def test_common_suffixes_are_refined(spark, rows):
    nodes = [(f"g{c}{i:02d}vanna surnam{c}{i:02d}ekan",) for c in "abc" for i in range(30)] + [("gavanna surnaxa07ekan",)]
    df = spark.createDataFrame([(" ".join(sorted(n.split())),) for (n,) in nodes], "node string")
    wide = {tuple(r) for r in V.candidates(df, 10**6).collect()}
    tight = {tuple(r) for r in V.candidates(df, 5).collect()}
    assert tight <= wide and any("surnaxa07ekan" in a + b and "surnama07ekan" in a + b for a, b in wide)


def test_abbreviations_in_common_blocks(spark):
    last = "fomvesselkan"
    given = [f"j{c}{d}nrila" for c in "aeiou" for d in "bdfghklm"]
    short = ["j", "ja", "jnrl", "jbrla"]
    df = spark.createDataFrame([(" ".join(sorted((g, last))),) for g in given + short], "node string")
    for block in (1, 5):
        got = {frozenset(p) for p in V.candidates(df, block).collect()}
        for a in short:
            for b in given:
                x, y = sorted((a, last)), sorted((b, last))
                assert not V.names_match(x, y) or frozenset((" ".join(x), " ".join(y))) in got, (a, b, block)


def test_large_entities_are_listed_whole(spark):
    base = "bastirel fomvesselkan"
    names = ["".join(c.upper() if i >> k & 1 else c for k, c in enumerate(base)) for i in range(256, 256 + 410)]
    names = sorted(set(names))
    t = spark.createDataFrame([(n, None, "PERSON", None, "", "") for n in names], TR)
    r = spark.createDataFrame([], RAW)
    got = V.variant_pairs(t, r, spark.createDataFrame([], "short_form string, long_form string")).collect()
    assert len(names) > 400 and len(got) == len(set(got)) == len(names) * (len(names) - 1) // 2


def test_single_short_and_middle_names(spark, rows):
    names = ["Kakunrunbul", "Kakunrunbull", "Bo Fox", "Fox, B.", "Bastirel Fomvesselkan", "Bastirel Anna Fomvesselkan"]
    t = spark.createDataFrame([(x, None, "PERSON", None, "", "") for x in names], TR)
    r = spark.createDataFrame([], RAW)
    al = spark.createDataFrame([], "short_form string, long_form string")
    assert rows(V.variant_pairs(t, r, al)) == sorted(tuple(sorted(p)) for p in zip(names[::2], names[1::2], strict=True))
    nodes = spark.createDataFrame([(" ".join(sorted(n.casefold().split())),) for n in names], "node string")
    pairs = {frozenset(p) for p in V.candidates(nodes, 1).collect()}
    assert {"kakunrunbul", "kakunrunbull"} in pairs and {"bastirel fomvesselkan", "anna bastirel fomvesselkan"} in pairs


def test_what_a_longer_name_has_more_is_its_middle(spark, rows):
    names = ["Kakunrunbul Chamber Orchestra", "Valbospanpom Orchestra, Chamber", "the chamber orchestra", "Bastirel Fomvesselkan", "Fomvesselkan, Bastirel Anna", "Fomvesselkan Anna"]
    t = spark.createDataFrame([(x, None, None if x[0] == "t" else "ORG" if "Chamber" in x else "PERSON", None, "", "") for x in names], TR)
    al = spark.createDataFrame([], "short_form string, long_form string")
    assert rows(V.variant_pairs(t, spark.createDataFrame([], RAW), al)) == [("Bastirel Fomvesselkan", "Fomvesselkan, Bastirel Anna")]
    assert [V.middle_name(x, {}) for x in names] == ["chamber", None, None, None, "anna", None]
