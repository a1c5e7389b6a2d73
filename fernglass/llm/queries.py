"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernglass.llm import keyword_spam, match_groups, name_variants, near_duplicates, packing, question_splits, split_overlap, tokenizer, visual_forms
from fernglass.runtime import materialize, read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(read(spark, d, "passages"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(read(spark, d, "passages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(read(spark, d, "labeled_queries"), read(spark, d, "pairs"), read(spark, d, "passages"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(materialize(p3_found(spark, d)), read(spark, d, "labeled_queries"), read(spark, d, "pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(read(spark, d, "triples"), read(spark, d, "raw_triples"), read(spark, d, "name_aliases"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.name_entities(read(spark, d, "triples"), read(spark, d, "raw_triples"), read(spark, d, "name_aliases"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return match_groups.group_ids(match_groups.match_edges(read(spark, d, "dedupe_removals"), read(spark, d, "replacements")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_forms.look_alike_pairs(read(spark, d, "passages"), read(spark, d, "triples"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual_forms.all_forms(read(spark, d, "passages"), read(spark, d, "triples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return question_splits.question_groups(read(spark, d, "question_passages"), read(spark, d, "pairs"))


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return question_splits.assign_splits(materialize(p7_found(spark, d)))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_texts(read(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return keyword_spam.spam_documents(read(spark, d, "documents"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return keyword_spam.scored(read(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_report, p4_found, p4_entities, p5_found, p6_found, p6_forms, p7_found, p7_splits, p8_ids, p9_containers, p9_report, p10_found, p10_scores)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND}


# Letters of other scripts and the Latin ones they look like, written down for the SQL apart from the library's own table
_FROM = "аеорсухіјѕһԁԛԝӏѵАВЕКМНОРСТУХІЈЅԚԜԌҮҺӀαγινορυϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡı"
_TO = "aeopcyxijshdqwlvABEKMHOPCTYXIJSQWGYHIayivopucjABEZHIKMNOPTYXagi"
_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_INVISIBLE = r"[\x{ad}\x{34f}\x{61c}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]"
_SPACES = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def folded(x: str) -> str:
    """The table of look-alikes in SQL, as far as the tables need compatibility forms."""
    x = f"regexp_replace(regexp_replace({x}, '{_INVISIBLE}', '', 'g'), '{_SPACES}', ' ', 'g')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("Ⅳ", "IV"), ("…", "..."), ("\u2011", "-"), ("\u2010", "-"), ("\u2012", "-"), ("\u2212", "-")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"trim(regexp_replace({x}, ' +', ' ', 'g'))"
    return f"nfc_normalize(translate(translate({x}, '{_WIDE}', '{_PLAIN}'), '{_FROM}', '{_TO}'))"


def worded(x: str) -> str:
    return rf"regexp_extract_all(lower({folded(x)}), '[\p{{L}}\p{{N}}]+')"


def runs(name: str, source: str) -> str:
    """(id, run) and sizes of the distinct runs of three words of (id, text)."""
    return f"""
    {name}_w AS (SELECT id, {worded("text")} AS w FROM {source}),
    {name} AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS run FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM {name}_w WHERE len(w) > 2)),
    {name}_n AS (SELECT id, count(*) AS n FROM {name} GROUP BY id)"""


P1_FOUND = f"""
WITH t AS (SELECT DISTINCT passage_id AS id, coalesce(title, '') || ' ' || text AS text FROM passages WHERE text <> '' AND passage_id IS NOT NULL), {runs("r", "t")},
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM r a JOIN r b ON a.run = b.run AND a.id < b.id GROUP BY ALL)
SELECT a AS passage_id_a, b AS passage_id_b FROM c JOIN r_n x ON x.id = a JOIN r_n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.5
"""

P3_FOUND = f"""
WITH qa AS (SELECT DISTINCT text AS id, {worded("text")} AS w FROM labeled_queries WHERE text IS NOT NULL AND query_id IS NOT NULL),
qb AS (SELECT DISTINCT query AS id, {worded("query")} AS w FROM pairs WHERE query IS NOT NULL AND guid IS NOT NULL),
a AS (SELECT DISTINCT id, unnest(w) AS x FROM qa), b AS (SELECT DISTINCT id, unnest(w) AS x FROM qb),
an AS (SELECT id, count(*) AS n FROM a GROUP BY id), bn AS (SELECT id, count(*) AS n FROM b GROUP BY id),
ab AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM a JOIN b USING (x) GROUP BY ALL),
qm AS (SELECT ab.a, ab.b FROM ab JOIN an ON an.id = ab.a JOIN bn ON bn.id = ab.b WHERE c / (an.n + bn.n - c) >= 0.7),
named AS (SELECT DISTINCT query_id, unnest(map_keys(relevant)) AS passage_id FROM labeled_queries WHERE query_id IS NOT NULL),
ta AS (SELECT DISTINCT coalesce(title, '') || ' ' || coalesce(text, '') AS id, coalesce(title, '') || ' ' || coalesce(text, '') AS text FROM passages WHERE passage_id IN (SELECT passage_id FROM named)),
tb AS (SELECT DISTINCT passage AS id, passage AS text FROM pairs WHERE passage IS NOT NULL AND guid IS NOT NULL), {runs("ra", "ta")}, {runs("rb", "tb")},
rab AS (SELECT ra.id AS a, rb.id AS b, count(*) AS c FROM ra JOIN rb USING (run) GROUP BY ALL),
pm AS (SELECT rab.a, rab.b FROM rab JOIN ra_n x ON x.id = rab.a JOIN rb_n y ON y.id = rab.b WHERE c / (x.n + y.n - c) >= 0.5)
SELECT DISTINCT 'query' AS via, l.query_id, p.guid FROM qm JOIN labeled_queries l ON l.text = qm.a JOIN pairs p ON p.query = qm.b WHERE l.query_id IS NOT NULL AND p.guid IS NOT NULL
UNION SELECT DISTINCT 'passage', n.query_id, p.guid FROM pm JOIN passages s ON coalesce(s.title, '') || ' ' || coalesce(s.text, '') = pm.a JOIN named n ON n.passage_id = s.passage_id JOIN pairs p ON p.passage = pm.b WHERE p.guid IS NOT NULL
"""

P6_FOUND = f"""
WITH v AS (
  SELECT DISTINCT 'title' AS field, passage_id AS key, title AS value FROM passages WHERE title IS NOT NULL AND passage_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'text', passage_id, text FROM passages WHERE text IS NOT NULL AND passage_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'subject', subject, subject FROM triples WHERE subject IS NOT NULL
), f AS (SELECT field, key, value, {folded("value")} AS form FROM v)
SELECT DISTINCT a.field, a.key AS key_a, b.key AS key_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form AND a.value <> b.value AND a.key < b.key
"""

P5_FOUND = """
WITH RECURSIVE m AS (
  SELECT nullif(removed_id, '') AS a, nullif(kept_id, '') AS b FROM dedupe_removals
  UNION ALL SELECT nullif(removed_id, ''), nullif(kept_id, '') FROM replacements
), e AS (
  SELECT a AS u, b AS v FROM m WHERE a IS NOT NULL AND b IS NOT NULL
  UNION SELECT b, a FROM m WHERE a IS NOT NULL AND b IS NOT NULL
), ids AS (
  SELECT a AS id FROM m WHERE a IS NOT NULL UNION SELECT b FROM m WHERE b IS NOT NULL
), reach(id, least) AS (
  SELECT id, id FROM ids
  UNION SELECT e.v, r.least FROM reach r JOIN e ON e.u = r.id WHERE r.least < e.v
)
SELECT id AS passage_id, min(least) AS group_id FROM reach GROUP BY id
"""

P7_FOUND = r"""
WITH RECURSIVE named AS (
  SELECT question_id AS q FROM question_passages WHERE question_id IS NOT NULL
  UNION SELECT regexp_extract(guid, '(?s)^(.*):(?:pos|neg):[0-9]+$', 1) FROM pairs WHERE regexp_matches(guid, '(?s)^.*:(?:pos|neg):[0-9]+$')
), l AS (
  SELECT DISTINCT question_id AS q, lower(trim(p.passage_id)) AS p
  FROM (SELECT question_id, unnest(list_concat(coalesce(gold, []), coalesce(distractors, []))) AS p FROM question_passages WHERE question_id IS NOT NULL)
  WHERE trim(p.passage_id) <> ''
), e AS (
  SELECT DISTINCT x.q AS u, y.q AS v FROM l x JOIN l y ON x.p = y.p AND x.q <> y.q
), reach(id, least) AS (
  SELECT q, q FROM named
  UNION SELECT e.v, r.least FROM reach r JOIN e ON e.u = r.id WHERE r.least < e.v
)
SELECT id AS question_id, min(least) AS group_id FROM reach GROUP BY id
"""
