"""SQL for the core's queries, composed from named parts."""

from __future__ import annotations

from fernglass.functions.text import STOPWORDS

CORPUS = """corpus AS (
  SELECT passage_id, title, text, source, batch, added_at FROM (
    SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY batch DESC NULLS LAST, added_at DESC NULLS LAST, coalesce(text, '') DESC,
      coalesce(title, '') DESC, title DESC NULLS LAST, text DESC NULLS LAST, source DESC NULLS LAST) AS rn
    FROM passages WHERE passage_id IS NOT NULL) WHERE rn = 1
)"""

#: all labeled queries with an id and a text
SEARCHES = "searches AS (SELECT DISTINCT query_id, text FROM labeled_queries WHERE query_id IS NOT NULL AND text IS NOT NULL)"

EVERY_100TH = """searches AS (
  SELECT DISTINCT query_id, text FROM labeled_queries
  WHERE text IS NOT NULL AND try_cast(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0
)"""


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"


ANALYZED = f"""an AS (
  SELECT passage_id, field, terms, len(terms) AS dl FROM (
    SELECT passage_id, 'title' AS field, {tokens("title")} AS terms FROM corpus
    UNION ALL SELECT passage_id, 'text', {tokens("text")} FROM corpus) WHERE len(terms) > 0
)"""


def bm25(k: int, fields: str = "'title', 'text'") -> str:
    return f"""
    fan AS (SELECT * FROM an WHERE field IN ({fields})),
    post AS (SELECT field, term, passage_id, dl, count(*) AS tf FROM (SELECT field, passage_id, dl, unnest(terms) AS term FROM fan) GROUP BY ALL),
    fst AS (SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM fan GROUP BY field),
    dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM searches) GROUP BY ALL),
    bw AS (
      SELECT p.field, p.term, p.passage_id,
        round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)), 9)::DECIMAL(28, 9) AS w
      FROM post p JOIN dfs USING (field, term) JOIN fst USING (field) WHERE p.term IN (SELECT term FROM qt)
    ),
    bper AS (SELECT query_id, passage_id, field, sum(w * qtf) AS s FROM qt JOIN bw USING (term) GROUP BY ALL),
    bbest AS (SELECT query_id, passage_id, max(s)::DOUBLE AS score FROM bper GROUP BY ALL),
    bm25_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM bbest) WHERE rank <= {k})"""


def vectors(name: str, key: str, source: str, text: str) -> str:
    return f"""
    {name}_d AS (
      SELECT {key}, h % 64 AS dim, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS v
      FROM (SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM (SELECT {key}, unnest({tokens(text)}) AS term FROM {source})) GROUP BY ALL
    ),
    {name}_n AS (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {name}_d GROUP BY {key}),
    {name} AS (SELECT {key}, dim, CASE WHEN norm > 0 THEN v / norm ELSE 0 END AS v FROM {name}_d JOIN {name}_n USING ({key}))"""


def dense(k: int) -> str:
    return f"""
    {vectors("qv", "query_id", "searches", "text")},
    disp AS (SELECT passage_id, CASE WHEN coalesce(title, '') = '' THEN text ELSE title || ': ' || text END AS t FROM corpus),
    {vectors("pv", "passage_id", "disp", "t")},
    dots AS (
      SELECT q.query_id, c.passage_id, round(coalesce(s, 0), 9) AS score
      FROM (SELECT query_id FROM searches) q CROSS JOIN (SELECT passage_id FROM corpus) c
      LEFT JOIN (SELECT query_id, passage_id, sum(qv.v * pv.v) AS s FROM qv JOIN pv USING (dim) GROUP BY ALL) x ON x.query_id = q.query_id AND x.passage_id = c.passage_id
    ),
    dense_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM dots) WHERE rank <= {k})"""


EDGES = """edges AS (SELECT DISTINCT subject AS src, object AS dst, relation, passage_id, sentence_index FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL)"""
NODES = "names AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges)"
ADJACENCY = """adj AS (
  SELECT src AS node, dst AS nbr, relation, passage_id, sentence_index FROM edges
  UNION ALL SELECT dst, src, relation, passage_id, sentence_index FROM edges WHERE src <> dst
)"""


def links(queries: str) -> str:
    """Names whose words stand in a query's words one after another."""
    word = r"[\p{L}\p{N}_]+"
    return f"""
    nk AS (SELECT name, array_to_string(regexp_extract_all(lower(name), '{word}'), ' ') AS seq FROM names WHERE length(lower(name)) >= 2),
    qk AS (SELECT query_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{word}'), ' ') || ' ' AS words FROM {queries}),
    links AS (SELECT DISTINCT query_id, name FROM qk JOIN nk ON seq <> '' AND contains(words, ' ' || seq || ' '))"""


def graph(k: int) -> str:
    order = "passage_id NULLS FIRST, sentence_index NULLS FIRST, relation NULLS FIRST, nbr"
    return f"""
    ok AS (SELECT node FROM adj GROUP BY node HAVING count(*) <= 200),
    a AS (SELECT * FROM adj WHERE node IN (SELECT node FROM ok) AND nbr IN (SELECT node FROM ok)),
    hop1 AS (SELECT * FROM (SELECT node AS s, nbr AS n1, passage_id AS p1, row_number() OVER (PARTITION BY node ORDER BY {order}) AS r FROM a WHERE node IN (SELECT name FROM links)) WHERE r <= 50),
    hop2 AS (SELECT * FROM (
      SELECT m.s, m.n1, a.passage_id AS p2, row_number() OVER (PARTITION BY m.s, m.n1 ORDER BY {order}) AS r
      FROM (SELECT DISTINCT s, n1 FROM hop1) m JOIN a ON a.node = m.n1 WHERE a.nbr <> m.s) WHERE r <= 50),
    gw AS (
      SELECT h.s, h.p1 AS passage_id, greatest(coalesce(c.n, 0), 1)::DOUBLE AS w FROM hop1 h LEFT JOIN (SELECT s, n1, count(*) AS n FROM hop2 GROUP BY ALL) c USING (s, n1)
      UNION ALL SELECT h.s, t.p2, 0.5 FROM hop1 h JOIN hop2 t USING (s, n1)
    ),
    gs AS (SELECT l.query_id, g.passage_id, sum(w) AS score FROM links l JOIN gw g ON g.s = l.name WHERE g.passage_id IS NOT NULL GROUP BY ALL),
    graph_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM gs) WHERE rank <= {k})"""


#: instead of SEARCHES: all labeled queries that name a node
LINKED = rf"""eq AS (SELECT DISTINCT query_id, text FROM labeled_queries WHERE text IS NOT NULL),
ek AS (SELECT array_to_string(regexp_extract_all(lower(n), '[\p{{L}}\p{{N}}_]+'), ' ') AS seq FROM (SELECT subject AS n FROM triples WHERE object IS NOT NULL UNION SELECT object FROM triples WHERE subject IS NOT NULL) WHERE length(lower(n)) >= 2),
searches AS (SELECT query_id, text FROM eq WHERE query_id IN (
  SELECT query_id FROM (SELECT query_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS words FROM eq) JOIN ek ON seq <> '' AND contains(words, ' ' || seq || ' ')))"""


def fused(k: int, searches: str) -> str:
    return f"""{CORPUS}, {searches}, {ANALYZED}, {bm25(100)}, {dense(100)}, {EDGES}, {NODES}, {ADJACENCY}, {links("searches")}, {graph(50)},
    legs AS (
      SELECT query_id, passage_id, 'b' AS leg, rank, score FROM bm25_hits UNION ALL SELECT query_id, passage_id, 'd', rank, score FROM dense_hits
      UNION ALL SELECT query_id, passage_id, 'g', rank, score FROM graph_hits
    ),
    per AS (
      SELECT query_id, passage_id, max(rank) FILTER (leg = 'b') AS rb, max(rank) FILTER (leg = 'd') AS rd, max(rank) FILTER (leg = 'g') AS rg,
        coalesce(max(score) FILTER (leg = 'b'), 0.0) AS prov_bm25, coalesce(max(score) FILTER (leg = 'd'), 0.0) AS prov_dense, coalesce(max(score) FILTER (leg = 'g'), 0.0) AS prov_graph
      FROM legs GROUP BY ALL
    ),
    fs AS (SELECT query_id, passage_id, (coalesce(1.0::DOUBLE / (60 + rb), 0.0) + coalesce(1.0::DOUBLE / (60 + rd), 0.0)) + coalesce(1.0::DOUBLE / (60 + rg), 0.0) AS score, prov_bm25, prov_dense, prov_graph FROM per),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM fs) WHERE rank <= {k})"""


LABELED = "labeled AS (SELECT DISTINCT query_id, category, relevant FROM labeled_queries WHERE text IS NOT NULL AND query_id IN (SELECT query_id FROM searches))"


def metrics(name: str, hits: str) -> str:
    return f"""
    {name}_j AS (
      SELECT l.query_id, l.category, j.p AS passage_id, l.relevant[j.p] AS gain, h.rank
      FROM labeled l LEFT JOIN (SELECT query_id, unnest(map_keys(relevant)) AS p FROM labeled) j USING (query_id)
      LEFT JOIN {hits} h ON h.query_id = l.query_id AND h.passage_id = j.p AND h.rank <= 10
    ),
    {name}_a AS (
      SELECT query_id, category, count(passage_id) AS n, count(*) FILTER (rank <= 5) AS in5, count(*) FILTER (rank <= 10) AS in10, min(rank) AS first,
        coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM {name}_j GROUP BY ALL
    ),
    {name} AS (
      SELECT query_id, category, unnest([
        {{'metric': 'recall@5', 'value': CASE WHEN n = 0 THEN 1.0 ELSE in5 / n END}}, {{'metric': 'recall@10', 'value': CASE WHEN n = 0 THEN 1.0 ELSE in10 / n END}},
        {{'metric': 'ndcg@10', 'value': CASE WHEN n = 0 THEN 1.0 ELSE dcg / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))) END}},
        {{'metric': 'mrr', 'value': coalesce(1.0 / first, 0.0)}}], recursive := true) FROM {name}_a
    )"""


def scores(searches: str) -> str:
    return f"""{CORPUS}, {searches}, {ANALYZED}, {bm25(10)}, {dense(10)}, {LABELED}, {metrics("sb", "bm25_hits")}, {metrics("sd", "dense_hits")}"""


METRICS = "SELECT query_id, category, metric, round(value, 6) AS value, 'bm25' AS config FROM sb UNION ALL SELECT query_id, category, metric, round(value, 6), 'dense' FROM sd"
FUSED_ROWS = "SELECT query_id, passage_id, round(score, 9) AS score, rank, round(prov_bm25, 9) AS prov_bm25, round(prov_dense, 9) AS prov_dense, round(prov_graph, 9) AS prov_graph FROM fused"

_STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


def content_words(x: str) -> str:
    words = rf"list_filter(regexp_extract_all(regexp_replace(lower(coalesce({x}, '')), '''s\b', '', 'g'), '\d+\.\d+|[a-z0-9]+'), lambda w: w NOT IN ({_STOPS}))"
    stem = (
        "CASE WHEN length(w) <= 3 THEN w WHEN regexp_matches(w, '(?:[sxz]es|(?:ch|sh)es)$') AND length(w) >= 5 THEN w[:-3] "
        "WHEN w LIKE '%ies' AND length(w) >= 6 THEN w[:-4] || 'y' WHEN w LIKE '%ing' AND length(w) >= 6 THEN w[:-4] "
        "WHEN w LIKE '%ed' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%s' AND length(w) >= 4 THEN w[:-2] WHEN w LIKE '%ly' AND length(w) >= 5 THEN w[:-3] ELSE w END"
    )
    return f"list_distinct(list_transform({words}, lambda w: {stem}))"


REFS = """refs AS (
  SELECT question_id, question, 1 AS label, unnest(gold) AS p, generate_subscripts(gold, 1) - 1 AS ordinal FROM (SELECT DISTINCT ON (question_id) * FROM question_passages WHERE question_id IS NOT NULL)
  UNION ALL SELECT question_id, question, 0, unnest(distractors), generate_subscripts(distractors, 1) - 1 FROM (SELECT DISTINCT ON (question_id) * FROM question_passages WHERE question_id IS NOT NULL)
)"""

_BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# the compatibility forms that the tables hold; SQL has no function for all of them
_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_PLAINTEXT = "{x}"
for _entity, _char in (("&#39;", "''"), ("&#x27;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAINTEXT = f"replace({_PLAINTEXT}, '{_entity}', '{_char}')"
_COMPATIBLE = f"nfc_normalize(replace(replace(replace(translate({_PLAINTEXT}, '{_WIDE}', '{_PLAIN.replace('{', '{{').replace('}', '}}')}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'Ⅳ', 'IV'))"
_KEY = "lower(trim(regexp_replace(" + _COMPATIBLE + ", '" + _BLANKS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')))"
POOL = f"""{CORPUS}, {REFS},
  source AS (SELECT DISTINCT source_question_id AS question_id FROM labeled_queries WHERE source_question_id <> ''),
  judged AS (SELECT DISTINCT unnest(map_keys(relevant)) AS passage_id FROM labeled_queries),
  sref AS (SELECT * FROM refs WHERE question_id IN (SELECT question_id FROM source)),
  ids AS (SELECT passage_id FROM judged UNION SELECT p.passage_id FROM sref),
  keys AS (SELECT {_KEY.format(x="text")} AS k FROM corpus WHERE passage_id IN (SELECT passage_id FROM judged) AND text IS NOT NULL UNION SELECT {_KEY.format(x="p.text")} FROM sref WHERE p.text IS NOT NULL),
  marked AS (
    SELECT question_id, bool_or(p.passage_id IN (SELECT passage_id FROM ids WHERE passage_id IS NOT NULL)) AS by_id, bool_or({_KEY.format(x="p.text")} IN (SELECT k FROM keys)) AS by_key, bool_or(label = 1) AS gold
    FROM refs GROUP BY question_id
  ),
  pool AS (
    SELECT q.question_id, CASE WHEN q.question_id IN (SELECT question_id FROM source) THEN 'evaluation' WHEN NOT coalesce(gold, false) THEN 'no gold'
      WHEN coalesce(by_id, false) THEN 'id overlap' WHEN coalesce(by_key, false) THEN 'text overlap' ELSE 'kept' END AS status
    FROM (SELECT DISTINCT question_id FROM question_passages WHERE question_id IS NOT NULL) q LEFT JOIN marked USING (question_id)
  )"""

_FORM = f"sha256(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')))"


def shingled(source: str) -> str:
    """(id, run): distinct runs of three words."""
    return rf"""
    w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '{_BLANKS}'), lambda x: x <> '') AS w FROM {source} WHERE text IS NOT NULL),
    sh AS (SELECT DISTINCT id, run FROM (SELECT id, unnest(CASE WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS run FROM w WHERE len(w) > 0)),
    sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
    common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.run = b.run AND a.id < b.id GROUP BY ALL),
    near AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM common JOIN sz x ON x.id = a JOIN sz y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.9)"""


def wins(searches: str) -> str:
    return f"""
        WITH {fused(10, searches)}, {LABELED}, j AS (SELECT query_id, unnest(map_keys(relevant)) AS passage_id FROM labeled WHERE category = 'multi-hop-relational'),
        x AS (SELECT j.*, d.rank AS dense_rank, f.rank AS fused_rank, coalesce(f.prov_graph, 0) AS g FROM j LEFT JOIN dense_hits d ON d.query_id = j.query_id AND d.passage_id = j.passage_id AND d.rank <= 10 LEFT JOIN fused f ON f.query_id = j.query_id AND f.passage_id = j.passage_id)
        SELECT query_id, passage_id, dense_rank, fused_rank, (fused_rank IS NOT NULL AND g > 0 AND dense_rank IS NULL) AS graph_win,
          CASE WHEN fused_rank IS NOT NULL AND g > 0 AND dense_rank IS NULL THEN 'graph-win' WHEN dense_rank IS NOT NULL THEN 'dense-wins' WHEN fused_rank IS NOT NULL THEN 'fused-only (no graph)' ELSE 'neither' END AS verdict FROM x
    """


def reranked(searches: str) -> str:
    return f"""
        WITH {fused(50, searches)}, pr AS (
          SELECT f.query_id, f.passage_id, list_distinct({tokens("s.text")}) AS q, {tokens("CASE WHEN coalesce(c.title, '') = '' THEN coalesce(c.text, '') ELSE c.title || ': ' || coalesce(c.text, '') END")} AS p
          FROM fused f JOIN searches s USING (query_id) JOIN corpus c USING (passage_id)
        ), sc AS (SELECT query_id, passage_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, p)) / len(q) END, 9) AS score FROM pr)
        SELECT query_id, passage_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM sc) WHERE rank <= 10
    """


ORACLES = {
    "p2_found": """
        WITH m AS (SELECT 'subject' AS role, subject AS name FROM triples UNION ALL SELECT 'object', object FROM triples)
        SELECT role, name FROM m WHERE name IS NOT NULL GROUP BY role, name HAVING count(*) >= 0.02 * (SELECT count(*) FROM triples)
    """,
    "p2_summary": """
        WITH m AS (
          SELECT 'subject' AS role, subject AS name, object AS partner, relation, batch, extracted_at FROM triples
          UNION ALL SELECT 'object', object, subject, relation, batch, extracted_at FROM triples
        )
        SELECT role, name, count(*) AS n_rows, count(DISTINCT partner) AS n_partners, count(DISTINCT relation) AS n_relations,
               min(extracted_at) AS first_at, max(extracted_at) AS last_at, max(batch) AS last_batch
        FROM m WHERE name IS NOT NULL GROUP BY role, name
    """,
    "corpus_latest": f"WITH {CORPUS} SELECT * FROM corpus",
    "sentence_slices": """
        SELECT DISTINCT passage_id, (i - 1)::INT AS sentence_index, substr(text, s.start + 1, s.end - s.start) AS sentence
        FROM (SELECT passage_id, text, unnest(sentence_spans) AS s, generate_subscripts(sentence_spans, 1) AS i FROM passages)
    """,
    "content_address": "SELECT DISTINCT passage_id, passage_id AS content_id FROM passages",
    "exact_duplicates": f"""
        WITH x AS (SELECT doc_id, {_FORM} AS h FROM documents WHERE text IS NOT NULL), k AS (SELECT h, min(doc_id) AS kept FROM x GROUP BY h)
        SELECT doc_id AS removed, kept FROM x JOIN k USING (h) WHERE doc_id <> kept
    """,
    "near_duplicate_pairs": f"""
        WITH {CORPUS}, src AS (SELECT passage_id AS id, text FROM corpus), {shingled("src")},
        form AS (SELECT id, sha256(string_agg(run, chr(31) ORDER BY run)) AS f FROM sh GROUP BY id), rep AS (SELECT min(id) AS id FROM form GROUP BY f)
        SELECT a, b, round(jaccard, 6) AS jaccard FROM near WHERE a IN (SELECT id FROM rep) AND (b IN (SELECT id FROM rep) OR jaccard = 1)
    """,
    "dedupe_corpus": f"""
        WITH RECURSIVE {CORPUS}, x AS (SELECT passage_id AS id, text, {_FORM} AS h FROM corpus WHERE text IS NOT NULL),
        ex AS (SELECT id AS removed, min(id) OVER (PARTITION BY h) AS kept FROM x),
        src AS (SELECT id, text FROM x JOIN ex ON removed = id WHERE id = kept), {shingled("src")},
        e AS (SELECT a AS u, b AS v FROM near UNION ALL SELECT b, a FROM near),
        reach(id, least) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.least FROM reach r JOIN e ON e.u = r.id WHERE r.least < e.v),
        comp AS (SELECT id, min(least) AS top FROM reach GROUP BY id)
        SELECT removed AS removed_id, coalesce(top, kept) AS kept_id, 'exact' AS kind, 1.0::DOUBLE AS jaccard FROM ex LEFT JOIN comp ON comp.id = kept WHERE removed <> kept
        UNION ALL
        SELECT c.id, c.top, 'near', round(coalesce(m.c, 0) / (x.n + y.n - coalesce(m.c, 0)), 4) FROM comp c JOIN sz x ON x.id = c.id JOIN sz y ON y.id = c.top
        LEFT JOIN common m ON m.a = c.top AND m.b = c.id WHERE c.id <> c.top
    """,
    "remapped_questions": f"""
        WITH {CORPUS}, r AS (SELECT removed_id, min(kept_id) AS to_id FROM replacements WHERE removed_id IS NOT NULL AND kept_id <> '' AND removed_id <> kept_id GROUP BY removed_id),
        q AS (SELECT DISTINCT ON (question_id) question_id, gold FROM question_passages),
        x AS (SELECT question_id, p.passage_id AS id, k FROM (SELECT question_id, unnest(gold) AS p, generate_subscripts(gold, 1) AS k FROM q)),
        y AS (SELECT x.*, CASE WHEN c.passage_id IS NOT NULL THEN x.id ELSE r.to_id END AS now FROM x LEFT JOIN corpus c ON c.passage_id = x.id LEFT JOIN r ON r.removed_id = x.id),
        f AS (SELECT question_id, now, min(k) AS k FROM y WHERE now IS NOT NULL GROUP BY ALL),
        l AS (SELECT question_id, list(now ORDER BY k) AS ids FROM f GROUP BY question_id),
        s AS (SELECT q.question_id, coalesce(bool_or(y.question_id IS NOT NULL AND now IS NULL), false) AS missing, coalesce(bool_or(now <> id), false) AS changed FROM q LEFT JOIN y USING (question_id) GROUP BY ALL),
        t AS (SELECT s.question_id, ids, CASE WHEN missing THEN 'dropped_missing' WHEN coalesce(len(ids), 0) < 2 THEN 'dropped_collapsed' WHEN changed THEN 'remapped' ELSE 'unchanged' END AS status FROM s LEFT JOIN l USING (question_id))
        SELECT question_id, status, CASE WHEN status NOT LIKE 'dropped%' THEN ids END AS passage_ids FROM t
    """,
    "dangling_ids": """
        SELECT DISTINCT query_id AS question_id, p AS passage_id FROM (SELECT query_id, unnest(map_keys(relevant)) AS p FROM labeled_queries) WHERE p NOT IN (SELECT passage_id FROM passages)
    """,
    "corpus_hash": f"WITH {CORPUS} SELECT sha256(coalesce(string_agg(passage_id || chr(0) || coalesce(text, '') || chr(30), '' ORDER BY passage_id), '')) AS corpus_hash FROM corpus",
    "corpus_digest": f"""
        WITH {CORPUS}, h AS (SELECT sha256(passage_id || chr(0) || coalesce(text, '')) AS h FROM corpus)
        SELECT count(*) AS n, {", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS d{i}" for i in range(4))} FROM h
    """,
    "incremental_add": """
        WITH c AS (SELECT (max(batch) // 2) AS c FROM passages)
        SELECT DISTINCT passage_id FROM passages, c WHERE batch > c AND passage_id IS NOT NULL AND passage_id NOT IN (SELECT passage_id FROM passages, c WHERE batch <= c AND passage_id IS NOT NULL)
    """,
    "jsonl_round_trip": "SELECT passage_id, title, text, source, coalesce(len(sentence_spans), -1)::INT AS n_spans FROM passages",
    "streamed_add": "SELECT DISTINCT passage_id FROM passages WHERE passage_id IS NOT NULL",
    "query_overlap": f"""
        WITH {CORPUS}, q AS (SELECT DISTINCT query_id, text, relevant FROM labeled_queries WHERE text IS NOT NULL),
        j AS (SELECT DISTINCT query_id, text AS q, unnest(map_keys(relevant)) AS passage_id FROM q),
        x AS (SELECT query_id, passage_id, list_sort(list_intersect({content_words("q")}, {content_words("text")})) AS s FROM j JOIN corpus USING (passage_id))
        SELECT query_id, passage_id, array_to_string(s, ' ') AS shared FROM x WHERE len(s) > 0
    """,
    "bm25_term_stats": f"WITH {CORPUS}, {ANALYZED} SELECT field, term, count(*) AS df FROM (SELECT field, unnest(list_distinct(terms)) AS term FROM an) GROUP BY ALL",
    "bm25_field_stats": f"WITH {CORPUS}, {ANALYZED} SELECT field, count(*) AS n_docs, round(avg(dl), 9) AS avgdl FROM an GROUP BY field",
    "index_build": f"""
        WITH {CORPUS}, {ANALYZED}, {EDGES}, {NODES}, {ADJACENCY}, ok AS (SELECT node FROM adj GROUP BY node HAVING count(*) <= 200)
        SELECT 'postings' AS name, 'populated' AS state, count(*) AS count FROM (SELECT DISTINCT field, passage_id, unnest(terms) AS term FROM an)
        UNION ALL SELECT 'vectors', 'populated', count(*) FROM corpus
        UNION ALL SELECT 'links', 'populated', count(*) FROM adj WHERE node IN (SELECT node FROM ok) AND nbr IN (SELECT node FROM ok)
        UNION ALL SELECT 'names', 'populated', count(*) FROM names WHERE length(lower(name)) >= 2 AND regexp_matches(name, '[\\p{{L}}\\p{{N}}_]')
    """,
    "bm25_search": f"WITH {CORPUS}, {SEARCHES}, {ANALYZED}, {bm25(10)} SELECT query_id, passage_id, round(score, 6) AS score, rank FROM bm25_hits",
    "bm25_text_search": f"WITH {CORPUS}, {EVERY_100TH}, {ANALYZED}, {bm25(10, chr(39) + 'text' + chr(39))} SELECT query_id, passage_id, round(score, 6) AS score, rank FROM bm25_hits",
    "dense_search": """
        WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS passage_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
        SELECT query_id, passage_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM s) WHERE rank <= 10
    """,
    "dense_text_search": f"WITH {CORPUS}, {EVERY_100TH}, {dense(10)} SELECT query_id, passage_id, round(score, 6) AS score, rank FROM dense_hits",
    "vector_checks": """
        SELECT vec_id::VARCHAR AS key, 'null id' AS problem FROM embeddings WHERE vec_id IS NULL
        UNION ALL SELECT vec_id::VARCHAR, 'dimension' FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64
        UNION ALL SELECT vec_id::VARCHAR, 'repeated id' FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id HAVING count(*) > 1
    """,
    "graph_edges": f"WITH {EDGES} SELECT * FROM edges",
    "graph_nodes": """
        WITH x AS (
          SELECT subject AS name, subject_type AS type, batch, 0 AS o FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL
          UNION ALL SELECT object, object_type, batch, 1 FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL
        )
        SELECT name, type FROM (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY (type IS NULL), batch DESC NULLS LAST, o DESC, type DESC) AS r FROM x) WHERE r = 1
    """,
    "node_degrees": f"WITH {EDGES}, {ADJACENCY} SELECT node, count(*) AS degree FROM adj GROUP BY node",
    "passage_triples": "SELECT passage_id, count(*) AS n FROM triples WHERE passage_id IN (SELECT unnest(map_keys(relevant)) FROM labeled_queries) GROUP BY passage_id",
    "entity_links": f"WITH {EDGES}, {NODES}, eq AS (SELECT DISTINCT query_id, text FROM labeled_queries WHERE text IS NOT NULL), {links('eq')} SELECT * FROM links",
    "link_failure": f"""
        WITH {EDGES}, {NODES}, eq AS (SELECT DISTINCT query_id, text FROM labeled_queries WHERE text IS NOT NULL), {links("eq")}, q AS (SELECT DISTINCT query_id FROM eq)
        SELECT count(*) AS n_queries, count(*) FILTER (query_id NOT IN (SELECT query_id FROM links)) AS n_unlinked, count(*) FILTER (query_id NOT IN (SELECT query_id FROM links)) / count(*) AS rate FROM q
    """,
    "graph_search": f"WITH {EVERY_100TH}, {EDGES}, {NODES}, {ADJACENCY}, {links('searches')}, {graph(10)} SELECT query_id, passage_id, score, rank FROM graph_hits",
    "graph_search_names": f"""
        WITH {EDGES}, {ADJACENCY}, links AS (SELECT raw_id::VARCHAR AS query_id, subject_text AS name FROM raw_triples WHERE raw_id % 100 = 0 AND subject_text IS NOT NULL), {graph(10)}
        SELECT query_id, passage_id, score, rank FROM graph_hits
    """,
    "fused_search": f"WITH {fused(10, SEARCHES)} SELECT query_id, passage_id, round(score, 9) AS score, rank, round(prov_bm25, 9) AS prov_bm25, round(prov_dense, 9) AS prov_dense, round(prov_graph, 9) AS prov_graph FROM fused",
    "reranked_search": reranked(SEARCHES),
    "reranked_search_one": reranked(EVERY_100TH.replace("searches AS (", "searches AS (SELECT * FROM (", 1)[:-1] + ") ORDER BY query_id, text LIMIT 1)"),
    "graph_search_linked": f"WITH {LINKED}, {EDGES}, {NODES}, {ADJACENCY}, {links('searches')}, {graph(10)} SELECT query_id, passage_id, score, rank FROM graph_hits",
    "fused_search_linked": f"WITH {fused(10, LINKED)} {FUSED_ROWS}",
    "metrics_linked": f"WITH {scores(LINKED)} {METRICS}",
    "contract_checks_broken": f"""
        WITH {fused(10, SEARCHES)}, x AS (SELECT query_id, rank, CASE WHEN rank = 5 THEN 9.0 ELSE score END AS score FROM fused WHERE rank <> 2),
        y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS expected, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM x)
        SELECT DISTINCT query_id, 'ranks aren''t 1..n' AS problem FROM y WHERE rank <> expected
        UNION SELECT query_id, 'more than k hits' FROM y WHERE rank > 9 UNION SELECT query_id, 'scores rise' FROM y WHERE score > before
    """,
    "contract_checks": "SELECT ''::VARCHAR AS query_id, ''::VARCHAR AS problem WHERE false",
    "query_metrics": f"WITH {scores(SEARCHES)} SELECT query_id, category, metric, round(value, 6) AS value, 'bm25' AS config FROM sb UNION ALL SELECT query_id, category, metric, round(value, 6), 'dense' FROM sd",
    "mean_metrics": f"""
        WITH {scores(SEARCHES)}, m AS (SELECT coalesce(category, '?') AS category, metric, avg(value) AS mean, count(*) AS n FROM sb GROUP BY ALL UNION ALL SELECT 'pooled', metric, avg(value), count(*) FROM sb GROUP BY metric),
        want AS (SELECT c AS category, metric FROM (SELECT unnest(['exact-term', 'paraphrase', 'multi-hop-relational', 'pooled']) AS c), (SELECT DISTINCT metric FROM sb))
        SELECT category, metric, round(coalesce(mean, 'nan'::DOUBLE), 6) AS mean, coalesce(n, 0) AS n FROM want FULL JOIN m USING (category, metric)
    """,
    "bootstrap_hashed": f"""
        WITH {scores(LINKED)}, d AS (SELECT metric, query_id, sb.value - sd.value AS d, row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS i FROM sb JOIN sd USING (query_id, category, metric)),
        n AS (SELECT metric, count(*) AS n, avg(d) AS diff FROM d GROUP BY metric),
        draws AS (SELECT metric, n, r, p, ('0x' || substr(md5('0:' || r || ':' || p), 1, 8))::BIGINT % n AS i FROM (SELECT metric, n, r, unnest(generate_series(0, n - 1)) AS p FROM (SELECT metric, n, unnest(generate_series(0, 999)) AS r FROM n))),
        m AS (SELECT metric, r, sum(round(d, 12)::DECIMAL(28, 12))::DOUBLE / count(*) AS m FROM draws JOIN d USING (metric, i) GROUP BY ALL),
        ci AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY metric)
        SELECT 'pooled' AS category, metric, round(diff, 6) AS diff, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, (lo > 0 OR hi < 0) AS excludes_zero, n FROM n JOIN ci USING (metric)
    """,
    "baseline_choice": f"""
        WITH {scores(SEARCHES)}, x AS (SELECT category, metric, value, 'bm25' AS config FROM sb UNION ALL SELECT category, metric, value, 'dense' FROM sd),
        m AS (SELECT category, config, avg(value) AS mean FROM x WHERE metric = 'ndcg@10' GROUP BY ALL UNION ALL SELECT 'pooled', config, avg(value) FROM x WHERE metric = 'ndcg@10' GROUP BY config)
        SELECT category, config FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY mean DESC, config) AS r FROM m) WHERE r = 1
    """,
    "graph_wins": wins(SEARCHES),
    "graph_wins_linked": wins(LINKED),
    "win_rate": f"""
        SELECT count(*) AS n_queries, count(*) FILTER (w) AS n_wins, CASE WHEN count(*) > 0 THEN count(*) FILTER (w) / count(*) ELSE 'nan'::DOUBLE END AS rate
        FROM (SELECT query_id, bool_or(graph_win) AS w FROM ({wins(LINKED)}) GROUP BY query_id)
    """,
    "pattern_precision": """
        WITH t AS (SELECT pattern, count(*) FILTER (subject_type IS NOT NULL AND object_type IS NOT NULL) AS k, count(*) AS n FROM triples GROUP BY pattern),
        z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM t), m AS (SELECT *, 1 + z * z / n AS d FROM z)
        SELECT pattern, k, n, round(p, 9) AS point, round(greatest(0, (p + z * z / (2 * n)) / d - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d), 9) AS low,
          round(least(1, (p + z * z / (2 * n)) / d + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d), 9) AS high FROM m
    """,
    "latency_percentiles": """
        WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
        p AS (SELECT unnest([50, 95]) AS percent)
        SELECT event_type, percent::INT AS percent, value FROM x, p WHERE i = greatest(least(round_even(percent / 100 * n, 0)::BIGINT - 1, n - 1), 0)
    """,
    "linear_percentiles": "SELECT user_id, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY user_id",
    "relation_histogram": "SELECT relation, count(*) AS n FROM triples GROUP BY relation",
    "multi_hop_queries": """
        WITH q AS (SELECT DISTINCT ON (question_id) question_id, list_sort(list_distinct(list_transform(gold, lambda p: p.passage_id))) AS ids FROM question_passages)
        SELECT 'mh-' || question_id AS query_id, 'multi-hop-relational' AS category, 'hotpotqa' AS origin, array_to_string(ids, ' ') AS passages FROM q WHERE len(ids) >= 2
    """,
    "paraphrase_sample": f"""
        WITH {CORPUS} SELECT passage_id FROM corpus WHERE passage_id NOT IN (SELECT unnest(map_keys(relevant)) FROM labeled_queries) ORDER BY md5('20260923:' || passage_id), passage_id LIMIT 60
    """,
    "queryset_problems": f"""
        WITH {CORPUS}, q AS (SELECT *, coalesce(cardinality(relevant), 0) AS n, category = 'multi-hop-relational' AS multi, coalesce(category IN ('exact-term', 'paraphrase', 'multi-hop-relational'), false) AS ok FROM labeled_queries),
        j AS (SELECT query_id, text, category, unnest(map_keys(relevant)) AS p FROM q WHERE ok),
        o AS (SELECT query_id, list_intersect({content_words("j.text")}, {content_words("c.text")}) AS s FROM j JOIN corpus c ON c.passage_id = j.p WHERE category = 'paraphrase')
        SELECT query_id, 'unknown category' AS problem FROM q WHERE NOT ok
        UNION SELECT query_id, 'empty text' FROM q WHERE ok AND coalesce(trim(text), '') = ''
        UNION SELECT query_id, 'no relevant passages' FROM q WHERE ok AND n = 0
        UNION SELECT query_id, 'gain is not 1' FROM q WHERE ok AND len(list_filter(map_values(relevant), lambda g: g <> 1 OR g IS NULL)) > 0
        UNION SELECT query_id, 'wrong origin' FROM q WHERE ok AND coalesce(origin, '') <> CASE WHEN multi THEN 'hotpotqa' ELSE 'agent-drafted' END
        UNION SELECT query_id, 'no source question' FROM q WHERE ok AND multi AND coalesce(source_question_id, '') = ''
        UNION SELECT query_id, 'fewer than two passages' FROM q WHERE ok AND multi AND n < 2
        UNION SELECT query_id, 'not exactly one passage' FROM q WHERE ok AND NOT multi AND n <> 1
        UNION SELECT query_id, 'passage not in the corpus: ' || p FROM j WHERE p NOT IN (SELECT passage_id FROM corpus)
        UNION SELECT query_id, 'repeated query id' FROM q GROUP BY query_id HAVING count(*) > 1
        UNION SELECT query_id, 'shares content words without an override' FROM o WHERE len(s) > 0
    """,
    "category_counts": "SELECT category, count(*) AS n FROM labeled_queries GROUP BY category",
    "training_pairs_built": f"""
        WITH {REFS} SELECT question_id || CASE WHEN label = 1 THEN ':pos:' ELSE ':neg:' END || ordinal AS guid, question AS query,
          CASE WHEN coalesce(p.title, '') = '' THEN p.text ELSE p.title || ': ' || p.text END AS passage, label FROM refs
    """,
    "training_pool": f"WITH {POOL} SELECT * FROM pool",
    "training_sample": f"WITH {POOL} SELECT question_id FROM pool WHERE status = 'kept' ORDER BY md5('20260924:' || question_id), question_id LIMIT 300",
    "unresolved_sources": f"""
        WITH {CORPUS} SELECT DISTINCT query_id, 'question ' || source_question_id AS missing FROM labeled_queries WHERE source_question_id <> '' AND source_question_id NOT IN (SELECT question_id FROM question_passages WHERE question_id IS NOT NULL)
        UNION SELECT query_id, 'passage ' || p FROM (SELECT query_id, unnest(map_keys(relevant)) AS p FROM labeled_queries) WHERE p NOT IN (SELECT passage_id FROM corpus)
    """,
    "pair_split": r"""
        WITH p AS (SELECT guid, passage, regexp_extract(guid, '(?s)^(.*):(?:pos|neg):[0-9]+$', 1) AS question_id FROM pairs),
        q AS (SELECT question_id, row_number() OVER (ORDER BY md5('20260925:' || question_id), question_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT question_id FROM p)),
        x AS (SELECT p.*, q.r <= greatest(1, round_even(n * 0.1, 0)) AS dev FROM p JOIN q USING (question_id)),
        t AS (SELECT DISTINCT passage FROM x WHERE NOT dev AND passage IS NOT NULL)
        SELECT guid, CASE WHEN NOT dev THEN 'train' WHEN passage IN (SELECT passage FROM t) THEN 'dropped' ELSE 'dev' END AS split, count(*) AS n FROM x GROUP BY ALL
    """,
    "pair_balance": """
        WITH c AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM pairs)
        SELECT p AS n_pos, n AS n_neg, round(CASE WHEN n > 0 THEN p / n ELSE 'nan'::DOUBLE END, 6) AS ratio, round(CASE WHEN p + n > 0 THEN greatest(p / (p + n), n / (p + n)) ELSE 'nan'::DOUBLE END, 6) AS majority FROM c
    """,
}
