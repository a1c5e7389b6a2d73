"""Ingest, deduplication, freezing, files and the stream."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fernglass import schemas
from fernglass.operators import dedupe, freeze, ingest
from fernglass.sources import files
from fernglass.streaming import increment


def source_rows(n=12):
    out = []
    for q in range(n):
        titles = [f"T{q}-{i}" for i in range(10)]
        sents = [[f"Paragraph {i} opens here.", " ".join(f"token{q}x{i}x{k}" for k in range(12)), f"Paragraph {i} closes here."] for i in range(10)]
        out.append((f"q{q:03d}", f"Question {q}?", "yes", "hard", "bridge", (titles, sents), ([titles[0], titles[1]], [0, 1])))
    return out


def test_sample_stops_at_target(spark):
    rows = spark.createDataFrame(source_rows(), schemas.SOURCE_ROW)
    passages, questions, report = ingest.sample(rows, target=25)
    assert questions.count() == 3 and passages.count() == 30
    assert {r.reason: r.n for r in report.collect()} == {"resolved": 12}
    r = passages.orderBy("title").first()
    assert [r.text[s.start : s.end] for s in r.sentence_spans][0].startswith("Paragraph")


def test_blank_sentence_shifts_indices(spark):
    row = ("q", "?", "", "", "", (["A", "B"], [["x.", "  ", "y."], ["z."]]), (["A", "B", "A"], [2, 5, 1]))
    rows = spark.createDataFrame([row], schemas.SOURCE_ROW)
    s = ingest.supports(rows, ingest.paragraphs(rows)).first()
    assert s.resolved and len(s.supporting_passage_ids) == 2
    assert [p.sentence_index for p in s.supporting_sentences] == [1]


def test_missing_support_rejects(spark):
    row = ("q", "?", "", "", "", (["A"], [["x."]]), (["A", "Nowhere"], [0, 0]))
    rows = spark.createDataFrame([row], schemas.SOURCE_ROW)
    assert not ingest.supports(rows, ingest.paragraphs(rows)).first().resolved


def corpus(spark, texts):
    return spark.createDataFrame([(f"p{i:02d}", f"t{i}", t) for i, t in enumerate(texts)], "passage_id string, title string, text string")


def long_text(last):
    return " ".join(f"Sentence {i} has some words in it." for i in range(40)) + " " + last


def test_dedupe(spark, rows):
    c = corpus(spark, ["same  text here", "same text here", long_text("one"), long_text("two"), "", "", None, "other"])
    got = rows(dedupe.dedupe(c), "removed_id", "kept_id", "kind")
    assert got == [("p01", "p00", "exact"), ("p03", "p02", "near"), ("p05", "p04", "exact")]
    near = dedupe.dedupe(c).where("kind = 'near'").first()
    assert 0.9 <= near.jaccard < 1


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_near_pairs_against_all_pairs(spark, rows, threshold):
    rng = random.Random(7)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(6)) for _ in range(rng.randrange(1, 40))] for _ in range(25)]
    texts = []
    for w in base:
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(50))
            texts.append(" ".join(v))
    c = corpus(spark, texts).select(F.col("passage_id").alias("id"), "text")

    def runs(t):
        w = t.lower().split()
        return {tuple(w)} if len(w) <= 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {f"p{i:02d}": runs(t) for i, t in enumerate(texts)}
    reps = {}
    for k in sorted(sets):
        reps.setdefault(frozenset(sets[k]), k)
    keep = set(reps.values())
    want = sorted((a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and a in keep and b in keep and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold)
    assert rows(dedupe.near_pairs(c, threshold).where("jaccard < 1"), "a", "b") == want


def test_remap(spark, rows):
    q = spark.createDataFrame([("a", ["dead", "alive"]), ("b", ["gone", "alive"]), ("c", ["dup", "alive"]), ("d", ["alive", "kept"]), ("e", [])], "question_id string, passage_ids array<string>")
    r = spark.createDataFrame([("dead", "kept"), ("dup", "alive")], "removed_id string, kept_id string")
    k = spark.createDataFrame([("alive",), ("kept",)], "passage_id string")
    got = {x.question_id: (x.status, x.passage_ids) for x in dedupe.remap(q, r, k).collect()}
    assert got == {"a": ("remapped", ["kept", "alive"]), "b": ("dropped_missing", None), "c": ("dropped_collapsed", None), "d": ("unchanged", ["alive", "kept"]), "e": ("dropped_collapsed", None)}
    assert rows(dedupe.dangling(q, k)) == [("a", "dead"), ("b", "gone"), ("c", "dup")]


def test_freeze(spark):
    c = corpus(spark, ["b", "a", None])
    want = hashlib.sha256(b"p00\x00b\x1ep01\x00a\x1ep02\x00\x1e").hexdigest()
    m = freeze.freeze(c, files.Manifest())
    assert m.corpus_hash == want and m.frozen and freeze.freeze(c, m) == m
    freeze.verify(c, m)
    with pytest.raises(freeze.FrozenCorpusError):
        freeze.freeze(c.limit(1), m)
    with pytest.raises(freeze.FrozenCorpusError):
        freeze.ensure_mutable(m)
    with pytest.raises(freeze.FrozenCorpusError):
        freeze.verify(c, files.Manifest())
    assert freeze.corpus_digest(c).first() != freeze.corpus_digest(corpus(spark, ["b", "c", None])).first()


def test_latest_and_new_rows(spark, rows):
    s = "passage_id string, title string, text string, source string, batch int, added_at timestamp"
    p = spark.createDataFrame([("x", "old", "a", None, 1, None), ("x", "new", "b", "s", 2, None), (None, "n", "n", None, 1, None), ("y", None, None, None, None, None)], s)
    assert rows(ingest.latest(p), "passage_id", "title", "text") == [("x", "new", "b"), ("y", None, None)]
    assert rows(ingest.new_rows(p.where("batch = 1"), p), "passage_id") == [("y",)]


def test_json_lines(spark, rows, tmp_path):
    c = spark.createDataFrame([("b", None, "ü\n", None, "s"), ("a", "t", "x", [(0, 1)], None)], schemas.PASSAGE)
    files.write_jsonl(c, f"file://{tmp_path}/c", ["passage_id"])
    assert rows(files.load_corpus(spark, f"file://{tmp_path}/c")) == rows(c)
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text.splitlines()[0].startswith('{"passage_id":"a"') and "ü" in text


def test_health_and_names(spark, tmp_path):
    assert files.table_health(spark, "x", f"{tmp_path}/none").first().state == "down"
    spark.range(0).write.parquet(f"{tmp_path}/e")
    assert files.table_health(spark, "x", f"{tmp_path}/e").first().state == "empty"
    spark.range(3).write.parquet(f"{tmp_path}/p")
    assert files.table_health(spark, "x", f"{tmp_path}/p").first().asDict()["count"] == 3
    with pytest.raises(ValueError):
        files.checked_name("a b")


def test_stream_adds_once(spark, rows, tmp_path):
    s = "passage_id string, text string, added_at timestamp"
    spark.createDataFrame([("a", "1", None), ("a", "1", None), (None, "n", None)], s).write.parquet(f"{tmp_path}/in/x")
    run = lambda: increment.add_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], s).schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    run()
    spark.createDataFrame([("a", "2", None), ("b", "1", None)], s).write.parquet(f"{tmp_path}/in/y")
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "passage_id", "text") == [("a", "1"), ("b", "1")]


def test_latest_tells_null_from_empty(spark, rows):
    from datetime import datetime

    at = datetime(2026, 1, 1)
    p = [("a", None, None, "s", 1, at), ("a", "", None, "s", 1, at), ("b", None, None, "s", 1, at), ("c", "", "", "r", 1, at), ("c", "t", "x", "s", 0, at), ("d", None, "", None, 1, at), ("d", "", None, "s", 1, at), (None, "t", "x", "s", 0, at)]
    got = ingest.latest(spark.createDataFrame(p, "passage_id string, title string, text string, source string, batch int, added_at timestamp"))
    assert rows(got, "passage_id", "title", "text", "source") == [("a", "", None, "s"), ("b", None, None, "s"), ("c", "", "", "r"), ("d", "", None, "s")]
