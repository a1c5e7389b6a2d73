"""Every command over a small corpus."""

import json

import pytest

from fernglass import cli, schemas
from fernglass.sources import files


@pytest.fixture
def home(spark, tmp_path):
    texts = [(f"p{i}", f"Title {n}", f"{n} Bridge was built in {1900 + i} by Ann {n}. It spans the old river near the mill.") for i, n in enumerate(("Fomvel", "Karbun", "Tirris", "Valbos", "Zumfid"))]
    rows = [(p, t, x, None, "s") for p, t, x in texts]
    spark.createDataFrame(rows, schemas.PASSAGE).write.parquet(f"{tmp_path}/corpus.parquet")
    triples = [(f"{n} Bridge", "build", f"Ann {n}", f"p{i}", 0, None, None, "passive") for i, n in enumerate(("Fomvel", "Karbun", "Tirris", "Valbos", "Zumfid"))]
    spark.createDataFrame(triples, schemas.TRIPLE).withColumn("batch", schemas_int(1)).write.parquet(f"{tmp_path}/triples.in")
    asked = [(f"q{i:02d}", f"who built {n} Bridge", "multi-hop-relational" if i % 2 else "exact-term", {f"p{i % 5}": 1}, "hotpotqa", None) for i, n in enumerate((*("Fomvel", "Karbun", "Tirris", "Valbos", "Zumfid") * 2, "Fomvel", "Karbun"))]
    spark.createDataFrame(asked, schemas.LABELED_QUERY).write.parquet(f"{tmp_path}/queries.parquet")
    return tmp_path


def schemas_int(n):
    from pyspark.sql import functions as F

    return F.lit(n)


def test_evaluate(home, capsys):
    common = ["--queries", f"{home}/queries.parquet", "--triples", f"{home}/triples.in", "--out", str(home)]
    assert cli.main(["evaluate", *common, "--all-configs", "--bootstrap", "50", "--graph-wins", "--latency"]) == 0
    said = capsys.readouterr().out
    assert "## fused-rerank" in said and "| fused | " in said and "| verdict | count |" in said and "'p95'" in said
    assert cli.main(["evaluate", *common, "--stub"]) == 0 and "| pooled | mrr | 0.0000 | 12 |" in capsys.readouterr().out


def test_indexes(home, spark, capsys):
    common = ["--folder", f"{home}/ix", "--triples", f"{home}/triples.in", "--out", str(home)]
    assert cli.main(["index", "build", *common]) == 0
    spark.createDataFrame([("p9", "New", "another text", None, "s")], schemas.PASSAGE).write.parquet(f"{home}/more")
    assert cli.main(["index", "add", *common, "--passages", f"{home}/more"]) == 0
    assert "populated | 6" in capsys.readouterr().out


def test_query_builders(home, spark, capsys):
    target = f"{home}/set.jsonl"
    questions = spark.createDataFrame([("h1", "which?", ["p0", "p1"]), ("h2", "what?", ["p1", "p1"])], "question_id string, text string, passage_ids array<string>")
    questions.write.parquet(f"{home}/asked")
    common = ["--queries", target, "--out", str(home)]
    assert cli.main(["queries", "multi-hop-relational", *common, "--questions", f"{home}/asked"]) == 0
    assert cli.main(["queries", "exact-term", *common, "--limit", "3"]) == 0
    assert cli.main(["queries", "paraphrase-sample", *common]) == 0
    review = {"query_id": "pp-1", "source_passage_id": "p2", "draft_text": "x", "final_text": "crossing over water", "reviewer": "r", "reviewed_at": "now", "disposition": "accepted"}
    (home / "reviews.jsonl").write_text(json.dumps(review))
    assert cli.main(["queries", "paraphrase", *common, "--reviews", f"{home}/reviews.jsonl"]) == 0
    assert cli.main(["queries", "paraphrase", *common, "--reviews", f"{home}/reviews.jsonl"]) == 0
    got = {r.query_id: r.category for r in files.read_jsonl(spark, target, schemas.LABELED_QUERY).collect()}
    assert sorted(got.values()) == ["exact-term"] * 3 + ["multi-hop-relational", "paraphrase"] and "mh-h1" in got
    (home / "reviews.jsonl").write_text(json.dumps(review | {"final_text": "the old mill"}))
    with pytest.raises(ValueError, match="mill"):
        cli.main(["queries", "paraphrase", *common, "--reviews", f"{home}/reviews.jsonl"])


def test_extract(home, spark, capsys):
    words = [("Ann", "Ann", "PROPN", "NNP", "nsubj", 1), ("built", "build", "VERB", "VBD", "ROOT", 1), ("it", "it", "PRON", "PRP", "dobj", 1), (".", ".", "PUNCT", ".", "punct", 1)]
    spark.createDataFrame([("p0", 0, i, *w[:5], w[5]) for i, w in enumerate(words)], schemas.TOKEN).write.parquet(f"{home}/tokens")
    spark.createDataFrame([("p0", 0, "Ann", "PERSON", 0, 3)], schemas.ENTITY).write.parquet(f"{home}/entities")
    assert cli.main(["extract", "--tokens", f"{home}/tokens", "--entities", f"{home}/entities", "--out", str(home)]) == 0
    assert "| build | 1 |" in capsys.readouterr().out
    got = spark.read.parquet(f"{home}/triples.parquet").collect()
    assert [(r.subject, r.relation, r.object, r.subject_type) for r in got] == [("Ann", "build", "Title Fomvel", "PERSON")]
