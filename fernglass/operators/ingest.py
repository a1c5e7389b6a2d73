"""From source rows to passages and questions, and the passages' current state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.params import INGEST_SEED, TARGET_PASSAGES
from fernglass.runtime import materialize


def latest(passages: DataFrame) -> DataFrame:
    """One row a passage id: the one delivered last (batch, then time, then text and title decide); null ids leave.

    A delivery under a known id replaces what stood there, as an upsert would.
    """
    # texts and titles are shuffled once, with a mark that tells an empty one from null
    there = lambda c: F.col(c).isNotNull().alias(f"has_{c}")
    row = F.struct("batch", "added_at", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "title")], there("title"), there("text"), "source")
    last = passages.where("passage_id is not null").groupBy("passage_id").agg(F.max(row).alias("r"))
    own = lambda c: F.when(F.col(f"r.has_{c}"), F.col(f"r.{c}")).alias(c)
    return last.select("passage_id", own("title"), own("text"), "r.source", "r.batch", "r.added_at")


def sentences(passages: DataFrame) -> DataFrame:
    """(passage_id, sentence_index, sentence): each passage cut at its spans; null spans give no row."""
    x = passages.select("passage_id", "text", F.posexplode("sentence_spans").alias("sentence_index", "s"))
    return x.select("passage_id", "sentence_index", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("sentence"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, title, text, sentence_spans, kept): the paragraphs of source rows.

    Sentences are normalized and joined by a space, empty ones dropped; ``kept``
    maps a sentence's index in the source to its index here (null if dropped).
    Paragraphs without text leave; of one title in one row the last paragraph stays.
    """
    x = rows.select("id", F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("pos", "p"))
    s = x.select("id", "pos", T.normalize_text(F.col("p.title")).alias("title"), F.posexplode_outer("p.sentences").alias("i", "raw"))
    s = s.withColumn("sentence", T.normalize_text("raw")).withColumn("keep", (F.coalesce(F.length("sentence"), F.lit(0)) > 0).cast("int"))
    per = s.groupBy("id", "pos", "title").agg(F.sort_array(F.collect_list(F.struct("i", "sentence", "keep"))).alias("a"))  # one paragraph's sentences
    kept = F.filter("a", lambda e: e["keep"] == 1)
    size = lambda e: F.length(e["sentence"])
    spans = F.aggregate(
        kept,
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, e: F.concat(acc, F.array(F.struct(F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] + 1, F.lit(0)).alias("start"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] + 1, F.lit(0)) + size(e)).alias("end")))),
    )
    spans = F.when(F.size(kept) > 0, spans)
    index = F.transform(F.col("a"), lambda e: F.when(e["keep"] == 1, F.size(F.filter(F.col("a"), lambda o: (o["keep"] == 1) & (o["i"] < e["i"])))))
    p = per.where(F.size(kept) > 0).select("id", "pos", "title", F.array_join(F.transform(kept, lambda e: e["sentence"]), " ").alias("text"), spans.alias("sentence_spans"), index.alias("kept"))
    last = F.row_number().over(Window.partitionBy("id", "title").orderBy(F.desc("pos")))
    return p.withColumn("r", last).where("r = 1").select("id", "pos", "title", T.passage_id(F.col("title"), F.col("text")).alias("passage_id"), "text", "sentence_spans", "kept")


def supports(rows: DataFrame, paras: DataFrame) -> DataFrame:
    """(id, question, answer, level, type, supporting_passage_ids, supporting_sentences, resolved).

    Support titles are looked up among the row's paragraphs; a question with any
    title that isn't there is unresolved. A sentence index that was dropped or
    lies past the end keeps the passage and loses the pointer. Ids keep the order
    in which they were first named.
    """
    f = rows.select("id", F.posexplode_outer(F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id"))).alias("k", "s"))
    f = f.select("id", "k", T.normalize_text(F.col("s.title")).alias("title"), F.col("s.sent_id").alias("sent_id"))
    j = f.join(paras.select("id", "title", "passage_id", "kept"), ["id", "title"], "left")
    j = j.withColumn("index", F.when(F.col("sent_id") >= 0, F.get("kept", F.col("sent_id"))))
    per = j.groupBy("id").agg(
        F.bool_and(F.col("passage_id").isNotNull()).alias("resolved"),
        F.sort_array(F.collect_list(F.struct("k", "passage_id", "index"))).alias("a"),
    )
    ids = F.array_distinct(F.transform("a", lambda e: e["passage_id"]))
    at = F.transform(F.filter("a", lambda e: e["index"].isNotNull()), lambda e: F.struct(e["passage_id"].alias("passage_id"), e["index"].alias("sentence_index")))
    q = rows.select("id", T.normalize_text("question").alias("question"), "answer", "level", "type")
    return q.join(per, "id").select("id", "question", "answer", "level", "type", F.when(F.col("resolved"), ids).alias("supporting_passage_ids"), F.when(F.col("resolved"), at).alias("supporting_sentences"), "resolved")


def permutation(n: int, seed: int) -> np.ndarray:
    """The order in which ``n`` rows are drawn for a seed."""
    return np.random.default_rng(seed).permutation(n)


def sample(rows: DataFrame, seed: int = INGEST_SEED, target: int = TARGET_PASSAGES, order_by: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, questions, report): questions drawn by a seeded hash order until ``target`` passages are reached.

    A question is taken while the distinct passages of the questions before it
    number less than ``target``, so the last one may exceed it. Unresolved
    questions contribute nothing. The running count is kept over questions, one
    row each, never over passages.
    """
    paras = paragraphs(rows)
    q = supports(rows, paras)
    good = q.where("resolved")
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(order_by).cast("string")), 256)
    owned = paras.join(good.select("id", key.alias("key")), "id")
    first = owned.groupBy("passage_id").agg(F.min(F.struct("key", "id", "pos")).alias("f"))
    new = first.groupBy(F.col("f.id").alias("id")).agg(F.count(F.lit(1)).alias("new"))
    seq = good.select("id", key.alias("key")).join(new, "id", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    # sums per range of keys first, which are few, then within each range: no task orders all questions
    seq = materialize(seq.withColumn("range", F.substring("key", 1, 3)))
    prior = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = seq.groupBy("range").agg(F.sum("new").alias("m")).select("range", F.coalesce(F.sum("m").over(prior.orderBy("range")), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("new").over(prior.partitionBy("range").orderBy("key", "id")), F.lit(0))
    taken = seq.withColumn("inner", inner).join(F.broadcast(ranges), "range").where(F.col("before") + F.col("inner") < target).select("id")
    questions = good.join(taken, "id", "left_semi")
    held = owned.join(taken, "id", "left_semi")
    pick = F.row_number().over(Window.partitionBy("passage_id").orderBy("key", "pos"))
    passages = held.withColumn("r", pick).where("r = 1").select("passage_id", "title", "text", "sentence_spans")
    report = q.groupBy(F.when(F.col("resolved"), "resolved").otherwise("missing support").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return passages, questions, report


def new_rows(old: DataFrame, delivered: DataFrame, key: str = "passage_id") -> DataFrame:
    """The delivered rows whose key isn't among ``old``, one row a key; what stands stays as it is."""
    fresh = delivered.where(F.col(key).isNotNull()).join(old.select(key), key, "left_anti")
    rest = [c for c in fresh.columns if c != key]
    # of several rows the least by all columns, so that a rerun takes the same one
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*(F.to_json(F.struct(c)).alias(c) for c in rest))).alias("r")).select(key, "r.*").select(*fresh.columns) if rest else fresh.distinct()
