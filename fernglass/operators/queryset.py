"""Building and validating sets of labeled queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.params import CATEGORIES, INGEST_SEED, RELEVANT_GAIN
from fernglass.runtime import materialize

# The templates of drafted queries by kind of term.
TEMPLATES = {
    "phrase": ("What is {term} associated with in {title}?", "Which passage discusses {term}?", "Where does {term} appear in connection with {title}?"),
    "year": ("What happened in {term} according to the article on {title}?", "What event tied to {title} occurred in {term}?"),
    "number": ("What is the figure {term} referring to in the context of {title}?", "Which article on {title} mentions the number {term}?"),
}


def hash_order(seed: int, key: str) -> Column:
    """A seeded order that any engine can compute: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key)))


def draft(term: Column, kind: Column, title: Column, turn: Column) -> Column:
    """The query text of a term, templates of its kind used by turns."""
    out = None
    for k, templates in TEMPLATES.items():
        t = F.element_at(F.array(*map(F.lit, templates)), (turn % len(templates) + 1).cast("int"))
        text = F.replace(F.replace(t, F.lit("{term}"), term), F.lit("{title}"), F.coalesce(title, F.lit("")))
        out = F.when(kind == k, text) if out is None else out.when(kind == k, text)
    return out


def occurrences(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, n): how many passages hold each term of a bounded list verbatim.

    Every passage is scanned once for all terms by an automaton; the terms are
    those of at most a few drafted queries each, never of a whole corpus.
    """
    listed = [r.term for r in terms.select("term").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ahocorasick.Automaton()
        for i, t in enumerate(listed):
            a.add_word(t, i)
        a.make_automaton()
        for b in batches:
            found = [listed[i] for t in b.column(0).to_pylist() if t for i in {x[1] for x in a.iter(t)}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    if not listed:
        return terms.select("term", F.lit(0).cast("long").alias("n")).limit(0)
    hits = corpus.select("text").mapInArrow(run, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.select("term").distinct().join(hits, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def unique_terms(corpus: DataFrame) -> DataFrame:
    """(passage_id, title, pos, term, kind): candidates that no other passage holds as a candidate, in the order tried.

    This is the distributed first test; a term may still be part of another
    passage's words, which :func:`occurrences` finds.
    """
    c = corpus.select("passage_id", "title", F.posexplode(T.extract_candidates(F.col("title"), F.col("text"))).alias("pos", "c")).select("passage_id", "title", "pos", "c.term", "c.kind")
    per = c.select("passage_id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("holders"))
    return c.join(per.where("holders = 1").select("term"), "term").select("passage_id", "title", "pos", "term", "kind")


def exact_term_queries(corpus: DataFrame, limit: int = 60, seed: int = INGEST_SEED, wave: int = 4) -> DataFrame:
    """Up to ``limit`` exact-term queries: passages in a seeded order, each with its first term that stands in it alone.

    Terms are tried in waves: of the first passages of the order, some
    candidates each are counted over the whole corpus, until enough passages have
    a unique one or all are done. A passage's turn in the order, skipped passages
    counted, chooses its template.
    """
    rows = corpus.select("passage_id", "title", hash_order(seed, "passage_id").alias("h"))
    spark = corpus.sparkSession
    cands = unique_terms(corpus)
    done, start = [], 0
    size = limit * wave
    while len(done) < limit:
        # the next passages of the order; ``start`` of them are done
        part = rows.orderBy("h", "passage_id").offset(start).limit(size).collect()
        if not part:
            break
        turn = {r.passage_id: start + i for i, r in enumerate(part)}
        keys = spark.createDataFrame([(p,) for p in turn], "passage_id string")
        here = materialize(cands.join(F.broadcast(keys), "passage_id", "left_semi"))
        n = {r.term: r.n for r in occurrences(here, corpus).collect()}
        best: dict[str, tuple] = {}
        for r in here.collect():
            if n.get(r.term) == 1 and (r.passage_id not in best or r.pos < best[r.passage_id][0]):
                best[r.passage_id] = (r.pos, r.title, r.term, r.kind)
        done += [(p, *best[p], turn[p]) for p in turn if p in best]
        start += len(part)
    x = spark.createDataFrame(done[:limit], "passage_id string, pos int, title string, term string, kind string, turn int")
    return x.select(
        F.concat(F.lit("et-"), "passage_id").alias("query_id"),
        draft(F.col("term"), F.col("kind"), F.col("title"), F.col("turn")).alias("text"),
        F.lit("exact-term").alias("category"),
        F.create_map("passage_id", F.lit(RELEVANT_GAIN)).alias("relevant"),
        F.lit("agent-drafted").alias("origin"),
        F.lit(None).cast("string").alias("source_question_id"),
    )


def multi_hop_queries(questions: DataFrame, limit: int | None = None) -> DataFrame:
    """Labeled queries of the questions with at least two distinct supporting passages, in the order of their ids.

    ``questions`` is (question_id, text, passage_ids). Repeated questions count once.
    """
    ids = F.array_distinct(F.array_compact("passage_ids"))
    x = questions.withColumn("ids", ids).where(F.size("ids") >= 2).dropDuplicates(["question_id"])
    if limit is not None:
        x = x.orderBy("question_id").limit(limit)
    return x.select(
        F.concat(F.lit("mh-"), "question_id").alias("query_id"),
        "text",
        F.lit("multi-hop-relational").alias("category"),
        F.map_from_arrays("ids", F.array_repeat(F.lit(RELEVANT_GAIN), F.size("ids"))).alias("relevant"),
        F.lit("hotpotqa").alias("origin"),
        F.col("question_id").alias("source_question_id"),
    )


def paraphrase_sample(corpus: DataFrame, labeled: DataFrame, limit: int = 60, seed: int = INGEST_SEED) -> DataFrame:
    """(passage_id, title, text): passages that no labeled query uses, the first ``limit`` of a seeded order."""
    used = labeled.select(F.explode(F.map_keys("relevant")).alias("passage_id"))
    return corpus.join(used, "passage_id", "left_anti").orderBy(hash_order(seed, "passage_id"), "passage_id").limit(limit).select("passage_id", "title", "text")


def overlap(labeled: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, passage_id, shared): content words that a query shares with a passage judged relevant, if any."""
    j = labeled.select("query_id", F.col("text").alias("q"), F.explode(F.map_keys("relevant")).alias("passage_id"))
    x = j.join(corpus.select("passage_id", F.col("text").alias("p")), "passage_id")
    return x.select("query_id", "passage_id", T.shared_terms(F.col("q"), F.col("p")).alias("shared")).where(F.size("shared") > 0)


def problems(labeled: DataFrame, corpus: DataFrame, reviews: DataFrame | None = None, per_category: int | None = None, locked_size: int | None = None) -> DataFrame:
    """(query_id, problem): every rule that a query set breaks, all of them and not just the first.

    Checks of the set as a whole have a null query id. An empty result means the
    set is valid.
    """
    q = labeled.withColumn("n", F.coalesce(F.size("relevant"), F.lit(0))).withColumn("n", F.greatest("n", F.lit(0)))
    known = F.col("category").isin(*CATEGORIES)
    multi = F.col("category") == "multi-hop-relational"
    rule = lambda cond, text: q.where(cond).select("query_id", F.lit(text).alias("problem"))
    ok = F.coalesce(known, F.lit(False))
    out = [
        rule(~ok, "unknown category"),
        rule(ok & ~F.coalesce(F.col("text").rlike(r"(?U)[^\s]"), F.lit(False)), "empty text"),
        rule(ok & (F.col("n") == 0), "no relevant passages"),
        rule(ok & F.exists(F.coalesce(F.map_values("relevant"), F.array().cast("array<int>")), lambda g: F.coalesce(g != RELEVANT_GAIN, F.lit(True))), "gain is not 1"),
        rule(ok & multi & ~F.coalesce(F.col("origin") == "hotpotqa", F.lit(False)), "wrong origin"),
        rule(ok & multi & (F.coalesce("source_question_id", F.lit("")) == ""), "no source question"),
        rule(ok & multi & (F.col("n") < 2), "fewer than two passages"),
        rule(ok & ~multi & ~F.coalesce(F.col("origin") == "agent-drafted", F.lit(False)), "wrong origin"),
        rule(ok & ~multi & (F.col("n") != 1), "not exactly one passage"),
    ]
    j = q.where(ok).select("query_id", F.explode(F.map_keys("relevant")).alias("passage_id"))
    out.append(j.join(corpus.select("passage_id"), "passage_id", "left_anti").select("query_id", F.concat(F.lit("passage not in the corpus: "), "passage_id").alias("problem")))
    out.append(labeled.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("query_id", F.lit("repeated query id").alias("problem")))
    over = overlap(labeled.where("category = 'paraphrase'"), corpus)
    if reviews is None:
        out.append(over.select("query_id", F.lit("shares content words without an override").alias("problem")))
    else:
        out += review_problems(q.where(ok), reviews, corpus, over)
    if per_category is not None:
        cats = labeled.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
        per = cats.join(labeled.groupBy("category").agg(F.count(F.lit(1)).alias("c")), "category", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        out.append(per.where(F.col("c") != per_category).select(F.lit(None).cast("string").alias("query_id"), F.concat(F.lit("category count: "), "category").alias("problem")))
        if locked_size is not None:
            out.append(per.agg(F.sum("c").alias("s")).where(F.col("s") != locked_size).select(F.lit(None).cast("string").alias("query_id"), F.lit("size differs from the locked one").alias("problem")))
    return reduce(DataFrame.unionByName, out).distinct()


def review_problems(queries: DataFrame, reviews: DataFrame, corpus: DataFrame, over: DataFrame) -> list[DataFrame]:
    """The rules on review records: every drafted query has one sound record, other queries have none."""
    r = reviews.select(F.col("query_id"), F.struct(*[c for c in reviews.columns if c != "query_id"]).alias("r"))
    x = queries.dropDuplicates(["query_id"]).join(r.withColumn("there", F.lit(True)), "query_id", "left")
    drafted = F.col("category") != "multi-hop-relational"
    blank = lambda c: F.trim(F.coalesce(F.col(f"r.{c}"), F.lit(""))) == ""
    there = F.col("there").isNotNull()
    rule = lambda cond, text: x.where(cond).select("query_id", F.lit(text).alias("problem"))
    out = [
        rule(~drafted & there, "review of a query that needs none"),
        rule(drafted & ~there, "no review record"),
        rule(drafted & there & ~F.coalesce(F.col("r.disposition").isin("accepted", "edited", "rejected"), F.lit(False)), "unknown disposition"),
        rule(drafted & there & F.col("r.disposition").isin("edited", "rejected") & blank("reason"), "disposition without a reason"),
        rule(drafted & there & (blank("reviewer") | blank("reviewed_at")), "no reviewer or time"),
        rule(drafted & there & blank("draft_text"), "no draft text"),
        rule(drafted & there & ~F.col("r.final_text").eqNullSafe(F.col("text")), "final text differs"),
    ]
    src = x.where(drafted & there).select("query_id", F.col("r.source_passage_id").alias("passage_id"))
    out.append(src.join(corpus.select("passage_id"), "passage_id", "left_anti").select("query_id", F.lit("source passage not in the corpus").alias("problem")))
    out.append(reviews.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("query_id", F.lit("more than one review record").alias("problem")))
    out.append(reviews.join(queries, "query_id", "left_anti").select("query_id", F.lit("review of no such query").alias("problem")))
    o = over.join(reviews.select("query_id", "overlap_override"), "query_id", "left")
    out.append(o.where(F.col("overlap_override").isNull()).select("query_id", F.lit("shares content words without an override").alias("problem")))
    out.append(o.where(F.col("overlap_override").isNotNull() & ~F.coalesce(F.array_sort("overlap_override.shared_terms") == F.col("shared"), F.lit(False))).select("query_id", F.lit("override lists other words").alias("problem")))
    return out


def category_counts(labeled: DataFrame) -> DataFrame:
    """(category, n)."""
    return labeled.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def replace_category(existing: DataFrame, fresh: DataFrame, category: str) -> DataFrame:
    """The query set with all queries of ``category`` replaced by ``fresh``; those of other and of null categories stay."""
    columns = existing.columns
    return existing.where(~F.col("category").eqNullSafe(F.lit(category))).unionByName(fresh.select(*columns))


def paraphrase_queries(reviews: DataFrame, corpus: DataFrame) -> DataFrame:
    """Labeled queries of accepted drafts (a review with a final text); one that shares a content word with its passage is refused.

    A shared word is let through where the review has an override that names exactly
    the shared words.
    """
    x = reviews.where("final_text is not null").select(
        "query_id", F.col("final_text").alias("text"), F.lit("paraphrase").alias("category"), F.create_map("source_passage_id", F.lit(RELEVANT_GAIN)).alias("relevant"), F.lit("agent-drafted").alias("origin"), F.lit(None).cast("string").alias("source_question_id"), F.col("overlap_override.shared_terms").alias("_allowed")
    )
    shared = overlap(x, corpus).join(x.select("query_id", "_allowed"), "query_id")
    refused = shared.where(~F.coalesce(F.array_sort("_allowed") == F.array_sort("shared"), F.lit(False))).orderBy("query_id").select("query_id", "shared").limit(5).collect()
    if refused:
        raise ValueError("drafts share words with their passages: " + "; ".join(f"{r.query_id}: {', '.join(r.shared)}" for r in refused))
    return x.drop("_allowed")
