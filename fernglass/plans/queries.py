"""The queries of the core, and their SQL where SQL can express them.

Searches take as queries all labeled queries with a text, against all rows. Only
bm25_text_search, dense_text_search, graph_search and reranked_search_one take those
whose number is divisible by 100, and dense_search the vectors whose id is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators import dedupe, evaluate, extract, freeze, hot_keys, index, ingest, queryset, retrieve, training_pairs
from fernglass.plans import sql
from fernglass.runtime import materialize, read, scratch
from fernglass.sources import files
from fernglass.streaming import increment

Query = Callable[[SparkSession, str], DataFrame]


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest(read(spark, d, "passages"))


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """All labeled queries with an id and a text."""
    return read(spark, d, "labeled_queries").where("query_id is not null and text is not null").select("query_id", "text").distinct()


def _every_100th(spark: SparkSession, d: str) -> DataFrame:
    return _searches(spark, d).where(F.regexp_extract("query_id", r"([0-9]+)$", 1).cast("long") % 100 == 0)


_STORES: dict[tuple[str, str], index.SearchStore] = {}


def _store(spark: SparkSession, d: str) -> index.SearchStore:
    """The stored indexes over the tables of ``d``; each part is built by the first search of the application that reads it."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _STORES:
        store = index.SearchStore(spark, scratch(spark, "indexes"))
        store.over(_corpus(spark, d), read(spark, d, "triples"))
        _STORES[at] = store
    return _STORES[at]


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """All labeled queries whose text names a node of the graph: the searches that the graph can answer."""
    q = read(spark, d, "labeled_queries").where("text is not null").select("query_id", "text").distinct()
    return materialize(q.join(retrieve.entity_links(q, _store(spark, d).table("names")).select("query_id").distinct(), "query_id", "left_semi"))


def _labeled(spark: SparkSession, d: str, searches: DataFrame) -> DataFrame:
    """The searches with their category and judgments, once each; of several rows with text, the first in the order of their fields."""
    q = read(spark, d, "labeled_queries").join(searches.select("query_id").distinct(), "query_id", "left_semi").where("text is not null")
    return _first(q, ["query_id"], ["text", "category", "relevant", "origin", "source_question_id"])


def _first(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key: the least of its rows by all columns, so that a rerun gives the same."""
    order = F.struct(*(F.to_json(F.struct(c)).alias(c) for c in columns))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")


def _rounded(hits: DataFrame, digits: int = 6) -> DataFrame:
    return hits.withColumns({c: F.round(c, digits) for c, t in hits.dtypes if t == "double"})


# --- ingest and dedupe -------------------------------------------------------------


def p2_found(spark, d):
    return hot_keys.names_holding(read(spark, d, "triples"))


def p2_summary(spark, d):
    return hot_keys.summarise_names(read(spark, d, "triples"))


def corpus_latest(spark, d):
    return _corpus(spark, d)


def sentence_slices(spark, d):
    return ingest.sentences(read(spark, d, "passages")).distinct()


def content_address(spark, d):
    p = read(spark, d, "passages")
    return p.select("passage_id", T.passage_id(F.col("title"), F.col("text")).alias("content_id")).distinct()


def exact_duplicates(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    return dedupe.exact_duplicates(docs, F.sha2(T.collapse(F.col("text")), 256))


def near_duplicate_pairs(spark, d):
    # texts of one set of runs are linked through the one with the smallest id, with jaccard 1
    x = dedupe.near_pairs(_corpus(spark, d).select(F.col("passage_id").alias("id"), "text"))
    return x.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def dedupe_corpus(spark, d):
    return dedupe.dedupe(_corpus(spark, d), digest=F.sha2(T.collapse(F.col("text")), 256))


def _replacements(spark, d):
    r = read(spark, d, "replacements").where("removed_id is not null and kept_id is not null and kept_id <> '' and removed_id <> kept_id")
    return r.groupBy("removed_id").agg(F.min("kept_id").alias("kept_id"))


def remapped_questions(spark, d):
    q = _first(read(spark, d, "question_passages"), ["question_id"], ["gold"]).select("question_id", F.transform("gold", lambda p: p["passage_id"]).alias("passage_ids"))
    return dedupe.remap(q, _replacements(spark, d), _corpus(spark, d).select("passage_id"))


def dangling_ids(spark, d):
    q = read(spark, d, "labeled_queries").select(F.col("query_id").alias("question_id"), F.map_keys("relevant").alias("passage_ids")).distinct()
    return dedupe.dangling(q, _corpus(spark, d)).distinct()


def corpus_hash(spark, d):
    return spark.createDataFrame([(freeze.corpus_hash(_corpus(spark, d)),)], "corpus_hash string")


def corpus_digest(spark, d):
    return freeze.corpus_digest(_corpus(spark, d))


def incremental_add(spark, d):
    p = read(spark, d, "passages")
    cut = p.agg(F.expr("cast(max(batch) / 2 as int)").alias("c"))
    x = p.join(F.broadcast(cut))
    return ingest.new_rows(x.where("batch <= c"), x.where("batch > c")).select("passage_id")


def jsonl_round_trip(spark, d):
    path = scratch(spark, "lines")
    c = read(spark, d, "passages").select("passage_id", "title", "text", "sentence_spans", "source")
    files.write_jsonl(c, path)
    return files.load_corpus(spark, path).select("passage_id", "title", "text", "source", F.coalesce(F.size("sentence_spans"), F.lit(-1)).alias("n_spans"))


def streamed_add(spark, d):
    root = scratch(spark, "stream")
    table = read(spark, d, "passages")
    table.write.parquet(f"{root}/in")
    increment.add_stream(spark, f"{root}/in", table.schema, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("passage_id")


def streamed_windows(spark, d):
    root = scratch(spark, "stream")
    table = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{root}/in")
    x = increment.counts_by_window(spark, f"{root}/in", table.schema)
    x.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(x.schema).parquet(f"{root}/out")


# --- text functions --------------------------------------------------------------


def surface_forms(spark, d):
    r = read(spark, d, "raw_triples").select("raw_id", "passage_id", "subject_text", "object_text", "relation")
    return extract.normalize_relations(r, _corpus(spark, d)).select("raw_id", "subject", "object")


def query_overlap(spark, d):
    q = _first(read(spark, d, "labeled_queries").where("text is not null"), ["query_id"], ["text", "relevant"])
    x = queryset.overlap(q, _corpus(spark, d))
    return x.select("query_id", "passage_id", F.array_join("shared", " ").alias("shared"))


def term_candidates(spark, d):
    c = _corpus(spark, d)
    return c.select("passage_id", F.posexplode(T.extract_candidates(F.col("title"), F.col("text"))).alias("pos", "c")).select("passage_id", "pos", "c.term", "c.kind")


# --- indexes and retrieval ---------------------------------------------------------


def bm25_term_stats(spark, d):
    return index.term_stats(index.analyzed(_corpus(spark, d)))


def bm25_field_stats(spark, d):
    return _rounded(index.field_stats(index.analyzed(_corpus(spark, d))), 9)


def index_build(spark, d):
    """(name, state, count): what the search indexes hold after being built anew."""
    store = index.SearchStore(spark, scratch(spark, "indexes"))
    store.build(_corpus(spark, d), read(spark, d, "triples"))
    _STORES[spark.sparkContext.applicationId, d] = store
    return store.health().select("name", "state", "count")


def bm25_search(spark, d):
    return _rounded(retrieve.search_store("bm25", _searches(spark, d), _store(spark, d), 10))


def bm25_text_search(spark, d):
    return _rounded(retrieve.bm25(_every_100th(spark, d), _corpus(spark, d), 10, ("text",)))


def dense_search(spark, d):
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(retrieve.dense(q, e, 10, "vec_id"))


def _dense_hits(spark, d, k, searches=None):
    return retrieve.search_store("dense", _every_100th(spark, d) if searches is None else searches, _store(spark, d), k)


def dense_text_search(spark, d):
    return _rounded(_dense_hits(spark, d, 10))


def vector_checks(spark, d):
    return index.vector_problems(read(spark, d, "embeddings"), "vec_id", 64)


def graph_edges(spark, d):
    return index.graph_edges(read(spark, d, "triples"))


def graph_nodes(spark, d):
    return index.graph_nodes(read(spark, d, "triples"))


def node_degrees(spark, d):
    return index.degrees(index.graph_edges(read(spark, d, "triples")))


def passage_triples(spark, d):
    t = read(spark, d, "triples")
    named = read(spark, d, "labeled_queries").select(F.explode(F.map_keys("relevant")).alias("passage_id"))
    return index.triples_of(t, named).groupBy("passage_id").agg(F.count(F.lit(1)).alias("n"))


def _links(spark, d):
    return retrieve.entity_links(_every_100th(spark, d), index.graph_nodes(read(spark, d, "triples")).select("name"))


def entity_links(spark, d):
    q = read(spark, d, "labeled_queries").where("text is not null").select("query_id", "text").distinct()
    return retrieve.entity_links(q, index.graph_nodes(read(spark, d, "triples")).select("name"))


def link_failure(spark, d):
    q = read(spark, d, "labeled_queries").where("text is not null").select("query_id", "text").distinct()
    return evaluate.link_failure(q, materialize(entity_links(spark, d)))


def graph_search(spark, d):
    return retrieve.search_store("graph", _every_100th(spark, d), _store(spark, d), 10)


def graph_search_linked(spark, d):
    return retrieve.search_store("graph", _linked(spark, d), _store(spark, d), 10)


def graph_search_names(spark, d):
    """Two hops from the names of raw triples whose id is divisible by 100."""
    r = read(spark, d, "raw_triples").where("raw_id % 100 = 0 and subject_text is not null")
    links = r.select(F.col("raw_id").cast("string").alias("query_id"), F.col("subject_text").alias("name"))
    return retrieve.graph(links, index.graph_edges(read(spark, d, "triples")), 10)


def _fused_hits(spark, d, k, q):
    return retrieve.fuse(*(retrieve.search_store(n, q, _store(spark, d)) for n in ("bm25", "dense", "graph")), k)


def fused_search(spark, d):
    return _rounded(_fused_hits(spark, d, 10, _searches(spark, d)), 9)


def fused_search_linked(spark, d):
    return _rounded(_fused_hits(spark, d, 10, _linked(spark, d)), 9)


def reranked_search(spark, d):
    hits = retrieve.search_store("fused-rerank", _searches(spark, d), _store(spark, d), 10)
    return _rounded(hits.select("query_id", "passage_id", "score", "rank"), 6)


def reranked_search_one(spark, d):
    """A single search, as a user would wait for it: the first of the searches."""
    hits = retrieve.search_store("fused-rerank", _every_100th(spark, d).orderBy("query_id", "text").limit(1), _store(spark, d), 10)
    return _rounded(hits.select("query_id", "passage_id", "score", "rank"), 6)


def tuned_search(spark, d):
    """The reranker with weights fitted to the training pairs."""
    model = training_pairs.train_scorer(read(spark, d, "pairs").where("query is not null and passage is not null"))
    q = _searches(spark, d)
    base = materialize(_fused_hits(spark, d, 50, q))
    return retrieve.rerank(q, base, _corpus(spark, d), training_pairs.linear_scorer(model), 10).select("query_id", "passage_id", "rank")


def contract_checks(spark, d):
    return retrieve.contract_problems(materialize(_fused_hits(spark, d, 10, _searches(spark, d))), 10)


def contract_checks_broken(spark, d):
    """The same over lists that break the contract: a rank left out, and scores turned round."""
    hits = materialize(_fused_hits(spark, d, 10, _searches(spark, d)))
    broken = hits.where("rank <> 2").withColumn("score", F.when(F.col("rank") == 5, F.lit(9.0)).otherwise(F.col("score")))
    return retrieve.contract_problems(broken, 9)


# --- evaluation --------------------------------------------------------------------


def _score(spark, d, name, q):
    return evaluate.query_scores(materialize(_labeled(spark, d, q)), materialize(retrieve.search_store(name, q, _store(spark, d), 10)))


def query_metrics(spark, d):
    q = _searches(spark, d)
    x = [_score(spark, d, n, q).withColumn("config", F.lit(n)) for n in ("bm25", "dense")]
    return _rounded(x[0].unionByName(x[1]))


def metrics_linked(spark, d):
    q = _linked(spark, d)
    x = [_score(spark, d, n, q).withColumn("config", F.lit(n)) for n in ("bm25", "dense")]
    return _rounded(x[0].unionByName(x[1]))


def mean_metrics(spark, d):
    return _rounded(evaluate.mean_scores(_score(spark, d, "bm25", _searches(spark, d))))


def _differences(spark, d):
    """bm25 against dense over all searches that name a node, whatever their category."""
    q = _linked(spark, d)
    x, y = (_score(spark, d, n, q).withColumn("category", F.lit("pooled")) for n in ("bm25", "dense"))
    return materialize(evaluate.paired(x, y))


def bootstrap_hashed(spark, d):
    return _rounded(evaluate.hashed_bootstrap(_differences(spark, d)))


def bootstrap_numpy(spark, d):
    return evaluate.paired_bootstrap(_differences(spark, d))


def comparison_table(spark, d):
    """Fused search against each category's better one of bm25 and dense, with intervals for every category and metric."""
    q, store = _searches(spark, d), _store(spark, d)
    labeled = materialize(_labeled(spark, d, q))
    # each source is searched once: its own 10 best are the first of those that are fused
    legs = {n: materialize(retrieve.search_store(n, q, store)) for n in ("bm25", "dense", "graph")}
    hits = {n: legs[n].where("rank <= 10") for n in ("bm25", "dense")} | {"fused": retrieve.fuse(*legs.values(), k=10)}
    return evaluate.compare_to_baseline({n: materialize(evaluate.query_scores(labeled, h)) for n, h in hits.items()}, ("fused",))


def baseline_choice(spark, d):
    q = _searches(spark, d)
    m = lambda n: evaluate.mean_scores(_score(spark, d, n, q)).where("n > 0").withColumn("config", F.lit(n))
    return evaluate.pick_baseline(m("bm25").unionByName(m("dense")))


def graph_wins(spark, d):
    q = _searches(spark, d)
    return evaluate.graph_wins(_labeled(spark, d, q), _dense_hits(spark, d, 10, q), _fused_hits(spark, d, 10, q)).drop("graph_provenance")


def graph_wins_linked(spark, d):
    q = _linked(spark, d)
    return evaluate.graph_wins(_labeled(spark, d, q), _dense_hits(spark, d, 10, q), _fused_hits(spark, d, 10, q)).drop("graph_provenance")


def win_rate(spark, d):
    return evaluate.win_rate(graph_wins_linked(spark, d))


def pattern_precision(spark, d):
    """Of each pattern's triples, the share that has a type on both sides, with its interval."""
    t = read(spark, d, "triples").groupBy("pattern").agg(F.count_if(F.col("subject_type").isNotNull() & F.col("object_type").isNotNull()).alias("k"), F.count(F.lit(1)).alias("n"))
    p, low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return _rounded(t.select("pattern", "k", "n", p.alias("point"), low.alias("low"), high.alias("high")), 9)


def latency_percentiles(spark, d):
    return evaluate.nearest_rank(read(spark, d, "events"), ["event_type"], "value", (50, 95))


def linear_percentiles(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
    return _rounded(e)


def relation_histogram(spark, d):
    return extract.relation_histogram(read(spark, d, "triples"))


def extraction_quality(spark, d):
    """Extracted triples against the raw ones of the same sentences."""
    gold = read(spark, d, "raw_triples").where("passage_id is not null and sentence_index is not null").select("passage_id", "sentence_index", F.col("subject_text").alias("subject"), "relation", F.col("object_text").alias("object"), F.col("raw_id").alias("pos"))
    got = read(spark, d, "triples").where("passage_id is not null and sentence_index is not null")
    got = got.select("passage_id", "sentence_index", "subject", "relation", "object", F.xxhash64("subject", "relation", "object", "batch").alias("pos"))
    return extract.quality(materialize(extract.greedy_matches(gold, got)))


# --- query sets and training pairs ------------------------------------------------------


def exact_term_queries(spark, d):
    return queryset.exact_term_queries(_corpus(spark, d)).select("query_id", "text", "category")


def multi_hop_queries(spark, d):
    q = read(spark, d, "question_passages").select("question_id", F.col("question").alias("text"), F.transform("gold", lambda p: p["passage_id"]).alias("passage_ids"))
    return queryset.multi_hop_queries(q).select("query_id", "category", "origin", F.array_join(F.array_sort(F.map_keys("relevant")), " ").alias("passages"))


def paraphrase_sample(spark, d):
    return queryset.paraphrase_sample(_corpus(spark, d), read(spark, d, "labeled_queries")).select("passage_id")


def queryset_problems(spark, d):
    return queryset.problems(read(spark, d, "labeled_queries"), _corpus(spark, d))


def category_counts(spark, d):
    return queryset.category_counts(read(spark, d, "labeled_queries"))


def training_pairs_built(spark, d):
    return training_pairs.build_pairs(read(spark, d, "question_passages")).select("guid", "query", "passage", "label")


def training_pool(spark, d):
    return training_pairs.training_pool(read(spark, d, "labeled_queries"), read(spark, d, "question_passages"), _corpus(spark, d))


def training_sample(spark, d):
    return training_pairs.training_questions(training_pool(spark, d))


def unresolved_sources(spark, d):
    return training_pairs.unresolved(read(spark, d, "labeled_queries"), read(spark, d, "question_passages"), _corpus(spark, d))


def pair_split(spark, d):
    return training_pairs.split_pairs(read(spark, d, "pairs").select("guid", "passage")).groupBy("guid", "split").agg(F.count(F.lit(1)).alias("n"))


def pair_balance(spark, d):
    return _rounded(training_pairs.pair_report(read(spark, d, "pairs")))


ALL = (
    p2_found, p2_summary, corpus_latest, sentence_slices, content_address, exact_duplicates, near_duplicate_pairs, dedupe_corpus, remapped_questions, dangling_ids, corpus_hash, corpus_digest,
    incremental_add, jsonl_round_trip, streamed_add, streamed_windows, surface_forms, query_overlap, term_candidates, bm25_term_stats, bm25_field_stats, index_build, bm25_search, bm25_text_search, dense_search,
    dense_text_search, vector_checks, graph_edges, graph_nodes, node_degrees, passage_triples, entity_links, link_failure, graph_search, graph_search_linked, graph_search_names, fused_search, fused_search_linked, reranked_search, reranked_search_one,
    tuned_search, contract_checks, contract_checks_broken, query_metrics, metrics_linked, comparison_table, mean_metrics, bootstrap_hashed, bootstrap_numpy, baseline_choice, graph_wins, graph_wins_linked, win_rate, pattern_precision, latency_percentiles, linear_percentiles,
    relation_histogram, extraction_quality, exact_term_queries, multi_hop_queries, paraphrase_sample, queryset_problems, category_counts, training_pairs_built, training_pool, training_sample,
    unresolved_sources, pair_split, pair_balance,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
