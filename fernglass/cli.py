"""Command line: ``python -m fernglass.cli <command>``; tables are folders of parquet or JSON lines."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import functions as F

from fernglass import schemas
from fernglass.operators import dedupe, evaluate, extract, freeze, index, ingest, queryset, retrieve, training_pairs
from fernglass.params import INGEST_SEED, PAIRS_SEED, RESAMPLES, TARGET_PASSAGES, TRAIN_QUESTIONS
from fernglass.runtime import materialize, scratch, session, ship
from fernglass.sources import files

INDEXES = {"bm25": index.LexicalIndex, "dense": index.VectorIndex, "graph": index.GraphIndex}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fernglass")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="sample source rows, deduplicate, write passages, questions and manifest")
    b.add_argument("--rows", required=True)
    b.add_argument("--seed", type=int, default=INGEST_SEED)
    b.add_argument("--target", type=int, default=TARGET_PASSAGES)
    a = sub.add_parser("add", help="add passages with new ids")
    a.add_argument("--passages", required=True)
    a.add_argument("--seed", type=int, required=True)
    sub.add_parser("freeze")
    sub.add_parser("verify")
    i = sub.add_parser("index", help="build the indexes, or tell their health")
    i.add_argument("what", choices=["build", "add", "health"])
    i.add_argument("--passages", help="table of the passages to add")
    i.add_argument("--triples")
    i.add_argument("--folder", required=True)
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--config", default="fused-rerank", choices=retrieve.NAMES)
    q.add_argument("--k", type=int, default=10)
    q.add_argument("--triples", required=True)
    v = sub.add_parser("validate", help="check a query set; exit 1 if a rule is broken")
    v.add_argument("--queries", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("--queries", required=True)
    e.add_argument("--triples", required=True)
    e.add_argument("--config", default="fused-rerank", choices=retrieve.NAMES)
    e.add_argument("--all-configs", action="store_true", help="bm25, dense, fused and fused-rerank from stored indexes, and the latter two against each category's baseline")
    e.add_argument("--bootstrap", type=int, default=RESAMPLES)
    e.add_argument("--graph-wins", action="store_true", help="what the graph finds that dense search doesn't")
    e.add_argument("--latency", action="store_true", help="sequential times of single searches")
    e.add_argument("--stub", action="store_true", help="pseudo hits, to try the evaluation without an index")
    x = sub.add_parser("extract", help="triples of a token table, with types of an entity table")
    x.add_argument("--tokens", required=True)
    x.add_argument("--entities", required=True)
    b = sub.add_parser("queries", help="build the queries of one category and replace them in the query set")
    b.add_argument("what", choices=["exact-term", "multi-hop-relational", "paraphrase-sample", "paraphrase"])
    b.add_argument("--queries", required=True, help="the query set, JSON lines; written anew")
    b.add_argument("--limit", type=int, default=60)
    b.add_argument("--seed", type=int, default=INGEST_SEED)
    b.add_argument("--questions", help="table (question_id, text, passage_ids)")
    b.add_argument("--reviews", help="JSON lines of reviewed drafts")
    f = sub.add_parser("pairs", help="leakage-safe training pairs")
    f.add_argument("--queries", required=True)
    f.add_argument("--questions", required=True)
    f.add_argument("--num-questions", type=int, default=TRAIN_QUESTIONS)
    f.add_argument("--pairs-seed", type=int, default=PAIRS_SEED)
    for s in sub.choices.values():
        s.add_argument("--out", default="data")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session("fernglass-cli")
    ship(spark)
    corpus_path, manifest_path = f"{args.out}/corpus.parquet", f"{args.out}/manifest.json"
    corpus = lambda: spark.read.parquet(corpus_path)

    if args.command == "build":
        try:
            freeze.ensure_mutable(files.Manifest.read(manifest_path))
        except FileNotFoundError:
            pass
        passages, questions, _ = ingest.sample(files.load_source_rows(spark, args.rows), args.seed, args.target)
        passages = materialize(passages)
        gone = materialize(dedupe.dedupe(passages))
        kept = materialize(passages.join(gone.select(F.col("removed_id").alias("passage_id")), "passage_id", "left_anti"))
        asked = questions.select(F.col("id").alias("question_id"), F.col("supporting_passage_ids").alias("passage_ids"))
        left = materialize(dedupe.remap(asked, gone.select("removed_id", "kept_id"), kept).where("status in ('remapped', 'unchanged')"))
        if dedupe.dangling(left, kept).take(1):
            raise RuntimeError("a question names a passage that isn't in the corpus")
        kept.write.mode("overwrite").parquet(corpus_path)
        left.write.mode("overwrite").parquet(f"{args.out}/questions.parquet")
        gone.write.mode("overwrite").parquet(f"{args.out}/removals.parquet")
        files.Manifest(corpus_hash=freeze.corpus_hash(corpus()), passages=corpus().count(), seed=args.seed, commit=files.git_commit()).write(manifest_path)
    elif args.command == "add":
        m = files.Manifest.read(manifest_path)
        fresh = materialize(ingest.new_rows(corpus(), spark.read.parquet(args.passages).select("passage_id", "title", "text", "sentence_spans")))
        n = fresh.count()
        fresh.write.mode("append").parquet(corpus_path)
        freeze.record_addition(corpus(), m, n, args.seed).write(manifest_path)
        print(f"{n} passages added")
    elif args.command == "freeze":
        freeze.freeze(corpus(), files.Manifest.read(manifest_path)).write(manifest_path)
    elif args.command == "verify":
        freeze.verify(corpus(), files.Manifest.read(manifest_path))
        print("the corpus is as it was frozen")
    elif args.command == "index":
        for name, kind in INDEXES.items():
            ix = kind(spark, f"{args.folder}/{name}")
            if args.what == "add":
                ix.add(spark.read.parquet(args.triples if name == "graph" else args.passages))
            elif args.what == "build":
                ix.build(spark.read.parquet(args.triples) if name == "graph" else corpus())
            print(evaluate.markdown(ix.health()))
    elif args.command == "query":
        began = time.perf_counter()
        q = spark.createDataFrame([("q", args.text)], "query_id string, text string")
        print(evaluate.markdown(retrieve.search(args.config, q, corpus(), spark.read.parquet(args.triples), args.k), {"score": ".4f"}))
        print(f"{(time.perf_counter() - began) * 1000:.0f} ms")
    elif args.command == "validate":
        bad = queryset.problems(spark.read.parquet(args.queries), corpus()).collect()
        for r in bad:
            print(f"FAIL {r.query_id}: {r.problem}")
        return 1 if bad else 0
    elif args.command == "evaluate":
        labeled = materialize(spark.read.parquet(args.queries).dropDuplicates(["query_id"]))
        asked = labeled.select("query_id", "text")
        table = lambda scores: print(evaluate.markdown(evaluate.mean_scores(scores).orderBy("category", "metric"), {"mean": ".4f"}))
        if args.stub:
            table(materialize(evaluate.query_scores(labeled, evaluate.stub_hits(spark, asked))))
        elif not (args.all_configs or args.graph_wins or args.latency):
            hits = retrieve.search(args.config, asked, corpus(), spark.read.parquet(args.triples), 10)
            table(materialize(evaluate.query_scores(labeled, hits)))
        else:
            store = index.SearchStore(spark, scratch(spark, "indexes"))
            store.build(corpus(), spark.read.parquet(args.triples))
            hits = lambda n: materialize(retrieve.search_store(n, asked, store, 10))
            if args.all_configs:
                scores = {n: materialize(evaluate.query_scores(labeled, hits(n))) for n in ("bm25", "dense", "fused", "fused-rerank")}
                for n, found in scores.items():
                    print(f"## {n}")
                    table(found)
                print("## against the better of bm25 and dense")
                against = evaluate.compare_to_baseline(scores, ("fused", "fused-rerank"), args.bootstrap)
                print(evaluate.markdown(against.orderBy("config", "category", "metric"), dict.fromkeys(("diff", "ci_low", "ci_high"), "+.4f")))
            if args.graph_wins:
                wins = materialize(evaluate.graph_wins(labeled, hits("dense"), hits("fused")))
                print(evaluate.markdown(wins.groupBy("verdict").count().orderBy("verdict")))
                print(evaluate.markdown(evaluate.win_rate(wins), {"rate": ".4f"}))
            if args.latency:
                one = lambda t: retrieve.search_store("fused-rerank", spark.createDataFrame([("q", t)], "query_id string, text string"), store).collect()
                before = evaluate.swap_counts()
                times = evaluate.latency(one, [r.text for r in asked.where("text is not null").orderBy("query_id").limit(40).collect()])
                print({**times, "swapped": (before, evaluate.swap_counts())})
    elif args.command == "extract":
        triples = materialize(extract.triples_of_parse(spark.read.parquet(args.tokens), spark.read.parquet(args.entities), corpus()))
        triples.write.mode("overwrite").parquet(f"{args.out}/triples.parquet")
        print(evaluate.markdown(extract.relation_histogram(triples).orderBy(F.desc("n"), "relation")))
    elif args.command == "queries":
        old = materialize(files.read_jsonl(spark, args.queries, schemas.LABELED_QUERY)) if os.path.exists(args.queries) else spark.createDataFrame([], schemas.LABELED_QUERY)
        if args.what == "paraphrase-sample":
            print(evaluate.markdown(queryset.paraphrase_sample(corpus(), old, args.limit, args.seed)))
            return 0
        if args.what == "exact-term":
            fresh = queryset.exact_term_queries(corpus(), args.limit, args.seed)
        elif args.what == "paraphrase":
            fresh = queryset.paraphrase_queries(files.read_jsonl(spark, args.reviews, schemas.REVIEW), corpus())
        else:
            fresh = queryset.multi_hop_queries(spark.read.parquet(args.questions), args.limit)
        whole = materialize(queryset.replace_category(old, fresh, args.what))
        files.write_jsonl(whole, args.queries, ["query_id"])
        print(evaluate.markdown(queryset.category_counts(whole).orderBy("category")))
    elif args.command == "pairs":
        labeled, asked = spark.read.parquet(args.queries), spark.read.parquet(args.questions)
        pool = materialize(training_pairs.training_pool(labeled, asked, corpus(), strict=True))
        chosen = materialize(training_pairs.training_questions(pool, args.num_questions, args.pairs_seed))
        training_pairs.assert_no_leakage(chosen, labeled, asked, corpus())
        pairs = training_pairs.build_pairs(asked.join(chosen, "question_id", "left_semi"))
        files.write_jsonl(pairs, f"{args.out}/pairs.jsonl", ["guid"])
        print(evaluate.markdown(training_pairs.pair_report(pairs)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
