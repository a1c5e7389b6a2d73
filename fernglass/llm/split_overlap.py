"""Problem 3: records of evaluation splits that also stand in the training split.

Every text gets similarity-hash fingerprints over all its features (words, or runs
of words): the least hashes of its features under many hash functions, which are
equal with the probability of the texts' similarity, cut into segments of a few
values; and a code of bits, each the parity of the features that fall on it, in
which texts differ by no more than by their features. Segments are joined across
the splits, colliding pairs are kept within a Hamming radius of the bit codes (the
most that the threshold allows, so it loses none), and the similarity of what
remains is verified on the features themselves.

How many texts hold a feature plays no part, so a text is found among any number of
edited copies. Segments that many texts share are divided by the texts' rarest
features, which loses nothing (:mod:`pairing`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.pairing import Bound, colliding, once, parities, verified
from fernglass.llm.shingles import BATCH, M1, Hasher, distinct_within, hashed_runs, mix, runs, sequence_hash
from fernglass.runtime import if_small, materialize


@dataclass(frozen=True)
class Scheme:
    """How texts are compared: features of ``run`` words, similar from ``threshold`` on.

    ``blocks`` segments of ``per_block`` values find candidates, which must lie
    within the Hamming radius of codes of ``longs`` times 64 bits.
    """

    run: int
    threshold: float
    blocks: int
    per_block: int
    longs: int

    @property
    def bound(self) -> Bound:
        return Bound(self.threshold, self.longs)


#: At 0.5 a segment of two values is met with 0.25, one of 24 with 0.999.
PASSAGES = Scheme(run=3, threshold=0.5, blocks=24, per_block=2, longs=4)
#: At 0.7 a segment of four values is met with 0.24, one of 28 with 0.9995.
QUERIES = Scheme(run=1, threshold=0.7, blocks=28, per_block=4, longs=2)


def least_hashes(v: np.ndarray, offsets: np.ndarray, functions: int) -> np.ndarray:
    """(functions, texts): 32 bits of the least hash of each text's features under each function; 0 for a text without features."""
    odd = np.random.default_rng(20260923).integers(1, 1 << 63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = np.diff(offsets)
    some = np.nonzero(n)[0]
    out = np.zeros((functions, len(n)), np.uint64)
    if len(some):
        starts = offsets[:-1][some]
        for k in range(functions):
            out[k, some] = mix(np.minimum.reduceat(v * odd[k], starts)) >> np.uint64(32)
    return out


def fingerprints(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """(side, rid, id, size, keys, p0, ...) of (side, rid, text): a hash of the sequence of words, the number of features, the segments, and the bit code.

    Texts of the same words have the same ``id``; texts without features are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        places = np.arange(1, scheme.blocks + 1, dtype=np.uint64)[:, None]
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                ids, n = hasher.ids(b.column(2).to_pylist())
                v, offsets = distinct_within(*runs(ids, n, scheme.run), b.num_rows)
                least = least_hashes(v, offsets, scheme.blocks * scheme.per_block)
                keys = mix(places * M1)
                for k in range(scheme.per_block):
                    keys = mix(keys + least[k :: scheme.per_block])
                size = np.diff(offsets).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, scheme.blocks, dtype=np.int32)), pa.array(np.ascontiguousarray(keys.T).ravel().view(np.int64)))
                columns = [b.column(0), b.column(1), pa.array(sequence_hash(ids, n).view(np.int64)), pa.array(size), listed, *map(pa.array, parities(v, offsets, scheme.longs))]
                made = pa.RecordBatch.from_arrays(columns, names=["side", "rid", "id", "size", "keys", *scheme.bound.codes])
                yield made.filter(pa.array(size > 0))

    kind = texts.schema["rid"].dataType.simpleString()
    return texts.select("side", "rid", "text").mapInArrow(run, f"side boolean, rid {kind}, id long, size int, keys array<long>, " + ", ".join(f"{c} long" for c in scheme.bound.codes))


def similar_across(evaluation: DataFrame, training: DataFrame, scheme: Scheme, **options) -> DataFrame:
    """(a, b, jaccard): ids of (id, text) rows of the two sides whose texts reach the scheme's threshold.

    Texts without features (null, empty, or shorter than a run) resemble none. A
    text may stand in many rows; only its rows are then many.
    """
    texts = evaluation.select(F.lit(True).alias("side"), F.col("id").alias("rid"), "text").unionByName(training.select(F.lit(False).alias("side"), F.col("id").alias("rid"), "text"))
    prints = materialize(fingerprints(texts, scheme))
    classes = once(prints.drop("rid"), ["side", "id"])

    def runs_of(ends: DataFrame) -> DataFrame:
        ends = if_small(ends)
        one = materialize(prints.select("side", "id", "rid").join(ends, ["side", "id"], "left_semi").groupBy("side", "id").agg(F.min("rid").alias("rid")))
        some = texts.join(if_small(one.select("side", "rid").distinct()), ["side", "rid"], "left_semi")
        hashed = hashed_runs(some, scheme.run, ["side", "rid"]).select("side", F.col("form").alias("id"), "runs").join(ends, ["side", "id"], "left_semi")
        return hashed.groupBy("side", "id").agg(F.first("runs").alias("runs"))

    keyed = classes.select("side", "id", F.explode("keys").alias("key"))
    near = colliding(keyed, classes.drop("keys"), runs_of, scheme.threshold, scheme.bound, cross=True, **options)
    found = materialize(verified(near, runs_of, scheme.threshold, cross=True))
    rows = prints.select("side", "id", "rid").distinct()
    a = rows.where("side").select(F.col("id").alias("a"), F.col("rid").alias("ra"))
    b = rows.where("not side").select(F.col("id").alias("b"), F.col("rid").alias("rb"))
    found = if_small(found)
    return found.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "jaccard")


def _by_text(df: DataFrame, key: str, text: str, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """((id, text), once a text if texts are often ``repeated``; (key, id) of every row): ids are hashes of the text."""
    x = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    texts = x.select("text").distinct() if repeated else x.select("text")
    h = F.xxhash64("text")
    return texts.select(h.alias("id"), "text"), x.select("key", h.alias("id"))


def overlaps(labeled_queries: DataFrame, pairs: DataFrame, passages: DataFrame, by_query: Scheme = QUERIES, by_passage: Scheme = PASSAGES) -> DataFrame:
    """(via, query_id, guid): evaluation records found in the training pairs, without repeats.

    ``via`` is ``query`` where the texts of the two questions are alike, and
    ``passage`` where a passage that the query names as relevant, if passages
    holds it, is like the pair's. Null ids, texts and maps give no row.
    """
    q_texts, q_rows = _by_text(labeled_queries, "query_id", "text", True)
    t_texts, t_rows = _by_text(pairs, "guid", "query", True)
    p_texts, p_rows = _by_text(pairs, "guid", "passage", False)
    named = labeled_queries.where("query_id is not null and relevant is not null").select("query_id", F.explode(F.map_keys("relevant")).alias("passage_id")).distinct()
    named = materialize(named)
    held = passages.join(if_small(named.select("passage_id").distinct()), "passage_id", "left_semi").select("passage_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    # a passage delivered twice under one id may differ in its blanks, so ids are of texts here, too
    r_texts, r_rows = _by_text(held, "passage_id", "text", False)
    q = if_small(materialize(similar_across(q_texts, t_texts, by_query)))
    via_query = q.join(q_rows.select(F.col("key").alias("query_id"), F.col("id").alias("a")), "a").join(t_rows.select(F.col("key").alias("guid"), F.col("id").alias("b")), "b").select(F.lit("query").alias("via"), "query_id", "guid")
    p = if_small(materialize(similar_across(r_texts, p_texts, by_passage)))
    of_query = r_rows.select(F.col("key").alias("passage_id"), F.col("id").alias("a")).join(named, "passage_id").select("query_id", "a")
    via_passage = p.join(of_query, "a").join(p_rows.select(F.col("key").alias("guid"), F.col("id").alias("b")), "b").select(F.lit("passage").alias("via"), "query_id", "guid")
    return via_query.unionByName(via_passage).distinct()


def overlap_report(found: DataFrame, labeled_queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, pair_source, via, n_queries, n_pairs, n_links): how much of each split and source is in training.

    A query id or guid that stands in several rows counts under each of its
    splits and sources; null splits and sources form groups of their own.
    """
    q = labeled_queries.select("query_id", "split", "source").distinct()
    p = pairs.select("guid", F.col("source").alias("pair_source")).distinct()
    x = found.join(q, "query_id").join(p, "guid")
    keys = ["split", "source", "pair_source", "via"]
    n = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_links"))
    for col, name in (("query_id", "n_queries"), ("guid", "n_pairs")):
        per = x.select(*keys, col).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        n = n.alias("l").join(per.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]).select("l.*", name)
    return n.select(*keys, "n_queries", "n_pairs", "n_links")
