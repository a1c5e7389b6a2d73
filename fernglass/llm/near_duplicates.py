"""Problem 1: near-duplicate texts by meet-in-the-middle ball hashing.

A fingerprint is a bit vector over all runs of three words, of constant weight: the
bits set are the text's ``BITS`` runs of least hash. Two fingerprints lie within
radius r if at most r bits tell them apart, and every fingerprint emits the
variants within half the radius, r/2 of its bits cleared; two fingerprints within
the radius have a variant in common, the meeting point in their middle. Since all
weigh the same, two at a distance up to r share at least ``BITS - r/2`` bits, so
the variants with exactly r/2 bits cleared hold every meeting point: those with
fewer cleared meet only where one of these meets, too, and those with foreign bits
set give no point that clearing doesn't. Variants are shuffled, colliding texts
paired without repeats (:mod:`pairing`), and each pair verified on all its runs.

Six fingerprints under different hash functions make a miss unlikely: for a pair at
the threshold, 4 bits of which 2 may be cleared miss with 0.31, six such
fingerprints with 0.001; the more alike, the less. How many texts hold a run plays
no part in the fingerprints, so the chance is the same in a pair and in a family of
any number of edited copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.pairing import Bound, colliding, once, parities, verified
from fernglass.llm.shingles import BATCH, M1, M2, Hasher, distinct_within, hashed_runs, mix, runs, sequence_hash
from fernglass.runtime import if_small, materialize

RUN = 3  # words
THRESHOLD = 0.5
SKETCHES, BITS, CLEARED = 6, 4, 2
PARITIES = 8  # longs of a text's parities
EXPANDED = 50  # texts of the same words that are listed pair by pair; larger groups are a star around their smallest id


def texts_of(passages: DataFrame) -> DataFrame:
    """(passage_id, text): title, blank, text of passages whose text is not empty; a null title is empty."""
    return passages.where("text is not null and text <> '' and passage_id is not null").select("passage_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("text")).alias("text"))


def variants(v: np.ndarray, offsets: np.ndarray, sketches: int = SKETCHES, bits: int = BITS, cleared: int = CLEARED) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): hashes of the variants of all fingerprints of each text, given its distinct runs.

    Texts of at most ``2 * bits`` runs also emit their single bits: there the
    radius is a large part of the fingerprint.
    """
    n = np.diff(offsets)
    some = np.nonzero(n)[0]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    seeds = np.arange(1, sketches + 1, dtype=np.uint64) * M2
    keys, owners = [], []
    if len(some):
        starts, size = offsets[:-1][some], n[some]
        owner = np.repeat(np.arange(len(some)), size)
        few = size <= 2 * bits
        for seed in seeds:
            h = mix(v + seed)
            bit = np.zeros((len(some), bits), np.uint64)
            for k in range(bits):
                at = np.nonzero((h == np.repeat(np.minimum.reduceat(h, starts), size)) & (h != full))[0]
                bit[owner[at], k] = mix(v[at])
                h[at] = full
            there = np.arange(bits)[None, :] < size[:, None]
            for subset in map(list, combinations(range(bits), bits - cleared)):
                ok = there[:, subset].all(axis=1)
                # a sum doesn't depend on the order of the bits
                keys.append(mix(bit[:, subset].sum(axis=1, dtype=np.uint64))[ok])
                owners.append(some[ok])
            o, k = np.nonzero(few[:, None] & there)
            keys.append(mix(bit[o, k] * M1))
            owners.append(some[o])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return distinct_within(np.concatenate(keys), np.concatenate(owners), len(n))


def bound(threshold: float) -> Bound:
    return Bound(threshold, PARITIES)


def fingerprints(texts: DataFrame) -> DataFrame:
    """(passage_id, id, size, keys, p0, p1, ...) of (passage_id, text): a hash of the sequence of words, the number of runs, the variants, and the parities.

    Texts of the same words have the same ``id``, whatever separates them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                ids, n = hasher.ids(b.column(1).to_pylist())
                v, offsets = distinct_within(*runs(ids, n, RUN), b.num_rows)
                keys, ends = variants(v, offsets)
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
                columns = [b.column(0), pa.array(sequence_hash(ids, n).view(np.int64)), pa.array(np.diff(offsets).astype(np.int32)), listed, *map(pa.array, parities(v, offsets, PARITIES))]
                yield pa.RecordBatch.from_arrays(columns, names=["passage_id", "id", "size", "keys", *(f"p{i}" for i in range(PARITIES))])

    kind = texts.schema["passage_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"passage_id {kind}, id long, size int, keys array<long>, " + ", ".join(f"p{i} long" for i in range(PARITIES)))


class Prepared:
    """Fingerprints of the passages, written once, and their runs, computed anew for those that need them."""

    def __init__(self, passages: DataFrame):
        self.texts = texts_of(passages)
        self.prints = materialize(fingerprints(self.texts))
        #: one row a text that has runs
        self.classes = once(self.prints.where("size > 0").select(F.lit(False).alias("side"), "id", "size", "keys", *(f"p{i}" for i in range(PARITIES))), ["side", "id"])

    def runs_of(self, ends: DataFrame) -> DataFrame:
        """(side, id, runs) of the (side, id) wanted."""
        ids = if_small(ends.select("id"))
        one = materialize(self.prints.select("id", "passage_id").join(ids, "id", "left_semi").groupBy("id").agg(F.min("passage_id").alias("passage_id")))
        texts = self.texts.join(if_small(one.select("passage_id")), "passage_id", "left_semi")
        # a passage delivered twice may have two texts; only the one that was asked for stays
        hashed = hashed_runs(texts, RUN, ["passage_id"]).select(F.col("form").alias("id"), "runs").join(ids, "id", "left_semi")
        return hashed.groupBy("id").agg(F.first("runs").alias("runs")).select(F.lit(False).alias("side"), "id", "runs")

    def similar(self, threshold: float = THRESHOLD, **options) -> DataFrame:
        """(a, b, jaccard), a < b: ids of different texts that reach ``threshold``."""
        keyed = self.classes.select("side", "id", F.explode("keys").alias("key"))
        pairs = colliding(keyed, self.classes.drop("keys"), self.runs_of, threshold, bound(threshold), cross=False, **options)
        return verified(pairs, self.runs_of, threshold, cross=False)


def near_duplicate_pairs(passages: DataFrame, threshold: float = THRESHOLD, expanded: int = EXPANDED, **options) -> DataFrame:
    """(passage_id_a, passage_id_b), a < b: passages alike to at least ``threshold``.

    Two texts with a pair of similar classes are listed, and so are two texts of
    one class (the same words, whatever their case, blanks and punctuation) that
    have at least one run. Of a class with more than ``expanded`` members, pairs go
    through its representative: (representative, member), and a link between
    classes stands between their representatives. A passage delivered again under
    its id is no pair. Passages with a null id, or a null or empty text, have no
    row; texts of fewer than three words resemble nothing.
    """
    p = Prepared(passages)
    members = p.prints.where("size > 0").select("id", "passage_id").distinct()
    size = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("passage_id").alias("rep"))
    links = p.similar(threshold, **options).select("a", "b")
    several = size.where("n > 1")
    # a class links to itself, once, if it has several members
    links = materialize(links.unionByName(several.where(F.col("n") <= expanded).select(F.col("id").alias("a"), F.col("id").alias("b"))))
    listed = members.join(size, "id").where((F.col("n") <= expanded) | (F.col("passage_id") == F.col("rep")))
    many = links.join(listed.select(F.col("id").alias("a"), F.col("passage_id").alias("x")), "a").join(listed.select(F.col("id").alias("b"), F.col("passage_id").alias("y")), "b").where("x <> y")
    stars = members.join(several.where(F.col("n") > expanded), "id").where("passage_id <> rep").select(F.col("rep").alias("x"), F.col("passage_id").alias("y"))
    both = many.select("x", "y").unionByName(stars)
    return both.select(F.least("x", "y").alias("passage_id_a"), F.greatest("x", "y").alias("passage_id_b")).distinct()


def near_duplicate_groups(passages: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(passage_id, class_id, n_links): one row per passage with a text.

    ``class_id`` is the smallest id of the passages with the same words, and
    ``n_links`` the number of other classes alike to at least ``threshold``.
    """
    p = Prepared(passages)
    links = p.similar(threshold, **options)
    n = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_links"))
    members = p.prints.select("id", "passage_id").distinct()
    classes = members.groupBy("id").agg(F.min("passage_id").alias("class_id")).join(n, "id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(classes, "id").select("passage_id", "class_id", "n_links")
