"""Freezing a corpus under a hash of its content."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.sources.files import Manifest, utc_now


class FrozenCorpusError(RuntimeError):
    """A frozen corpus would change, or isn't what it was when frozen."""


def corpus_hash(passages: DataFrame) -> str:
    """sha256 over id, NUL, text, record separator of all passages in the order of their ids; null texts count as empty.

    The order is part of the definition. Passages are range-partitioned by id and
    sorted in parallel; the driver reads one partition at a time into the digest
    and keeps none.
    """
    line = F.concat(F.col("passage_id"), F.lit("\x00"), F.coalesce("text", F.lit("")), F.lit("\x1e")).alias("line")
    digest = hashlib.sha256()
    for row in passages.where("passage_id is not null").orderBy("passage_id").select(line).toLocalIterator(prefetchPartitions=True):
        digest.update(row.line.encode("utf-8"))
    return digest.hexdigest()


def corpus_digest(passages: DataFrame) -> DataFrame:
    """(n, d0, d1, d2, d3): a digest that needs no order, for corpora too large for :func:`corpus_hash`.

    Each passage's sha256 is cut into four 60-bit numbers that are summed, so any
    change of a row changes the sums, and partial sums combine on the map side.
    """
    h = F.sha2(F.concat(F.col("passage_id"), F.lit("\x00"), F.coalesce("text", F.lit(""))), 256)
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    x = passages.where("passage_id is not null").select(h.alias("h"))
    return x.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"d{i}") for i in range(4)])


def freeze(passages: DataFrame, manifest: Manifest) -> Manifest:
    """The manifest of the frozen corpus. Freezing again changes nothing unless the content did, which is an error."""
    now = corpus_hash(passages)
    if manifest.frozen:
        if manifest.corpus_hash != now:
            raise FrozenCorpusError(f"frozen as {manifest.corpus_hash}, now {now}")
        return manifest
    before = manifest.corpus_hash
    n = passages.count()
    entry = {"at": utc_now(), "before": before, "after": now, "added": n - manifest.passages, "seed": manifest.seed}
    return Manifest(**{**manifest.__dict__, "corpus_hash": now, "frozen": True, "passages": n, "hash_history": [*manifest.hash_history, entry]})


def verify(passages: DataFrame, manifest: Manifest) -> None:
    """Fails unless the corpus is frozen and unchanged."""
    if not manifest.frozen:
        raise FrozenCorpusError("the corpus isn't frozen")
    if (now := corpus_hash(passages)) != manifest.corpus_hash:
        raise FrozenCorpusError(f"frozen as {manifest.corpus_hash}, now {now}")


def ensure_mutable(manifest: Manifest) -> None:
    """Fails if the corpus may not be rebuilt."""
    if manifest.frozen:
        raise FrozenCorpusError("the corpus is frozen; add to it instead of building it anew")


def record_addition(passages: DataFrame, manifest: Manifest, added: int, seed: int) -> Manifest:
    """The manifest after an addition: the hash moves on, the history keeps the old one, a frozen corpus stays frozen."""
    now = corpus_hash(passages)
    entry = {"at": utc_now(), "before": manifest.corpus_hash, "after": now, "added": added, "seed": seed}
    return Manifest(**{**manifest.__dict__, "corpus_hash": now, "passages": manifest.passages + added, "hash_history": [*manifest.hash_history, entry]})
