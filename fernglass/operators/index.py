"""The lexical, vector and graph indexes as tables, each with build, add and health."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.ingest import new_rows
from fernglass.params import HUB_DEGREE
from fernglass.runtime import if_small, materialize, release, shuffles_dropped
from fernglass.sources.files import table_health

FIELDS = ("title", "text")
DIMENSIONS = 64
NAME_WORD = r"[\p{L}\p{N}_]+"


# --- lexical ---------------------------------------------------------------


def terms_of(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(passage_id, and each of ``fields``): a row a passage with the terms of its fields."""
    return corpus.select("passage_id", *[T.tokens(F.col(f)).alias(f) for f in fields])


def by_field(terms: DataFrame) -> DataFrame:
    """(passage_id, field, terms, dl) of :func:`terms_of`, for each field that has any."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in terms.columns[1:]]))
    return terms.select("passage_id", each.alias("a")).select("passage_id", "a.field", "a.terms", F.size("a.terms").alias("dl")).where("dl > 0")


def analyzed(corpus: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(passage_id, field, terms, dl): the terms of each field that has any."""
    return by_field(terms_of(corpus, fields))


def postings(terms: DataFrame) -> DataFrame:
    """(field, term, doc, dl, tf): of :func:`terms_of` with numbered passages (doc, passage_id, fields), the passages of a batch that have a term, in lists.

    A passage is one row of ``terms``, so its terms are counted where it is read. Lists
    of numbers are a small part of what a row for each posting and its id would be.
    """
    fields = terms.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, n = np.asarray(b.column(0)), b.num_rows
            for f, name in enumerate(fields):
                lists = b.column(1 + f)
                dl = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                key, tf = np.unique(np.asarray(words.indices).astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
                v, d = key // max(n, 1), key % max(n, 1)
                ends = pa.array(np.searchsorted(v, np.arange(len(words.dictionary) + 1)).astype(np.int32))
                of = lambda x, kind, ends=ends: pa.ListArray.from_arrays(ends, pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words.dictionary), pa.string()), words.dictionary, of(docs[d], pa.int64()), of(dl[d], pa.int32()), of(tf, pa.int32())], names=["field", "term", "doc", "dl", "tf"])

    return terms.drop("passage_id").mapInArrow(run, "field string, term string, doc array<long>, dl array<int>, tf array<int>")


def term_stats(an: DataFrame) -> DataFrame:
    """(field, term, df)."""
    return an.select("field", F.explode(F.array_distinct("terms")).alias("term")).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(an: DataFrame) -> DataFrame:
    """(field, n_docs, avgdl): over the passages that have the field."""
    return an.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


# --- vectors ---------------------------------------------------------------

_TERM = regex.compile(r"[\p{L}\p{N}]+")


def hashed_vector(text: str | None, cache: dict[str, tuple[int, int]], dims: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed terms, of length 1; zeros for a text without terms. A stand-in for a trained encoder."""
    v = np.zeros(dims)
    for t, n in Counter(_TERM.findall((text or "").lower())).items():
        at = cache.get(t)
        if at is None:
            h = int(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
            if len(cache) > 500_000:
                cache.clear()
            at = cache[t] = (h % dims, 1 if (h // dims) % 2 == 0 else -1)
        v[at[0]] += at[1] * n
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm else v


def encode(df: DataFrame, key: str, text: str = "text", dims: int = DIMENSIONS, instruction: str = "") -> DataFrame:
    """(key, embedding): a vector for each row, computed a batch at a time in the Python workers.

    ``instruction`` is put before each text; encoders that were trained so want one
    before queries, and none before passages.
    """
    if instruction:
        df = df.withColumn(text, F.concat(F.lit(instruction), F.coalesce(F.col(text), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, int]] = {}
        for b in batches:
            rows = [hashed_vector(t, cache, dims) for t in b.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            offsets = np.arange(0, dims * len(rows) + 1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def vector_problems(vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, problem): null or repeated ids, null vectors, and vectors of another dimension; empty for a sound index."""
    k = F.col(key).cast("string").alias("key")
    null = vectors.where(F.col(key).isNull()).select(k, F.lit("null id").alias("problem"))
    size = vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dims)).select(k, F.lit("dimension").alias("problem"))
    twice = vectors.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(k, F.lit("repeated id").alias("problem"))
    return null.unionByName(size).unionByName(twice)


# --- graph -----------------------------------------------------------------


def graph_edges(triples: DataFrame) -> DataFrame:
    """(src, dst, relation, passage_id, sentence_index): each relation once; rows without a subject or object leave."""
    return triples.where("subject is not null and object is not null").select(F.col("subject").alias("src"), F.col("object").alias("dst"), "relation", "passage_id", "sentence_index").distinct()


def graph_nodes(triples: DataFrame) -> DataFrame:
    """(name, type): every end of an edge, with the last type written: by batch, and within a batch objects after subjects; null if no row has one."""
    ends = F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type"), F.lit(0).alias("o")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("type"), F.lit(1).alias("o"))))
    x = triples.where("subject is not null and object is not null").select("batch", ends.alias("e")).select("e.name", "e.type", "batch", "e.o")
    return x.groupBy("name").agg(F.max_by("type", F.when(F.col("type").isNotNull(), F.struct("batch", "o", "type"))).alias("type"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr, relation, passage_id, sentence_index): edges from both ends; a loop stands once."""
    e = F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"))
    r = F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"))
    both = F.when(F.col("src") == F.col("dst"), F.array(e)).otherwise(F.array(e, r))
    return edges.select(F.explode(both).alias("e"), "relation", "passage_id", "sentence_index").select("e.node", "e.nbr", "relation", "passage_id", "sentence_index")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return adjacency(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def triples_of(triples: DataFrame, passages: DataFrame) -> DataFrame:
    """The triples whose passage is among ``passages``."""
    return triples.join(passages.select("passage_id"), "passage_id", "left_semi")


def without_hubs(edges: DataFrame, most: int) -> DataFrame:
    """:func:`adjacency` between nodes of at most ``most`` edges; the few others are looked up, so edges aren't shuffled for it."""
    hubs = if_small(materialize(degrees(edges).where(F.col("degree") > most).select("node")))
    return adjacency(edges).join(hubs, "node", "left_anti").join(hubs.withColumnRenamed("node", "nbr"), "nbr", "left_anti")


def name_keys(names: DataFrame) -> DataFrame:
    """(name, key, start): names of two characters or more in folded form, with their first two words (the only one of a single word)."""
    n = names.where("name is not null").select("name", T.fold_case("name").alias("key")).where(F.length("key") >= 2)
    return n.select("name", "key", F.array_join(F.slice(F.regexp_extract_all("key", F.lit(NAME_WORD), F.lit(0)), 1, 2), " ").alias("start")).where("start <> ''")


# --- stored indexes ----------------------------------------------------------


class SearchStore:
    """Everything the retrievers read, built once under a folder and searched many times.

    Postings lie in ``BUCKETS`` folders by a hash of the term, sorted by term, so
    that a search reads the folders of its terms only; they name passages by their
    numbers in ``terms``. Links of the graph lie the same way by node. Batches of many
    searches read the passages' terms themselves, and no postings. Building replaces what is there.
    """

    BUCKETS = 64
    LISTED = 2_000
    PARTS = ("texts", "terms", "postings", "fields", "vectors", "links", "names")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.due = spark, folder.rstrip("/"), set()

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        if by:
            df = df.withColumn("bucket", self._bucket(F.col(by))).repartition("bucket").sortWithinPartitions("bucket", by)
        w = df.write.mode("overwrite").option("compression", "zstd")
        with shuffles_dropped(self.spark):
            (w.partitionBy("bucket") if by else w).parquet(f"{self.folder}/{name}")

    def _bucket(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.BUCKETS)).cast("int")

    def build(self, corpus: DataFrame, triples: DataFrame, hub: int = HUB_DEGREE) -> None:
        self.over(corpus, triples, hub)
        for name in self.PARTS:
            self.table(name)

    def over(self, corpus: DataFrame, triples: DataFrame, hub: int = HUB_DEGREE) -> None:
        """As :meth:`build`, but every part is built when a search first reads it: a search takes no disk for what others need."""
        self.sources, self.due = (corpus, triples, hub), set(self.PARTS)

    def _make(self, name: str) -> None:
        corpus, triples, hub = self.sources
        if name == "texts":
            # the lexical and the vector index are made from the stored texts, so the corpus is computed once
            self._write(corpus.select("passage_id", "title", "text"), name)
        elif name == "terms":
            self._write(terms_of(self.table("texts")).select(F.monotonically_increasing_id().alias("doc"), "*"), name)
        elif name == "postings":
            self._write(postings(self.table("terms")), name, "term")
        elif name == "fields":
            self._write(field_stats(by_field(self.table("terms").drop("doc"))), name)
        elif name == "vectors":
            self._write(encode(self.table("texts").select("passage_id", T.display(F.col("title"), F.col("text")).alias("text")), "passage_id"), name)
        elif name == "links":
            edges = materialize(graph_edges(triples), "zstd")
            self._write(without_hubs(edges, hub), name, "node")
            release(edges)
        else:
            ends = triples.where("subject is not null and object is not null").select(F.explode(F.array("subject", "object")).alias("name"))
            self._write(name_keys(ends.distinct()), name)

    def table(self, name: str) -> DataFrame:
        if name in self.due:
            self._make(name)
            self.due.discard(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def of(self, name: str, column: str, wanted: DataFrame) -> DataFrame:
        """The rows of a bucketed table whose ``column`` is among ``wanted``; only buckets that may hold some are read.

        Up to ``LISTED`` values are pushed down to the scan as a list, more are joined.
        """
        asked = wanted.select(column, self._bucket(F.col(column)).alias("b")).distinct()
        rows = asked.limit(self.LISTED + 1).collect()
        table = self.table(name)
        if len(rows) <= self.LISTED:
            return table.where(F.col("bucket").isin(sorted({r.b for r in rows})) & F.col(column).isin([r[0] for r in rows])).drop("bucket")
        return table.join(if_small(wanted.select(column).distinct()), column, "left_semi").drop("bucket")

    def health(self) -> DataFrame:
        rows = [table_health(self.spark, n, f"{self.folder}/{n}") for n in ("postings", "vectors", "links", "names")]
        if rows[0].first().state == "populated":
            each = self.table("postings").agg(F.sum(F.size("doc")).alias("count"))
            rows[0] = rows[0].drop("count").join(each).select(*rows[1].columns)
        return reduce(DataFrame.unionByName, rows)


class StoredIndex:
    """A table under a path with ``build`` (replace), ``add`` (only rows with new keys) and ``health``."""

    name, key = "index", "passage_id"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, source: DataFrame) -> DataFrame:
        raise NotImplementedError

    def build(self, source: DataFrame) -> int:
        self.rows(source).write.mode("overwrite").parquet(self.path)
        return self.count()

    def add(self, source: DataFrame) -> int:
        """Rows of unknown keys are appended; those that stand aren't touched. Returns the number of rows now."""
        old = self.read()
        fresh = new_rows(old, source, self.key) if self.key in source.columns else source
        self.rows(fresh).write.mode("append").parquet(self.path)
        return self.count()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.read().count()

    def health(self) -> DataFrame:
        return table_health(self.spark, self.name, self.path)


class LexicalIndex(StoredIndex):
    """Analyzed fields; statistics are computed from them, so an addition leaves none stale."""

    name = "bm25"

    def rows(self, source: DataFrame) -> DataFrame:
        return analyzed(source)

    def count(self) -> int:
        return self.read().select("passage_id").distinct().count()


class VectorIndex(StoredIndex):
    name = "dense"

    def rows(self, source: DataFrame) -> DataFrame:
        return encode(source.select("passage_id", T.display(F.col("title"), F.col("text")).alias("text")), "passage_id")


class GraphIndex(StoredIndex):
    """Edges; loading a triple twice changes nothing."""

    name = "graph"

    def rows(self, source: DataFrame) -> DataFrame:
        return graph_edges(source)

    def add(self, source: DataFrame) -> int:
        old = self.read()
        keys = ["src", "dst", "relation", "passage_id", "sentence_index"]
        x = graph_edges(source).alias("x")
        fresh = x.join(old.alias("o"), [F.col(f"x.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left_anti")
        fresh.write.mode("append").parquet(self.path)
        return self.count()
