"""Problem 6: one form for text that looks the same but differs in its characters.

The corpus's own clean tokens are the vocabulary, as they are spelled. Tokens with
characters outside ASCII are looked up in tries over it by a weighted edit
automaton that reads their raw characters: a look-alike of a letter, a
compatibility form, a composed or decomposed mark, and an invisible character are
arcs that cost nothing, and any other edit costs one. Of the spellings within cost
0 the most frequent is chosen. A token that no vocabulary entry matches is
normalised by the table of :mod:`fernglass.llm.lookalike`.

Tries are built per bucket of what no free arc changes (how many characters are
visible, and what the first three look like), so none holds the whole vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.llm.lookalike import LOOKALIKE, fold, ignorable
from fernglass.runtime import if_small, materialize

TOKENS_A_TRIE = 20_000  # entries and tokens, on the average
NOT_ASCII = r"[^\x00-\x7F]"
_BLANK = re.compile(r"(\s+)")
BLANKS = r"[ \t\n\x0b\f\r]+"


def plain_form(value: Column) -> Column:
    """The form of an ASCII value: blanks collapsed."""
    return F.trim(F.regexp_replace(value, BLANKS, " "))


def split(value: str) -> list[str]:
    """Tokens and the blanks between them, by turns, beginning and ending with a (maybe empty) token."""
    return _BLANK.split(value)


def is_clean(token: str) -> bool:
    """Whether a token is a spelling to choose: composed, nothing invisible, and of one script.

    A token with letters of another script is of that script if it has a letter
    without a Latin look-alike and no Latin one.
    """
    if token.isascii():
        return True
    if any(map(ignorable, token)) or unicodedata.normalize("NFKC", token) != token:
        return False
    if fold(token) == token:
        return True
    letters = [c for c in unicodedata.normalize("NFD", token) if c.isalpha()]
    latin = any("LATIN" in unicodedata.name(c, "") for c in letters)
    return not latin and any(c not in LOOKALIKE for c in letters)


_LOOKS: dict[str, str] = {}


def looks(c: str) -> str:
    """What a character looks like: a string of letters and marks, empty if it is invisible."""
    got = _LOOKS.get(c)
    if got is None:
        if len(_LOOKS) > 1 << 16:
            _LOOKS.clear()
        got = _LOOKS[c] = "" if ignorable(c) else unicodedata.normalize("NFD", fold(c))
    return got


def visible(token: str) -> str:
    """What stays the same along free arcs, for bucketing: the number of visible characters and what the first three look like."""
    shape = token if token.isascii() else "".join(map(looks, unicodedata.normalize("NFD", token)))
    return f"{len(shape)} {shape[:3]}"


class Trie:
    """Vocabulary entries by the characters of their spelling, marks apart from letters."""

    def __init__(self) -> None:
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, str]] = {}  # node: (-count, spelling), the least is chosen

    def add(self, spelling: str, count: int) -> None:
        at = 0
        for c in unicodedata.normalize("NFD", spelling):
            nxt = self.nodes[at].get(c)
            if nxt is None:
                nxt = self.nodes[at][c] = len(self.nodes)
                self.nodes.append({})
            at = nxt
        # an ASCII spelling stands for all that look like it
        entry = (-(1 << 62) if spelling.isascii() else -count, spelling)
        self.ends[at] = min(self.ends.get(at, entry), entry)

    def match(self, token: str, budget: int = 0) -> str | None:
        """The spelling reached at the least cost, at most ``budget``; ties go to the most frequent, then the smallest.

        A state is a node with the cost so far. An invisible character leaves the
        states as they are; any other moves them, for nothing, along every arc whose
        character looks like it (one that stands for several, along as many arcs).
        Within the budget, states also skip a character, take one that isn't there,
        or exchange one, at cost 1 each.
        """
        states = self._closure({0: 0}, budget)
        for c in unicodedata.normalize("NFD", token):
            for shape in looks(c):
                step: dict[int, int] = {}
                for node, cost in states.items():
                    for other, child in self.nodes[node].items():
                        new = cost + (looks(other) != shape)
                        if new <= step.get(child, budget):
                            step[child] = new
                    if cost < step.get(node, budget):
                        step[node] = cost + 1
                states = self._closure(step, budget)
                if not states:
                    return None
        found = [(cost, *self.ends[node]) for node, cost in states.items() if node in self.ends]
        return min(found)[2] if found else None

    def _closure(self, states: dict[int, int], budget: int) -> dict[int, int]:
        """With the states reached by characters of the vocabulary that the token lacks."""
        if not budget:
            return states
        todo = list(states)
        while todo:
            node = todo.pop()
            if (cost := states[node] + 1) <= budget:
                for child in self.nodes[node].values():
                    if cost < states.get(child, budget + 1):
                        states[child] = cost
                        todo.append(child)
        return states


def vocabulary(values: DataFrame) -> DataFrame:
    """(spelling, shape, n): the clean tokens of a column ``value`` with their counts, and what buckets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter()
            for v in b.column(0).to_pylist():
                n.update(v.split())
            kept = [(t, visible(t), c) for t, c in n.items() if is_clean(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.string()), pa.array([k[2] for k in kept], pa.int64())], names=["spelling", "shape", "n"])

    counted = values.where("value is not null").select("value").mapInArrow(run, "spelling string, shape string, n long")
    return counted.groupBy("shape", "spelling").agg(F.sum("n").alias("n"))


def odd_tokens(values: DataFrame) -> DataFrame:
    """(vid, token, shape): the tokens outside ASCII of each (vid, value), once a value, and what buckets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vid, token = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in {t for t in split(v)[::2] if not t.isascii()}:
                    vid.append(i)
                    token.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(vid, pa.string()), pa.array(token, pa.string()), pa.array([visible(t) for t in token], pa.string())], names=["vid", "token", "shape"])

    return values.select("vid", "value").mapInArrow(run, "vid string, token string, shape string")


def spellings(tokens: DataFrame, vocab: DataFrame, budget: int = 0, per_trie: int = TOKENS_A_TRIE) -> DataFrame:
    """(token, form): each distinct token with the spelling chosen for it."""
    distinct = materialize(tokens.select("token", "shape").distinct())
    shapes = materialize(distinct.select("shape").distinct())
    entries = materialize(vocab.join(if_small(shapes), "shape", "left_semi"))
    buckets = max(8, -(-(distinct.count() + entries.count()) // per_trie))
    rows = distinct.select("shape", "token", F.lit(0).cast("long").alias("n")).unionByName(entries.select("shape", F.col("spelling").alias("token"), "n"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("shape"), F.lit(buckets)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        known = pdf.n > 0
        for t, n in zip(pdf.token[known], pdf.n[known], strict=True):
            trie.add(t, n)
        odd = pdf.token[~known].tolist()
        return pd.DataFrame({"token": odd, "form": [trie.match(t, budget) or fold(t) for t in odd]}, dtype=object)

    return rows.groupBy("bucket").applyInPandas(run, "token string, form string")


def visual_forms(values: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(vid, form): one form for every distinct (vid, value) whose value has characters outside ASCII.

    All other values have the form of :func:`plain_form`. ``context`` (value) gives
    the vocabulary, by default ``values`` themselves. Every kind of blank is one, and
    a run of blanks looks like one blank; none stay at the ends. Invisible characters
    around blanks vanish with the token they make up.
    """
    odd = values.where(F.col("value").rlike(NOT_ASCII)).dropDuplicates(["vid"])
    tokens = materialize(odd_tokens(odd))
    chosen = spellings(tokens, vocabulary(values if context is None else context))
    per = tokens.join(chosen, "token").groupBy("vid").agg(F.collect_list(F.struct("token", "form")).alias("map"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                form = {x["token"]: x["form"] for x in m or ()}
                parts = split(v)
                parts[::2] = [form.get(t, t) for t in parts[::2]]
                out.append(" ".join(p for p in parts[::2] if p))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["vid", "form"])

    return odd.join(per, "vid", "left").select("vid", "value", "map").mapInArrow(run, "vid string, form string")


def fields(passages: DataFrame, triples: DataFrame) -> DataFrame:
    """(field, key, value): titles and texts of passages by id, and distinct subjects, which are their own key. Nulls leave."""
    two = F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("text").alias("field"), F.col("text").alias("value"))))
    p = passages.where("passage_id is not null").select(F.col("passage_id").alias("key"), two.alias("f")).select("f.field", "key", "f.value")
    s = triples.select(F.col("subject").alias("value")).distinct().select(F.lit("subject").alias("field"), F.col("value").alias("key"), "value")
    return p.unionByName(s).where("value is not null")


def look_alike_pairs(passages: DataFrame, triples: DataFrame, expanded: int | None = None) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: values that differ as strings and look the same.

    Groups of identical values are paired in full; only where ``expanded`` is given,
    two that make more pairs are not: each key of one meets the other's smallest.
    Nulls look like nothing; repeated rows and repeated ids change nothing.
    """
    values = materialize(fields(passages, triples).select("field", "key", "value", F.md5("value").alias("vid")))
    forms = materialize(visual_forms(values).select("vid", F.md5("form").alias("form")))
    # two ASCII values look the same only if blanks tell them apart, so others need the company of a form that isn't ASCII
    ascii_ = values.where(~F.col("value").rlike(NOT_ASCII)).select("field", "key", "vid", F.md5(plain_form(F.col("value"))).alias("form"))
    wanted = materialize(forms.select("form").unionByName(ascii_.where("form <> vid").select("form")).distinct())
    plain = ascii_.join(if_small(wanted), "form", "left_semi")
    odd = values.select("field", "key", "vid").join(if_small(forms), "vid")
    rows = plain.select("field", "form", "vid", "key").unionByName(odd.select("field", "form", "vid", "key")).distinct()
    rows = materialize(rows)
    several = rows.groupBy("field", "form").agg(F.min("vid").alias("lo"), F.max("vid").alias("hi")).where("lo < hi").select("field", "form")
    rows = materialize(rows.join(several, ["field", "form"], "left_semi"))
    groups = rows.groupBy("field", "form", "vid").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    both = groups.alias("a").join(groups.alias("b"), ["field", "form"]).where("a.vid < b.vid").select("field", "form", F.col("a.vid").alias("va"), F.col("b.vid").alias("vb"), F.col("a.first").alias("fa"), F.col("b.first").alias("fb"), (F.lit(True) if expanded is None else F.col("a.n") * F.col("b.n") <= expanded).alias("full"))
    member = lambda v, k: rows.select("field", "form", F.col("vid").alias(v), F.col("key").alias(k))
    full = both.where("full").join(member("va", "x"), ["field", "form", "va"]).join(member("vb", "y"), ["field", "form", "vb"]).select("field", "x", "y")
    one = both.where("not full").join(member("va", "x"), ["field", "form", "va"]).select("field", "x", F.col("fb").alias("y"))
    two = both.where("not full").join(member("vb", "y"), ["field", "form", "vb"]).select("field", F.col("fa").alias("x"), "y")
    return full.unionByName(one).unionByName(two).where("x <> y").select("field", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def all_forms(passages: DataFrame, triples: DataFrame) -> DataFrame:
    """(field, key, form): the one form of every title, text and distinct subject that isn't null."""
    values = materialize(fields(passages, triples).select("field", "key", "value", F.md5("value").alias("vid")))
    forms = visual_forms(values)
    return values.join(forms, "vid", "left").select("field", "key", F.coalesce(F.col("form"), plain_form(F.col("value"))).alias("form")).distinct()
