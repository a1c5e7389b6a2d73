"""Problem 10: pages of repeated keywords, link lists and product tags.

Every document gets features of its content and links. Clear cases are labelled
weakly by four of them; bagged decision trees see all and are fitted to a bounded
sample of those labels, and score every document, unclear cases included. A page's
log-odds are then moved by those of its host's spam rate. How far is fitted, too:
on the labelled sample, with votes of trees that haven't seen the page and host
rates that leave it out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm.tokenizer import no_collection
from fernglass.runtime import if_small, materialize

SAMPLE = 20_000  # weakly labelled documents the trees are fitted to, at most
TREES, DEPTH, LEAF = 25, 6, 5
PRIOR = 20  # pages of the overall rate that every host is given
LEAST_ODDS = 0.5 / TREES  # a share of votes counts as at least this, and as at most 1 less this
CUT = 0.5

FEATURES = ("prose", "links", "repeats", "distinct", "top", "digits", "tags", "separators", "function", "capitals", "size", "stops", "unit", "chars")

# Frequent function words of the languages met.
FUNCTION_WORDS = set(
    "the of and a an in to is was were by for from with at on as its it that which who this be are had has not or he she they their his her "
    "der die das und ein eine einer im in von zu den dem des ist war wurde mit auf für nach erst als sich "
    "le la les de du des et un une en est fut au aux dans par pour sur que qui ne son sa ses il elle "
    "el los las del y una se por con su para fue es lo al como más "
    "и в на не с по из к что это был была было для от до после здесь".split()
)
_LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}/\S*", re.I | re.S)
_TAG = re.compile(r"\b[^\W\d_]+-[^\W\d_]+-\d+\b|\bSKU\w*|\b\d+\.\d\d\b")
_UNIT = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_WORD = re.compile(r"\w+")


def features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES``; all 0 for a null or blank text."""
    if not text or text.isspace():
        return [0.0] * len(FEATURES)
    size = len(text)
    links = _LINK.findall(text)
    linked = sum(map(len, links))
    body = _LINK.sub(" ", text) if links else text
    units = [u for u in _UNIT.split(body) if u]
    prose = 0
    for u in units:
        u = u.strip()
        if u and u[-1] in ".!?。！？»”\")>":
            # a sentence has some words, or one that only sentences have; scripts without blanks are told by length
            parts = u.lower().split()
            if 5 <= len(parts) <= 60 or len(parts) < 5 and (not FUNCTION_WORDS.isdisjoint(parts) or u[0] >= "\u3000" and len(u) >= 8):
                prose += len(u)
    words = _WORD.findall(body.lower())
    n = len(words)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    repeated = sum(c for c in pairs.values() if c >= 3)
    stops = sum(map(body.count, ".!?。！？"))
    seps = body.count(",") + body.count("|") + body.count("\n") + body.count(";")
    w = max(1, n)
    tags = sum(map(len, _TAG.findall(body)))
    return [
        prose / size,
        linked / size,
        repeated / max(1, n - 1),
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(map(str.isdigit, body)) / size if n < 50 else len("".join(re.findall(r"\d+", body))) / size,
        tags / size,
        seps / w,
        sum(counts[x] for x in counts.keys() & FUNCTION_WORDS) / w,
        len(re.findall(r"\b[A-ZА-Я]{2,}\b", body)) / w,
        math.log1p(n),
        stops / w,
        w / max(1, len(units)),
        math.log1p(size),
    ]


def weak_label(x: np.ndarray) -> np.ndarray:
    """1 for clear spam, 0 for clear prose, -1 for neither, by rows of features.

    Only the shares of sentences, links, repeated pairs of words and tags tell; the
    trees see the other features as well, and decide where these don't.
    """
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    spam = (f["prose"] < 0.25) & ((f["links"] > 0.5) | (f["repeats"] > 0.4) | (f["tags"] > 0.15))
    clean = (f["prose"] > 0.7) & (f["links"] < 0.2) & (f["tags"] < 0.05)
    return np.where(spam, 1, np.where(clean, 0, -1))


@dataclass
class Tree:
    """A binary tree in arrays: feature (-1 at a leaf), threshold, left and right child, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(64):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
        return self.value[at]


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> Tree:
    """A tree by the Gini impurity; a split keeps at least ``leaf`` rows on either side."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, d: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if d == 0 or len(rows) < 2 * leaf or nodes[me][4] in (0.0, 1.0):
            return me
        best = (-1e-12, -1, 0.0)
        n, total = len(rows), y[rows].sum()
        for j in range(x.shape[1]):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            v, s = v[order], np.cumsum(y[rows][order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= leaf) & (n - k >= leaf)
            if not ok.any():
                continue
            a, b = s[:-1], total - s[:-1]
            gain = np.where(ok, a * a / k + (k - a) ** 2 / k + b * b / (n - k) + (n - k - b) ** 2 / (n - k), -np.inf)
            i = int(gain.argmax())
            score = gain[i] - (total**2 + (n - total) ** 2) / n
            if score > best[0] + 1e-9:
                best = (score, j, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return me
        goes = x[rows, best[1]] <= best[2]
        nodes[me][:2] = [best[1], best[2]]
        nodes[me][2] = build(rows[goes], d - 1)
        nodes[me][3] = build(rows[~goes], d - 1)
        return me

    build(np.arange(len(y)), depth)
    a = np.array(nodes, float)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])


def bag(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 0) -> tuple[list[Tree], np.ndarray]:
    """(trees on bootstrap samples, each row's share of votes among the trees that haven't seen it; NaN if all have).

    Without rows there is no tree, with one class every tree is a leaf.
    """
    rng = np.random.default_rng(seed)
    out: list[Tree] = []
    votes, voters = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(trees if len(y) else 0):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows].astype(float)))
        left = np.ones(len(y), bool)
        left[rows] = False
        votes[left] += out[-1].predict(x[left])
        voters += left
    return out, votes / np.where(voters, voters, np.nan)


def vote(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([t.predict(x) for t in trees], axis=0) if trees else np.zeros(len(x))


def logit(p):
    p = np.clip(p, LEAST_ODDS, 1 - LEAST_ODDS)
    return np.log(p / (1 - p))


def fit_weights(page: np.ndarray, host: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """(weight of the page's log-odds, weight of the host's) of a logistic regression without intercept; (1, 0) where a class is missing."""
    ok = np.isfinite(page) & np.isfinite(host)
    if not ok.any() or len(set(y[ok])) < 2:
        return 1.0, 0.0
    z, t, w = np.column_stack([page, host])[ok], y[ok].astype(float), np.array([1.0, 0.0])
    start = w.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(2), z.T @ (p - t) + ridge * (w - start))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def document_features(documents: DataFrame) -> DataFrame:
    """(doc_id, host, x, weak): the features of every document, and its weak label (null for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                with no_collection():
                    x = np.array([features(t) for t in b.column(2).to_pylist()]).reshape(-1, len(FEATURES))
                weak = weak_label(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(weak.astype(np.int32), mask=weak < 0)], names=["doc_id", "host", "x", "weak"])

    return documents.select("doc_id", F.col("source").alias("host"), "text").mapInArrow(run, "doc_id long, host string, x array<float>, weak int")


def labelled(featured: DataFrame, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """About ``sample`` weakly labelled rows, and never more.

    With more than that, the documents whose hashed id falls below the wanted
    share are taken, so that what reaches the driver doesn't depend on the number
    of partitions.
    """
    weak = featured.where("weak is not null")
    n = weak.count()
    share = 1.0 if n <= sample else 0.98 * sample / n
    h = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    return weak.where(h < int(share * (1 << 30))).limit(sample)


def scored(documents: DataFrame, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(doc_id, page_score, host_rate, score): one row a document.

    ``host_rate`` is the share of spam among the host's other pages by their own
    scores, drawn towards the overall rate where the host has few. ``score`` is the
    probability after the host's log-odds have moved the page's. Null and blank
    texts score 0; pages without a host form one group.
    """
    featured = materialize(document_features(documents))
    known = labelled(featured, sample, seed).select("doc_id", "host", "x", "weak").toPandas().sort_values("doc_id")
    x = np.stack(known.x.to_numpy()).astype(np.float64) if len(known) else np.zeros((0, len(FEATURES)))
    y = known.weak.to_numpy()
    trees, unseen = bag(x, y, seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten(), np.float64).reshape(-1, len(FEATURES))
            p = np.where(x[:, FEATURES.index("chars")] > 0, vote(trees, x), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], names=["doc_id", "host", "page_score"])

    pages = materialize(featured.select("doc_id", "host", "x").mapInArrow(run, "doc_id long, host string, page_score double"))
    spam = F.when(F.col("page_score") >= CUT, 1).otherwise(0)
    total = pages.agg(F.coalesce(F.avg(spam), F.lit(0.0)).alias("overall")).collect()[0].overall
    hosts = materialize(pages.groupBy(F.col("host").alias("h")).agg(F.sum(spam).alias("s"), F.count(F.lit(1)).alias("n")))
    # the host's other pages: a page's own score counts once, with its own weight
    rate = (F.col("s") - spam + PRIOR * F.lit(total)) / (F.col("n") - 1 + PRIOR)
    rated = pages.join(if_small(hosts), F.col("host").eqNullSafe(F.col("h"))).select("doc_id", "page_score", rate.alias("host_rate"))

    held = labelled(featured, sample, seed).select("doc_id").join(rated, "doc_id").select("doc_id", "host_rate").toPandas().sort_values("doc_id")
    w_page, w_host = fit_weights(logit(unseen), logit(held.host_rate.to_numpy(float)) - logit(total), y) if len(held) == len(known) else (1.0, 0.0)

    odds = lambda p: F.ln(F.greatest(F.least(p, F.lit(1 - LEAST_ODDS)), F.lit(LEAST_ODDS))) - F.ln(1 - F.greatest(F.least(p, F.lit(1 - LEAST_ODDS)), F.lit(LEAST_ODDS)))
    moved = w_page * odds(F.col("page_score")) + w_host * (odds(F.col("host_rate")) - float(logit(total)))
    # a page without any vote for spam (a blank one, for instance) has nothing a host could confirm
    score = F.when(F.col("page_score") > 0, 1 / (1 + F.exp(-moved))).otherwise(0.0)
    return rated.select("doc_id", "page_score", "host_rate", score.alias("score"))


def spam_documents(documents: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id): the documents whose smoothed score reaches ``cut``."""
    return scored(documents).where(F.col("score") >= cut).select("doc_id")
