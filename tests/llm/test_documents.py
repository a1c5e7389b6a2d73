"""Problems 8, 9, 10."""

import random

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from fernglass.llm import keyword_spam as K
from fernglass.llm import packing as B
from fernglass.llm import tokenizer as T

DOC = "doc_id long, title string, text string, source string, ids string, n_tokens string, x string"
ODD = [None, "", " ", "\n\n", "a\x1cb \x1d c", "  x\n\n y\t z \x85   q", "don't we'll I'M   '  's", "<|endoftext|> hi", "̀́x ½ Ⅳ²", "日本語 テスト　です", "a" * 3000, "ab " * 5000, "🙂🙂 \x00", "Ünïcode naïve—café 123,456"]


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, None, t, (sources or {}).get(i, "h"), "", "", "") for i, t in enumerate(texts)], DOC)


def test_ids_equal_the_public_library(spark):
    ref = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    rng = random.Random(1)
    made = ["".join(rng.choice(" \n\tabcÄé日🙂'.,019") for _ in range(200)) for _ in range(200)]
    texts = ODD + made
    got = {r.doc_id: list(r.ids) for r in T.encode_texts(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (ref.encode(t, add_special_tokens=False).ids if t else [])
    back = {r.doc_id: r.text for r in T.decode_ids(T.encode_texts(docs(spark, texts))).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    n = {r.doc_id: r.n_tokens for r in T.count_tokens(docs(spark, texts)).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert T.encode_texts(docs(spark, [])).collect() == []


def test_other_vocabulary():
    ranks = {t: i for i, t in enumerate(T.read_ranks(f"{T.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"))}
    ref = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = T.Encoder(vocabulary="byte_bpe_multi_50k")
    for t in ODD[1:] + ["Zwei Wörter, три слова"]:
        assert enc.encode(t) == ref.encode_ordinary(t)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 10)
    e = T.Encoder()
    a = [e.encode(f"word{i} and more{i}") for i in range(30)]
    assert len(e.cache) <= 40 and a == [T.encoder().encode(f"word{i} and more{i}") for i in range(30)]


@pytest.mark.parametrize("seed", range(4))
def test_fill_is_optimal(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(6)}
    room = rng.randrange(1, 90)
    reach = {0}
    for n, c in counts.items():
        reach |= {r + n * k for r in reach for k in range(c + 1)}
    got = B.fill(counts, room)
    assert sum(n * k for n, k in got.items()) == max(r for r in reach if r <= room)
    assert all(k <= counts[n] for n, k in got.items())


def test_plan_uses_everything():
    rng = random.Random(9)
    h = {rng.randrange(1, 101): rng.randrange(1, 2000) for _ in range(60)}
    left = dict(h)
    for pattern, times in B.plan(h, 100):
        assert sum(n * k for n, k in pattern.items()) <= 100
        for n, k in pattern.items():
            left[n] -= k * times
    assert not any(left.values()) and B.plan({}, 100) == [] and B.plan({0: 5}, 100) == []


def test_pack(spark):
    rng = random.Random(3)
    sizes = [0, 0, 100, 101, 250, 1] + [rng.randrange(1, 100) for _ in range(400)] + [40] * 600
    counts = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens int")
    out = B.pack(counts, 100, rows_a_part=1).collect()
    room, by = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.size)
        if r.container is not None:
            room[r.container] = room.get(r.container, 0) + r.size
    assert {k: sum(v) for k, v in by.items()} == dict(enumerate(sizes))
    assert max(room.values()) <= 100 and set(room) == set(range(len(room)))
    assert sorted(by[4], reverse=True) == [100, 100, 50] and all(len(v) == 1 for k, v in by.items() if sizes[k] <= 100)
    assert all(r.container is None for r in out if r.size == 0)
    rep = B.fill_report(B.pack(counts, 100)).first()
    assert rep.containers == len(room) and rep.tokens == sum(sizes)
    assert B.pack(counts.limit(0), 100).collect() == [] and B.fill_report(B.pack(counts.limit(0), 100)).first().containers == 0


def page(rng, spam):
    noun = ["lake", "house", "tower", "garden", "river", "song", "opera", "museum", "bridge", "train"]
    if spam == "words":
        k = [f"{a} {b}" for a in ("cheap", "best", "buy") for b in rng.sample(noun, 2)]
        return " ".join(rng.choice(k) for _ in range(60))
    if spam == "links":
        return "\n".join(f"{rng.choice(noun)}: https://www.{rng.choice(noun)}{rng.randrange(99)}.example/?id={i}" for i in range(30))
    if spam == "tags":
        return "\n".join(f"{rng.choice(noun)}-{rng.choice(['deal', 'sale'])}-{rng.randrange(999)}" for i in range(40))
    return " ".join(f"The {rng.choice(noun)} near the {rng.choice(noun)} was built by {rng.choice('ABCDE')}nna in {rng.randrange(1500, 2000)}, and it is still in use." for _ in range(8))


def test_spam_on_held_out_pages(spark):
    rng = random.Random(6)
    kinds = ["", "", "", "words", "links", "tags"]
    truth = [rng.choice(kinds) for _ in range(300)]
    texts = [page(rng, k) for k in truth] + [None, "", "  ", "Why?"]
    d = docs(spark, texts, {i: f"h{i % 7}" for i in range(300)} | {301: None})
    s = {r.doc_id: r for r in K.scored(d, sample=100).collect()}
    assert len(s) == len(texts)
    hit = sum((s[i].score >= K.CUT) == bool(k) for i, k in enumerate(truth))
    assert hit >= 0.98 * len(truth)
    assert all(s[300 + i].page_score == 0 for i in range(3))
    assert K.spam_documents(docs(spark, [])).collect() == []
    assert K.spam_documents(docs(spark, [None, ""])).collect() == []


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = (x[:, 1] > 0.4).astype(float)
    trees, unseen = K.bag(x[:300], y[:300])
    assert ((unseen >= 0.5) == (y[:300] == 1)).mean() > 0.95
    assert ((K.vote(trees, x[300:]) >= 0.5) == (y[300:] == 1)).mean() > 0.97
    assert K.vote([], x).sum() == 0 and K.bag(x[:0], y[:0])[0] == []
    assert K.grow(x[:5], np.ones(5)).predict(x[:2]).tolist() == [1, 1]


def test_hosts_decide_where_pages_do_not():
    rng = np.random.default_rng(1)
    host = rng.choice([-2.0, 2.0], 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-host))).astype(int)
    page = np.where(rng.random(4000) < 0.5, 0.0, np.where(y, 2.0, -2.0))
    w_page, w_host = K.fit_weights(page, host, y)
    assert w_page > 1 and 0.5 < w_host < 1.5
    assert K.fit_weights(page, host, np.ones(4000)) == (1.0, 0.0)
    assert K.fit_weights(page, rng.permutation(host), y)[1] < 0.3


def test_bare_links_are_spam():
    x = np.array([K.features("\n".join(f"https://www.host{i}.test/?id={i}" for i in range(9))), K.features(None), K.features(" \n")])
    assert K.weak_label(x).tolist() == [1, -1, -1] and x[0, K.FEATURES.index("chars")] > 5 and not x[1:].any()
