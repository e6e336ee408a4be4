"""Ranked search against scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, documents, folder

from threshcast.llm import lexical, queries


def plain_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def plain(docs, items, k=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, gone, i) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if gone else i, -score))
    return sorted(out, key=str)


def ranked(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.rank_documents(d, q, k).collect()), key=str)


def random_texts(n, seed, words=30, most=40):
    draw = random.Random(seed)
    known = [f"w{int(draw.paretovariate(0.7)) % words}" for _ in range(200)] + ["Ünï", "X-y", "é9"]
    return [" ".join(draw.choice(known) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_terms():
    text = "Ab-c9_d\x00é ÀB\x7f\x85你好-Z"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text) == ["ab", "c9", "d", "é", "Àb", "\x85你好", "z"]


def test_range_maxima():
    draw = np.random.default_rng(3)
    shard = lexical.Shard.__new__(lexical.Shard)
    shard.impact = draw.integers(0, 20, 300)
    shard.best = shard._table(300)
    low = draw.integers(0, 299, 500)
    high = np.minimum(300, low + 1 + draw.integers(0, 300, 500))
    for a, b, top in zip(low, high, shard.maxima(low, high)):
        assert top == a + shard.impact[a:b].argmax()


@pytest.mark.parametrize("leaf, shard", [(1, 50), (3, 7), (128, 8192)])
def test_equals_scoring_all(spark, monkeypatch, leaf, shard):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    texts = random_texts(120, 8)
    docs = [(i * 7 % 121, t) for i, t in enumerate(texts)] + [(500 + i, texts[3]) for i in range(30)]
    docs += [(None, texts[5]), (None, texts[5]), (7, texts[9]), (7, "w1 w1"), (900, None), (901, " - "), (902, "w2 " * 5000)]
    items = [(i, t) for i, t in enumerate(random_texts(12, 9, most=12))]
    items += [(50, None), (51, "none of these"), (3, "w1"), (52, "w1 w1 w2"), (None, "w3 Ünï"), (53, texts[3])]
    assert ranked(spark, docs, items) == plain(docs, items)
    assert ranked(spark, docs, items, 3) == plain(docs, items, 3)


def test_searches_skip_what_cannot_win():
    texts = [b"the of " * 3] * 2000 + [b"rare word of"] + [b"of the"] * 2000
    row = lexical._index_row(list(range(len(texts))), texts)
    terms = {b"the": 10, b"of": 5, b"rare": 8000, b"word": 8000}
    shard, best, scored = lexical.Shard(row, terms, 4001, 20003), lexical.Best(1), []
    shard.scores, whole = lambda *a: scored.append(a[-1] - a[-2]) or whole(*a), shard.scores
    lexical.search(shard, Counter([b"rare", b"word", b"of"]), best)
    assert best.heap[0][2] == -2000 and sum(scored) <= lexical.LEAF


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    docs, items = list(enumerate(random_texts(40, 1))), list(enumerate(random_texts(9, 2)))
    assert ranked(spark, docs, items) == plain(docs, items)


def test_odd_tables(spark):
    df = documents(spark, [None, "", "-"])
    items = spark.createDataFrame([(1, "a", 2)], "item_id long, text string, score int")
    assert lexical.rank_documents(df, items).collect() == []
    assert lexical.rank_documents(df.filter("false"), items).collect() == []
    some = documents(spark, ["a b", "c"]).selectExpr("*", "1 as n_docs", "2 as terms", "3 as score")
    assert lexical.rank_documents(some, items.filter("false")).collect() == []
    assert [r.doc_id for r in lexical.rank_documents(some, items).collect()] == [0]


def test_query_equals_plain(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = queries.QUERIES["op11_ranked_lexical_search"](spark, folder(tmp_path, documents=docs, benchmark=items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
