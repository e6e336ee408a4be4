"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, documents, folder

from threshcast.llm import phrases, queries


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low) if (w := [x for x in re.split(r"[ \t]+", piece) if x])]


def plain(rows, longest=3, least=10, top=2000, inside=50):
    counts, totals = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in plain_words(text):
            totals[lang or "und"] += len(piece)
            for k in range(1, longest + 1):
                f.update(tuple(piece[i : i + k]) for i in range(len(piece) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if p in covered and 100 * covered[p] >= inside * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def random_texts(n, seed, letters="abcd", most=60):
    draw = random.Random(seed)
    ends = [" "] * 8 + [". ", ", ", "\n", "\t", "  ", "!"]
    return ["".join(draw.choice(letters) * draw.randint(1, 2) + draw.choice(ends) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_automaton_keeps_all_weights():
    draw = np.random.default_rng(4)
    for size in (1, 3, 50):
        for _ in range(30):
            ids = draw.integers(0, size + 1, draw.integers(0, 200))
            parts, weights = phrases.summed(*_ones(phrases.grams_of(ids, 3)), size)
            known = [b"w%03d" % i for i in range(size)]
            made = phrases.Counts.build(known, parts, weights)
            again = phrases.Counts.load(made.dump())
            got_parts, got_weights = phrases.summed(*again.grams(), size)
            assert all((a == b).all() for a, b in zip(parts, got_parts)) and (weights == got_weights).all()
            flat = phrases.Counts.build(known, parts, weights, share=False)
            assert sum(len(x.label) for x in made.layers) <= sum(len(x.label) for x in flat.layers)
            want = Counter()
            for row, n in zip(zip(*parts), weights):
                row = [i for i in row if i]
                for k in range(1, len(row) + 1):
                    want[tuple(row[:k])] += n
            asked = [*want, (1, 1, 1), (size,)]
            found = made.compose([[known[i - 1] for i in p] for p in asked] + [[b"no"], [known[0], b"no"]])
            assert found.tolist() == [want[p] for p in asked] + [0, 0]


def _ones(parts):
    return parts, np.ones(len(parts[0]), np.int64)


def test_union_sums_weights():
    texts = [t.encode() for t in random_texts(40, 1)]
    whole = dict(phrases.shard(texts, 3, []))[0]
    parts = [dict(phrases.shard(texts[i::3], 3, []))[0] for i in range(3)]
    united = phrases.union(parts)
    assert united.words == whole.words
    for a, b in zip(phrases.summed(*united.grams(), 99)[0], phrases.summed(*whole.grams(), 99)[0]):
        assert (a == b).all()


def test_ranges_part_ngrams():
    texts = [t.encode() for t in random_texts(60, 2)]
    cuts = [(b"a", b"b"), (b"a", b"bb", b"c"), (b"aaa",), (b"b", b"a", b"d"), (b"c",), (b"zz",)]
    grams = set()
    for number, found in phrases.shard(texts, 3, cuts):
        for row in zip(*found.grams()[0]):
            gram = tuple(found.words[i - 1] for i in row if i)
            assert phrases.route(cuts, gram) == number
            assert gram not in grams
            grams.add(gram)
    [whole] = [f for _, f in phrases.shard(texts, 3, [])]
    assert len(grams) == len(whole.grams()[1])


def test_states_are_shared():
    text = " ".join(f"x{i} of the end." for i in range(50)).encode()
    [(_, made)] = phrases.shard([text], 3, [])
    assert len(made.layers[1].label) < 10  # "of the" behind fifty words is one state


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_counting(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
        monkeypatch.setattr(phrases, "RANGE_BYTES", 700)
        monkeypatch.setattr(phrases, "REQUESTS", 7)
    texts = [*random_texts(150, 3), None, "", "  .", "the end of the end " * 200, "a" * 5000, "é ö é ö. " * 12]
    langs = ["en", "de", None]
    rows = [(langs[i % 3], t) for i, t in enumerate(texts)] + [("en", texts[0])] * 5
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert rows_of(df) == plain(rows)
    assert rows_of(df, longest=4, least=3, top=20, inside=80) == plain(rows, 4, 3, 20, 80)


def test_odd_tables(spark):
    df = documents(spark, [None, "", "one two"], lang=None)
    assert rows_of(df) == [] and rows_of(df.filter("false")) == []
    extra = documents(spark, ["of the " * 30]).selectExpr("*", "1 as a", "2 as l", "3 as words", "4 as phrase", "5 as range")
    assert rows_of(extra) == plain([("en", "of the " * 30)])
    with pytest.raises(ValueError):
        phrases.collocations(df, longest=1)


def test_query_equals_plain(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = queries.QUERIES["op13_phrase_collocations"](spark, folder(tmp_path, documents=docs))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)
