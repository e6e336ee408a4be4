import hashlib
import random

import numpy as np
import pytest
from helpers import DATA, documents, folder

from threshcast.llm import queries, suffixes


def plain_cut(rows, window):
    """rows: (id, text) in order; removal of covered bytes by remembering every window."""
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            else:
                seen.add(s)
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_query_equals_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest())
            for (i, _), (n, gone, spans, kept) in zip(rows, plain_cut(rows, 100))}
    got = queries.QUERIES["op4_suffix_array_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(got) == len(rows) and sum(r.n_removed for r in got)


@pytest.mark.parametrize("window, seed", [(100, 1), (40, 2), (24, 3), (8, 4)])
def test_random_passages(spark, monkeypatch, window, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(suffixes, "_SLAB", 512)
    word = lambda: "".join(rng.choice("aébc\0") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    passages += ["ab" * 150, "x" * 400, "é" * 90]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(1, len(p))], word()]
        texts.append("".join(parts))
    texts += ["", None, passages[0], passages[0]]
    df = documents(spark, texts)
    got = sorted(suffixes.cut_repeats(df, window).collect(), key=lambda r: r.doc_id)
    want = plain_cut(list(enumerate(texts)), window)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == want


def test_merge_order_and_shared_bytes():
    rng = random.Random(5)
    runs = []
    for _ in range(rng.randint(5, 9)):
        keys = sorted({bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(40)})
        runs.append((keys, suffixes.front_coded(keys)[0]))
    runs.append(([], []))
    out = [(runs[r][0][i], n) for r, i, n in suffixes.merged(runs)]
    keys = [k for k, _ in out]
    assert keys == sorted(k for r in runs for k in r[0])
    for (a, _), (b, n) in zip(out, out[1:]):
        assert n == suffixes.agree(a, b, 0)
    assert list(suffixes.merged([])) == []


def test_hashes_survive_squeezing():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000, np.uint64))
    assert (suffixes.unsqueeze(suffixes.squeeze(x)) == x).all()
    keys = [b"", b"a", b"ab", b"abz", b"b"]
    shared, rest = suffixes.front_coded(keys)
    assert suffixes.front_decoded(np.array(shared), np.array([len(k) for k in keys]), rest) == keys


def test_odd_rows(spark, tmp_path):
    long = "".join(random.Random(1).choices("abcdefgh ", k=200_000))
    texts = [None, "", "short", long, long[5000:9000], "ü" * 300]
    df = documents(spark, texts).withColumnsRenamed({"lang": "kept", "source": "n_bytes"})
    df = df.union(df.where("doc_id = 4")).union(df.where("doc_id = 4").selectExpr("cast(null as long)", "text", "kept", "n_bytes", "n_chars"))
    rows = suffixes.cut_repeats(df, 100).collect()
    by = sorted(((r.doc_id, r.n_removed) for r in rows), key=str)
    assert (4, 4000) in by and by.count((4, 4000)) == 2 and (None, 4000) in by and (3, 0) in by
    assert len(rows) == 8
    stage = suffixes.with_kept_text(df)
    assert stage.columns == df.columns and stage.schema["n_chars"] == df.schema["n_chars"]
    left = {r.doc_id: r for r in stage.collect()}
    assert left[0].text is None and left[4].text == "" and left[4].n_chars == 0
    assert len(left[5].text) in (50, 99, 100) or left[5].text == "ü" * left[5].n_chars
    assert suffixes.cut_repeats(df.limit(0)).collect() == []
    empty = folder(tmp_path, documents=df.limit(0).withColumnsRenamed({"kept": "lang", "n_bytes": "source"}))
    assert queries.QUERIES["op4_suffix_array_dedup"](spark, empty).collect() == []
