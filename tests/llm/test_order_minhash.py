import hashlib
import random
import re

import xxhash
from helpers import DATA, documents

from threshcast.llm import order_minhash, queries


def plain_edits(rows):
    """rows: (id, text) with different ids."""
    rows = sorted(rows, reverse=True)
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 2
        out[doc] = text[: len(text) - n] + other[:n]
    return out


def test_query_against_plain_edits(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    edits = plain_edits(texts.items())
    rows = queries.QUERIES["op10_document_fingerprints"](spark, DATA).collect()
    assert len(rows) == len(texts)
    prints = {r.doc_id: r.fingerprint for r in rows}
    order = sorted(texts, reverse=True)
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id] or "")
        assert r.edited_sha256 == hashlib.sha256(edits[r.doc_id].encode()).hexdigest()
        nxt = order[(order.index(r.doc_id) + 1) % len(order)]
        assert abs(r.near_next - plain_likeness(prints[r.doc_id], prints[nxt])) < 1e-12
        assert abs(r.near_edited - plain_likeness(prints[r.doc_id], r.edited_fingerprint)) < 1e-12
    mean = lambda name: sum(r[name] for r in rows) / len(rows)
    assert mean("near_edited") > 0.08 and mean("near_next") < 0.05
    by_text = {}
    for doc, text in texts.items():
        assert by_text.setdefault(text, prints[doc]) == prints[doc]


def plain_likeness(a, b):
    cut = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    a, b = cut(a), cut(b)
    return len(a & b) / max(len(a), len(b)) if a or b else 1.0


def plain_pieces(text):
    out = []
    for run in re.findall("[^\x20\x09-\x0d]{1,4096}", text):
        if len(run) <= 12:
            out.append(run)
            continue
        piece = ""
        for i, c in enumerate(run):
            piece += c
            seed = xxhash.xxh64_intdigest(run[i - 1].encode(), 42) if i else 42
            if len(piece) == 12 or xxhash.xxh64_intdigest(c.encode(), seed) % 4 == 0:
                out.append(piece)
                piece = ""
        out += [piece] if piece else []
    return out


def signatures(spark, texts):
    df = documents(spark, texts)
    return {r.doc_id: r.sig for r in order_minhash.with_signature(df, "text", "sig").select("doc_id", "sig").collect()}


def test_steps_equal_plain_steps(spark):
    """Occurrence numbers, minima and text order as written out in Python on Spark's own hashes."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("ab c dd eee".split(), k=rng.randint(0, 80))) for _ in range(20)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(500)), "same " * 700, "x" * 50_000, "", "one"]
    texts += ["".join(rng.choices("你好abcÜ🙂", k=6000)), "abcdefghijklm nopqrstuvwxyzabcdefghij"]
    df = documents(spark, texts)
    got = df.select("doc_id", "text", order_minhash.pieces_of(df.text).alias("p"))
    got = got.withColumn("g", order_minhash.grams(got.p))
    got = got.withColumn("n", order_minhash.numbered(got.g))
    for r in got.collect():
        pieces = plain_pieces(r.text)
        assert r.p == pieces
        assert len(r.g) == (len(pieces) if len(pieces) < 2 else len(pieces) - 1)
        at = {x & (1 << 24) - 1: x >> 24 for x in r.g}
        count, copies = {}, {}
        for place in sorted(at):
            copies[place] = count.get(at[place], 0)
            count[at[place]] = copies[place] + 1
        names = {}
        for x in r.n:
            place = x & (1 << 24) - 1
            names.setdefault(x >> 24, set()).add((at[place], copies[place]))
        assert all(len(v) == 1 for v in names.values()) and len(names) == len(r.n)


def test_order_and_edits_matter(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    small = list(words)
    small[10] = "other"
    got = signatures(spark, [" ".join(words), " ".join(turned), " ".join(small), " ".join(rng.sample(words, 400)), " ".join(words)])
    near = lambda a, b: len(set(got[a]) & set(got[b])) / max(len(got[a]), len(got[b]))
    assert got[0] == got[4] and near(0, 2) > 0.9 and 0.3 < near(0, 1) < 0.8 and near(0, 3) < 0.2
    assert len(got[0]) == order_minhash.BUCKETS


def test_odd_rows(spark):
    texts = [None, "", "a", "b c", "é" * 11, "z " * 30_000]
    df = documents(spark, texts).withColumnsRenamed({"lang": "sig", "source": "edited"})
    twice = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 4").selectExpr("cast(null as long)", "text", "sig", "edited", "n_chars"))
    rows = order_minhash.compare_edited(twice).collect()
    assert len(rows) == 8
    edits = plain_edits(enumerate(texts))
    for r in rows:
        want = edits[r.doc_id] if r.doc_id is not None else "é" * 6
        assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = order_minhash.compare_edited(df.where("doc_id = 3")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"b b").hexdigest()
    assert order_minhash.compare_edited(df.limit(0)).collect() == []


def test_texts_without_blanks(spark):
    """A character put in moves the pieces around it only; the boundaries are those of the content."""
    rng = random.Random(9)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000))
    code = "".join(rng.choices("abcdef0123456789+/=", k=9000))
    texts = []
    for text in (han, code):
        texts += [text, "X" + text, text[:1500] + "的" + text[1500:], text[:700] + text[701:]]
    found = signatures(spark, texts)
    for low in (0, 4):
        for i in range(1, 4):
            a, b = set(found[low]), set(found[low + i])
            assert len(a & b) / max(len(a), len(b)) > 0.8
    assert not set(found[0]) & set(found[4])


def test_step_names_never_clash(spark):
    df = documents(spark, ["a b c", None]).selectExpr("*", "1 as _step0", "2 as _pieces", "3 as _STEP2")
    out = order_minhash.with_signature(df, "text", "sig")
    assert out.columns == [*df.columns, "sig"]
    assert {(r._step0, r._pieces) for r in out.collect()} == {(1, 2)}
