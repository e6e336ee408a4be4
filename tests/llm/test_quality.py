import random
import re

import numpy as np
from helpers import DATA, documents
from pyspark.sql import functions as F

from threshcast.llm import quality, queries


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit))


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_quality_rules"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_counts_of_odd_texts(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(quality, "_SLAB", 64)
    texts = ["", "\n \n\x0b\n", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 100, "l\nl\n l\nl \n\nl", "é\x85ü　ß # a|b <x>"]
    texts += [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(100)]
    texts += ["\n".join(rng.choices(["one two", "", " ", "three"], k=30)) for _ in range(20)]
    assert [tuple(r) for r in quality.text_counts(texts).tolist()] == [plain_counts(t) for t in texts]


def vectors(spark, x, groups):
    cols = ", ".join(f"x{i} double" for i in range(4))
    rows = [(g, *map(float, v)) for g, v in zip(groups, x)]
    return spark.createDataFrame(rows, f"group string, {cols}").repartition(3)


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(4, 4)) + 2 * np.eye(4)
    clean = rng.normal(size=(800, 4)) @ mix.T + [1, 2, 3, 4]
    bad = rng.normal(size=(150, 4)) * 0.2 + [40, -30, 25, 60]
    x = np.concatenate([clean, bad])
    params = quality.fit_groups(vectors(spark, x, ["g"] * len(x))).collect()[0]
    true = mix @ mix.T
    assert np.abs(np.array(params.centre) - [1, 2, 3, 4]).max() < 0.5
    found = np.linalg.inv(np.array(params.precision).reshape(4, 4))
    assert np.all(np.abs(np.log(np.linalg.eigvalsh(found) / np.linalg.eigvalsh(true))) < 0.6)
    gap = x - np.array(params.centre)
    d2 = np.einsum("ij,jk,ik->i", gap, np.array(params.precision).reshape(4, 4), gap)
    assert (d2[800:] > quality.chi_square_above(1e-6, 4)).all()
    assert (d2[:800] < quality.chi_square_above(1e-6, 4)).mean() > 0.99


def test_steps_do_not_raise_the_determinant(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_t(2, size=(600, 4))
    rows = vectors(spark, x, ["a", "b", "c"] * 200)
    first = quality.fit_groups.__globals__["STEPS"]
    assert first > 1
    logs = []
    params = quality.fit_groups(rows).cache()
    for _ in range(2):
        params = quality._concentrated(rows, params)
        logs.append(params.agg(F.sum("log_det")).first()[0])
    assert logs[1] <= logs[0] + 0.02 * 3


def test_quantile_by_hand():
    assert abs(quality.chi_square_above(0.5, 4) - 3.3567) < 1e-3
    assert abs(quality.chi_square_above(0.05, 2) - 5.9915) < 1e-3


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(8)
    junk = [" ".join("#|<>$%&*"[rng.randrange(8)] * 40 + str(rng.random()) for _ in range(60)) for _ in range(12)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").union(documents(spark, junk, start=10**6))
    rows = quality.judge(both).collect()
    assert not any(r.kept for r in rows if r.doc_id >= 10**6)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for quality_label, share in ((1, 0.99), (0, 0.2)):
        held = [r.kept for r in rows if labels.get(r.doc_id) == quality_label and not r.base_failed]
        assert sum(held) >= share * len(held) if quality_label else sum(held) <= share * len(held)


def test_odd_rows(spark, monkeypatch):
    texts = [None, "", "word " * 3, *[" ".join(f"w{(i * 7 + j) % 97}" for j in range(50)) for i in range(6)], "z" * 100_000]
    df = documents(spark, texts).withColumn("group", F.lit(1)).withColumn("d2", F.lit("x"))
    df = df.union(df.where("doc_id = 4")).union(df.where("doc_id = 4").withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")}))
    df = df.union(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    few = quality.judge(df).collect()
    assert len(few) == len(texts) + 3 and all(r.distance is None for r in few)
    monkeypatch.setattr(quality, "LEAST_ROWS", 3)
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts) + 3 and sum(r.kept for r in rows) >= 9
    assert [r.base_failed for r in sorted(rows, key=lambda r: -1 if r.doc_id is None else r.doc_id) if r.doc_id in (0, 1, 2)] == [True] * 3
    assert quality.judge(df.limit(0)).collect() == []
