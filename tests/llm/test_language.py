import numpy as np
import pytest
from helpers import DATA, documents
from pyspark.sql import functions as F

from threshcast.llm import language, queries

SMALL = "/root/testdata/sf0.01"


def test_trigrams_by_hand():
    bins, owner = language.trigrams(["Ab  c!d", "", "1 2", "ab"])
    assert owner.tolist() == [0, 0, 0, 0, 3, 3]
    assert bins[:2].tolist() == bins[4:].tolist()
    again, _ = language.trigrams(["aB c D"])
    assert again.tolist() == bins[:4].tolist()


def test_scores_do_not_depend_on_slabs(monkeypatch):
    rng = np.random.default_rng(0)
    model = language.TextModel(["a", "b"], rng.normal(size=(language.BINS, 2)))
    texts = ["", "abc def " * 40, "é" * 30, "x y z", "abcdefg" * 50]
    want = [language.text_scores([t], model) for t in texts]
    got, count = language.text_scores(texts, model)
    assert np.allclose(got, np.concatenate([w[0] for w in want]))
    monkeypatch.setattr(language, "_ABOUT", 16)
    _, parts = language.text_scores(texts, model)
    assert np.all(np.abs(parts - count) <= 0.3 * count + 2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = language.fit_text(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    plain = language.identify(held, language.fit(held, text)).select("lang", "_language.*")
    rows = plain.where("letters >= 20").collect()
    assert sum(r.language == r.lang for r in rows) >= 0.98 * len(rows)
    assert sum(r.kept for r in rows) >= 0.98 * len(rows)


def test_evidence_decides_where_text_does_not(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = language.fit_text(docs)
    de = [r.text for r in docs.where("lang = 'de' and n_chars > 300").limit(40).collect()]
    en = [r.text for r in docs.where("lang = 'en' and n_chars > 300").limit(40).collect()]
    rows = [(t, "de", f"https://www.h{i % 4}.example.de/x") for i, t in enumerate(de)]
    rows += [(t, "en", "http://user@news.site.com:80/a?b") for t in en]
    rows += [("in in", "", "https://www.h1.example.de/y"), ("in in", "", "http://news.site.com/z"), ("in in", "de-AT", ""), ("in in", "EN", "")]
    rows += [("".join(np.random.default_rng(1).choice(list("qxzwkjvbñ "), 300)), "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, url string")
    hints = {"declared": F.col("declared"), "address": F.col("url")}
    got = {r.doc_id: r.language for r in language.identify(df, language.fit(df, text, **hints), **hints).select("doc_id", "_language.language").collect()}
    assert [got[i] for i in range(80, 84)] == ["de", "en", "de", "en"] and got[84] == "und"
    place = df.select(language.place_of(F.col("url")).alias("p")).select("p.*").distinct().collect()
    assert {(r.host, r.domain, r.suffix) for r in place} >= {("news.site.com", "site.com", "com"), ("", "", "")}


def test_query_keeps_clean_documents(spark):
    rows = queries.QUERIES["op6_language_id"](spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    good = [r for r in rows if len(docs[r.doc_id].text or "") > 30]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.language == docs[r.doc_id].lang for r in good) >= 0.99 * len(good)


def test_pages(spark):
    rows = queries.QUERIES["language_of_pages"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert len({r.language for r in rows}) > 1


@pytest.mark.parametrize("few", [True, False])
def test_odd_rows(spark, monkeypatch, few):
    from threshcast import session

    if not few:
        monkeypatch.setattr(session.broadcast_if_small, "__defaults__", (0, False))
    texts = [None, "", "... !! 12", "the " * 60_000, "plain words of the sort", "0x1f 0x2e", "a"]
    df = documents(spark, texts).withColumnsRenamed({"n_chars": "host"}).withColumn("label", F.lit(1))
    df = df.union(df.where("doc_id = 4")).union(df.where("doc_id = 4").withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None), "source": F.lit(None)}))
    rows = language.of_documents(df).select("doc_id", "_language.*").collect()
    assert len(rows) == 9
    kept = {r.doc_id: r.kept for r in rows}
    assert not kept[0] and not kept[1] and not kept[2] and kept[3] and kept[4]
    assert {r.language for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert language.keep_known(df).columns == df.columns
    assert language.of_documents(df.limit(0)).collect() == []
