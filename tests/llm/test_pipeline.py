import random
import zlib

import numpy as np
from helpers import DATA, documents, folder
from test_near_texts import plain_groups
from test_packing import check_places
from test_secrets import plain_spans
from test_suffixes import plain_cut
from tokenizers import Tokenizer

import corpus_pipeline
from threshcast.llm import packing, secrets


def test_stages_equal_brute_force(spark):
    """Each stage on what the one before kept, against a plain re-computation."""
    tables = [spark.read.parquet(f"{DATA}/documents.parquet")]
    names = tables[0].columns
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], DATA).cache())
    for df in tables[:-1]:
        assert df.columns == names and df.dtypes == tables[0].dtypes
    rows = [sorted((tuple(r) for r in df.collect()), key=lambda r: r[0]) for df in tables[:-1]]
    source, told, single, cut, clean = rows
    assert set(told) <= set(source) and len(told) >= 0.98 * len(source)

    root = plain_groups([r[1] for r in told])
    assert single == [r for i, r in enumerate(told) if root[i] == i] and len(single) < len(told)

    kept = plain_cut([(r[0], r[1]) for r in single], 100)
    want = [(r[0], k[3].decode("utf-8", "ignore"), *r[2:4]) for r, k in zip(single, kept)]
    assert [r[:4] for r in cut] == want and all(r[4] == len(r[1]) for r in cut)
    assert any(a[1] != b[1] for a, b in zip(single, cut))

    for before, after in zip(cut, clean):
        spans = plain_spans(before[1])
        if not spans and secrets.KINDS[-1] and "<SECRET>" not in after[1]:
            assert before == after
        for a, _, b, _ in spans:
            assert before[1][a:b] not in after[1] or before[1].count(before[1][a:b]) > 1
        assert after[4] == len(after[1])

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = {}
    for r in clean:
        ids = tokenizer.encode(r[1], add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            block = np.array(ids[k : k + 2048], "<u4")
            pieces[r[0], k // 2048] = (len(block), zlib.crc32(block.tobytes()))
    packed = tables[-1].collect()
    assert {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in packed} == pieces
    check_places(packed, 2048)


def test_run_is_its_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    prose = [" ".join(rng.choices("the of and house water green walk slowly".split(), k=60)) for _ in range(30)]
    texts = [None, "", "!!!", *prose, prose[0], prose[1] + " token = \"" + "0a" * 20 + "\"", "word " * 20_000]
    df = documents(spark, texts)
    df = df.union(df.where("doc_id = 5")).union(df.where("doc_id = 6").selectExpr("cast(null as long)", "text", "cast(null as string)", "source", "cast(null as long)"))
    rows = corpus_pipeline.run(spark, folder(tmp_path, documents=df)).collect()
    check_places(rows, 2048)
    ids = [r.doc_id for r in rows if r.piece == 0]
    assert 0 not in ids and 1 not in ids and 2 not in ids and 33 not in ids and ids.count(5) == 1
    (tmp_path / "none").mkdir()
    assert corpus_pipeline.run(spark, folder(tmp_path / "none", documents=df.limit(0))).collect() == []
