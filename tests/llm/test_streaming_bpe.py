"""Streaming BPE against the tokenizers library."""

import hashlib
import json
import random

import pytest
from helpers import DATA, documents
from tokenizers import Tokenizer

from threshcast.llm import queries
from threshcast.llm import streaming_bpe as S

PATH = S.byte_model_path()


@pytest.fixture(scope="module")
def model():
    return S.ByteModel(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def streamed(model, text):
    return [int(i) for part in S.Encoder(model).encode(text) for i in part]


def expected(library, text):
    return library.encode(text, add_special_tokens=False).ids


def plain(library, doc, text):
    ids = expected(library, text or "")
    told = library.decode(ids, skip_special_tokens=False)
    return (doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(told.encode()).hexdigest())


ALPHABETS = ["ab -'\n", "- ", "a", "helotin ", "\n \t x", "'se relv", "é你 a", "=- \n", "aA0.", "*#-_", "1 a'"]


def test_parts_of_any_size(model, library, monkeypatch):
    """Small parts and blocks: words, blanks and added tokens are cut everywhere."""
    monkeypatch.setattr(S, "CHUNK", 40)
    monkeypatch.setattr(S, "BLOCK", 16)
    draw = random.Random(5)
    for _ in range(400):
        letters = draw.choice(ALPHABETS)
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 300)))
        if draw.random() < 0.3:
            text = text.replace(letters[0], draw.choice(["<|endoftext|>", "<|endoftext", "<|"]))
        assert streamed(model, text) == expected(library, text)


def test_every_cut_character(model, library):
    memory = S.word_memory(model)
    for point in [*range(0x800), *range(0x800, 0x20000, 61)]:
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        text = f"a{c}1{c}{c} b{c} !{c}"
        assert [int(i) for p in S.Encoder(model, memory).encode(text) for i in p] == expected(library, text), hex(point)


def test_long_runs(model, library):
    for text in ("a" * 150_000, " " * 70_000 + "x", "-=" * 90_000 + "\n", "\n" * 140_000, "ab1" * 1000, "7" * 66_000 + "'s"):
        assert streamed(model, text) == expected(library, text)


def test_lookahead_bounds_every_change(model):
    """Borders further from the end than the lookahead are the same whatever follows."""
    draw = random.Random(2)
    names = [b for b in model.bytes if b and len(b) > 3]
    for _ in range(300):
        text = b"".join(draw.choice(names) for _ in range(40))
        more = text + b"".join(draw.choice(names) for _ in range(3))
        borders = []
        for data in (text, more):
            at, found = 0, set()
            for i in model.block(data):
                at += len(model.bytes[i])
                found.add(at)
            borders.append({x for x in found if x < len(text) - model.lookahead})
        assert borders[0] == borders[1]


def test_lookahead_of_small_lists():
    assert S.lookahead([("a", "b")]) == 1
    # c behind "ab" takes the b, as (b, c) goes first: the border before the b moves
    assert S.lookahead([("b", "c"), ("a", "b")]) == 2
    with pytest.raises(ValueError):
        S.lookahead([("a", "b"), ("c", "a"), ("ca", "b"), ("c", "ab")])


def test_decoder_waits_for_whole_characters(model, library):
    text = "naïve 你好 🙂 ü"
    ids = expected(library, text)
    decoder = S.Decoder(model)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text
    for broken in ([ids[-1]] + ids[3:4], model.first[[0xE4, 0xBD]].tolist(), model.first[[0xFF, 0xE4, 0x41]].tolist()):
        decoder = S.Decoder(model)
        assert decoder.feed(broken) + decoder.finish() == library.decode(broken, skip_special_tokens=False)


def test_odd_models(tmp_path):
    spec = json.load(open(PATH))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "m.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        S.ByteModel(str(tmp_path / "m.json"))


def test_query_equals_library(spark, library):
    want = sorted(plain(library, r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = queries.QUERIES["op12_streaming_bpe"](spark, DATA)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_odd_rows(spark, library):
    texts = [None, "", "a", "a", "<|endoftext|>", " ", "x <|endoftext|> y" * 20_000, "z" * 200_000]
    df = documents(spark, texts).withColumnRenamed("source", "n_tokens")
    df = df.union(df.limit(0)).withColumnRenamed("lang", "ids_sha256")
    got = sorted(tuple(r) for r in S.transcode(df, PATH).collect())
    assert got == sorted(plain(library, i, t) for i, t in enumerate(texts))
    assert S.transcode(df.filter("false"), PATH).count() == 0
    ids = S.transcode(df, PATH, with_ids=True).orderBy("doc_id").select("ids").collect()
    assert ids[6].ids == expected(library, texts[6])
