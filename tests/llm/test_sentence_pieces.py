import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from helpers import DATA, documents
from sentencepiece import sentencepiece_model_pb2

from threshcast.llm import queries, sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "  a  b", "a\nb\tc", "é日本\U0001f600 x", "<s> </s> <unk> <0x0A>", "▁x▁", "x" * 300, "   ", "a ", "\x00b", "é"]


def unigram(byte_fallback=True, trim=False, prefix=True):
    """A small unigram model written by hand."""
    m = sentencepiece_model_pb2.ModelProto()
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0, 6) for i in range(256)]
    words = ["▁", "▁the", "▁th", "e", "t", "h", "a", "ha", "▁a", "at", "hat", "▁▁", "b", "ab", "the", "s"]
    pieces += [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    for name, score, kind in pieces:
        m.pieces.add(piece=name, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = byte_fallback
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id = 0, 1, 2
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = prefix, trim
    m.normalizer_spec.escape_whitespaces = True
    return m.SerializeToString()


def test_query_equals_sentencepiece(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_sentence_pieces"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == sp.encode(texts[r.doc_id]) and r.parity and r.n_tokens == len(r.ids)
        decoded = sp.decode(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert r.round_trip == (decoded == texts[r.doc_id])


@pytest.mark.parametrize("model", [Path(MODEL).read_bytes(), unigram(), unigram(trim=True), unigram(prefix=False)])
def test_parity_on_hard_texts(model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    work = sentence_pieces.PieceCoder(model, threads=2)
    rng = random.Random(1)
    texts = HARD[:-2] + ["".join(rng.choices(["the", "hat", " ", "a", "b", "\n", "é", "s"], k=40)) for _ in range(200)]
    ids, same = work.encode(texts)
    assert all(same) and work.cuttable
    for text, got in zip(texts, ids):
        want = sp.encode(text)
        assert list(got) == want, text
        assert work.decode(got.tolist()) == sp.decode(want), text


def test_whole_texts_when_pieces_span_blanks():
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(unigram())
    m.pieces.add(piece="a▁b", score=-0.5, type=1)
    work = sentence_pieces.PieceCoder(m.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    ids, same = work.encode(["a b", "the a b hat a", ""])
    assert not work.cuttable and same == [True] * 3
    assert [list(x) for x in ids] == sp.encode(["a b", "the a b hat a", ""])


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 5)
    work = sentence_pieces.PieceCoder(Path(MODEL).read_bytes())
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(4):
        text = " ".join(f"w{k}{i}" for i in range(9))
        assert list(work.encode([text])[0][0]) == sp.encode(text)
    assert len(work.remembered.place) <= 5


def test_odd_rows(spark):
    df = documents(spark, [None, *HARD[:-2], "word " * 40_000]).withColumnsRenamed({"lang": "ids", "source": "parity"})
    df = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 3").selectExpr("cast(null as long)", "text", "ids", "parity", "n_chars"))
    coded = sentence_pieces.encode_documents(df, MODEL)
    rows = coded.collect()
    assert len(rows) == len(HARD) + 2 and all(r.parity for r in rows)
    assert next(r for r in rows if r.doc_id == 0).ids == []
    back = sentence_pieces.decode_ids(coded.select("doc_id", "ids"), MODEL).collect()
    assert next(r.decoded for r in back if r.doc_id == len(HARD) - 1) == "word " * 40_000
    assert sentence_pieces.encode_documents(df.limit(0), MODEL).collect() == []
