import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DATA, documents
from tokenizers import Tokenizer

from threshcast.llm import packing, queries


def check_places(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_query_equals_brute_force(spark):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            block = np.array(ids[k : k + 2048], "<u4")
            want[d.doc_id, k // 2048] = (k, len(block), zlib.crc32(block.tobytes()))
    rows = queries.QUERIES["op7_best_fit_packing"](spark, DATA).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    n = check_places(rows, 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert n <= least + max(1, least // 50)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 50, 3000]))]
    slots = packing.plan(dict(Counter(lengths)), capacity)
    used, covered = defaultdict(list), Counter()
    for length, rank, n, first, each, offset in slots:
        assert rank == covered[length]
        covered[length] += n
        for i in range(n):
            used[first + i // each].append((offset + i % each * length, length))
    assert covered == Counter(lengths)
    for found in used.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    assert len(used) <= len(rooms) + 1


def test_words_one_by_one_are_the_text():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["", " ", "a  b\n\nc", "It's <|endoftext|> x<|startoftext|>y", "é é Ⅷ １２   x\tz",
             "don't 'll", "́ a ́b", "日本語 テスト", "x" * 100 + " " + "y" * 100, "a\r\nb\x0bc\x85d",
             "ÀÉ ß ª²¼x½'S 'T it'sun ('s ...!?\x1f\x1c\xa0\xad×÷ 12'll", "".join(map(chr, range(256))) * 2]
    got = packing.WordEncoder(packing.tokenizer_path()).encode(texts)
    assert [list(g) for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    enc = packing.WordEncoder(packing.tokenizer_path())
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for k in range(5):
        texts = [" ".join(f"w{k}{i}" for i in range(8)), "w00 again"]
        assert [list(g) for g in enc.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_rows(spark):
    df = documents(spark, [None, "", "the cat " * 5000, "a", "a"]).withColumnsRenamed({"lang": "length", "source": "part"})
    df = df.union(df.where("doc_id = 3")).union(df.selectExpr("cast(null as long)", "text", "length", "part", "n_chars").limit(1))
    rows = packing.pack_documents(df, packing.tokenizer_path(), capacity=64, with_ids=True).collect()
    check_places(rows, 64)
    assert Counter(r.doc_id for r in rows)[3] == 2 and Counter(r.doc_id for r in rows)[2] > 100
    assert all(len(r.ids) == r.length for r in rows)
    assert next(r for r in rows if r.doc_id == 0).ids == [0]
    assert packing.pack_documents(df.limit(0), packing.tokenizer_path()).collect() == []
