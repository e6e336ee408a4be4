import random

import numpy as np
import pytest
import xxhash
from helpers import DATA, documents, folder, union_find

from threshcast.llm import base, queries, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    n = len(prints)
    links = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    return union_find(n, links)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    root = plain_groups(prints)
    want = {docs[i].doc_id: (f"{prints[i]:016x}", docs[root[i]].doc_id) for i in range(len(docs))}
    got = queries.QUERIES["op3_simhash_near_dedup"](spark, DATA).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(docs)
    assert len(set(root)) < len(docs)


@pytest.mark.parametrize("tile", [8, 100, 2048])
def test_dense_fingerprints(spark, monkeypatch, tile):
    rng = random.Random(7)
    prints = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints += [0, 0, 3, (1 << 64) - 1, 1 << 63]
    root = plain_groups(prints)
    monkeypatch.setattr(simhash, "TILE", tile)
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    frame = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: frame)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(documents(spark, ["x"])).collect()}
    assert got == dict(enumerate(root))


def test_bit_slices_count_every_distance():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 64, np.uint64)
    fps[1:20] = fps[0] ^ (np.uint64(1) << np.arange(19, dtype=np.uint64))
    for radius in (0, 1, 2, 3, 5):
        got = simhash.within(fps, np.zeros(64, int), simhash.planes(fps), np.array([2**64 - 1], np.uint64), radius)
        for i in range(64):
            want = sum(1 << j for j in range(64) if int(fps[i] ^ fps[j]).bit_count() <= radius)
            assert int(got[i]) == want


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a b", "A B", "a b c", "x" * 300_000, "word " * 50_000]
    df = documents(spark, texts).withColumnsRenamed({"lang": "fp", "source": "component_id"})
    df = df.union(df.where("doc_id = 3")).union(df.selectExpr("cast(null as long)", "'q r s t'", "fp", "component_id", "n_chars").limit(1))
    rows = simhash.near_groups(df).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r.component_id for r in rows}
    assert got[0] == got[1] == got[2] == 0 and got[5] == 4 and got[None] is None
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({v for k, v in got.items() if k is not None})
    assert sum(r.doc_id is None for r in kept) == 1 and kept[0].__fields__ == df.columns
    assert simhash.near_groups(df.limit(0)).collect() == []


def test_rows_of_one_id_are_rows_of_their_own(spark):
    prose, other = "one two three four five", "a clean text of its own"
    rows = [(3, prose), (5, prose.upper()), (5, other), (5, other), (7, other)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], documents(spark, []).schema)
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(3, prose), (5, other)]


def test_components_of_a_long_path(spark):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 300)
    edges = list(zip(names[:200], names[1:200])) + list(zip(names[200:], names[201:])) + [(5, 5)]
    got = {r.node: r.component for r in base.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: min(names[:200]) for n in names[:200]} | {n: min(names[200:]) for n in names[200:]}


def test_folder_of_text(spark, tmp_path):
    path = folder(tmp_path, documents=documents(spark, ["one two three"] * 5))
    got = queries.QUERIES["op3_simhash_near_dedup"](spark, path).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 5


def test_repeated_and_missing_ids_neither_lose_nor_make_links(spark):
    near = ["one two three four five six seven eight nine ten " * 3 + w for w in ("a", "b")]
    far = "something else entirely that shares no shingle with the others here"
    rows = [(1, near[0]), (1, far), (9, far), (4, near[0]), (2, "x y z"), (None, "x y z"), (None, "lonely words of no id at all")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], documents(spark, []).schema)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_groups(df).collect()}
    fp = lambda t: int(np.uint64(simhash.fingerprint(t)).astype(np.int64))
    assert got[1, fp(near[0])] == got[4, fp(near[0])] == 1 and got[9, fp(far)] == got[1, fp(far)] == 1
    assert got[2, fp("x y z")] == got[None, fp("x y z")] == 2 and got[None, fp("lonely words of no id at all")] is None
    # a fingerprint that only a row without an id has still links two others
    linked = spark.createDataFrame([(7, 0), (None, 0b11), (8, 0b1111)], "doc_id long, fp long")
    assert _grouped(spark, linked) == {7: 7, None: 7, 8: 7}


def _grouped(spark, prints):
    """Groups of given fingerprints."""
    real = simhash.fingerprints
    simhash.fingerprints = lambda *a, **k: prints
    try:
        return {r.doc_id: r.component_id for r in simhash.near_groups(documents(spark, [])).collect()}
    finally:
        simhash.fingerprints = real


def test_direct_links_span_and_stay_within_the_radius():
    rng = np.random.default_rng(2)
    near = np.uint64(0xF0F0F0F0F0F0F0F0) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.r_[near, rng.integers(0, 2**63, 40).astype(np.uint64)])
    a, b = simhash.tile_links(np.zeros(len(fps), int), fps, np.zeros(len(fps), int), 2, direct=True)
    child, _ = simhash.tile_links(np.zeros(len(fps), int), fps, np.zeros(len(fps), int), 2)
    assert len(a) == len(child) and (np.bitwise_count(fps[a] ^ fps[b]) <= 2).all()
    root = simhash._roots(len(fps), a, b)
    assert np.array_equal(np.flatnonzero(root != np.arange(len(fps))), child)
