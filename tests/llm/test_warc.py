import gzip
import hashlib
import random
import zlib

import duckdb
import pytest
from helpers import DATA

from check import canonical
from threshcast.llm import queries, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    cur = con.execute(queries.SQL["op8_warc"])
    df = queries.QUERIES["op8_warc"](spark, DATA)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())


def plain(rows):
    out = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        first = max(same)
        revisit = len(payload) >= 1000 and i != first
        out[i] = (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    return out


@pytest.mark.parametrize("range_bytes", [64, 1000, 7777, 1 << 24])
def test_every_range_size_reads_all(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    texts = ["", None, "é" * 500, "é" * 499, "x" * 1000, "<p>" + "y" * 5000] + ["".join(rng.choices("abc \n", k=rng.randint(0, 3000))) for _ in range(10)]
    rows = [(i, f"http://h/{i}", rng.choice(texts)) for i in range(60)]
    manifest = warc.write(pages(spark, rows), str(tmp_path / "w"), file_bytes=4000)
    assert manifest.agg({"records": "sum"}).first()[0] == 60 and manifest.count() > 3
    found = warc.read(manifest, range_bytes).collect()
    assert len(found) == 60
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == plain(rows)
    for r in found:
        html = rows[r.page_id][2] or ""
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload).decode() == html


def stored_member(data: bytes) -> bytes:
    """A gzip member whose content stands in it uncompressed."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def test_records_within_records(spark, tmp_path):
    inner = warc.record(900, "u", b"inner one", hashlib.sha1(b"inner one").hexdigest(), None)
    inner += warc.record(901, "u", b"inner two", hashlib.sha1(b"inner two").hexdigest(), None)
    blob, want = b"", []
    for i in range(12):
        payload = warc.MAGIC * 5 + inner * 3 + bytes([i]) * 50
        plain_text = gzip.decompress(warc.record(i, f"u{i}", payload, hashlib.sha1(payload).hexdigest(), None))
        blob += stored_member(plain_text)
        want.append((i, payload))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(blob)
    manifest = spark.createDataFrame([(str(path), len(blob))], "path string, bytes long")
    for range_bytes in (50, 333, len(blob) // 3, len(blob)):
        found = sorted((r.page_id, bytes(r.payload)) for r in warc.read(manifest, range_bytes).collect())
        assert found == want


def test_damage_is_an_error(spark, tmp_path):
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(good[:-3])
    manifest = spark.createDataFrame([(str(path), len(good) - 3)], "path string, bytes long")
    with pytest.raises(Exception, match="no whole record"):
        warc.read(manifest).collect()


def test_odd_rows(spark):
    big = "z" * 200_000
    rows = [(1, None, None), (2, "a\r\nb: c", ""), (3, "ü", big), (4, "u", big), (4, "u", big), (None, "u", big), (None, None, "q"), (9, "u", "w" * 999), (10, "u", "w" * 999)]
    df = pages(spark, rows).withColumnsRenamed({}).selectExpr("*", "1 as sha1", "'x' as payload")
    out = warc.round_trip(df).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in out)
    assert kinds == sorted([("1", "response", None), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None), ("4", "response", None),
                            ("None", "revisit", 4), ("None", "response", None), ("9", "response", None), ("10", "response", None)])
    assert {r.page_id: r.url for r in out if r.page_id in (1, 2, 3)} == {1: None, 2: "a%0D%0Ab: c", 3: "ü"}
    assert warc.round_trip(df.limit(0)).collect() == []
