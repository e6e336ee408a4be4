"""WARC archives: written record by record, read back in byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.llm.base import stored
from threshcast.session import broadcast_if_small, fresh_path

#: A writing task begins another file beyond so many bytes; a reading task takes so many.
FILE_BYTES, RANGE_BYTES = 256 << 20, 16 << 20
#: More ranges than this share tasks.
MOST_TASKS = 20_000
#: Payloads of at least so many bytes are written once and revisited.
LEAST_BYTES = 1000
MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
_HEADER = 1 << 16
_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def _line(name: str, value: str) -> bytes:
    safe = value.replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00")
    return f"{name}: {safe}\r\n".encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [b"WARC/1.1\r\n", _line("WARC-Type", "revisit" if revisit else "response"), _line("WARC-Record-ID", _urn(page_id)),
             _line("WARC-Date", _DATE), _line("Content-Type", "application/http; msgtype=response"),
             _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
    if url is not None:
        lines.append(_line("WARC-Target-URI", url))
    if revisit:
        lines += [_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _urn(refers_to))]
    lines.append(_line("Content-Length", str(len(block))))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"".join(lines) + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): whose payload a page repeats, if anyone's.

    Of rows with equal payloads of ``LEAST_BYTES`` or more the one with the largest page_id is
    the response. Payloads meet as digests, counted before the shuffle; the digests that occur
    more than once are broadcast while their counted number is small.
    """
    rows = pages.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    several = (
        rows.where(F.col("size") >= LEAST_BYTES).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("sha1").alias("_sha1"), "first")
    )
    several = broadcast_if_small(several, derived=True)
    found = rows.join(several, (F.col("sha1") == F.col("_sha1")) & (F.col("size") >= LEAST_BYTES), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return found.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for every row; gives the written manifest (path, bytes, records).

    Files get names of their own in each attempt of a task, and only those of finished tasks are
    in the manifest, so a lost executor leaves no half file or double record in it. ``folder``
    must be reachable for all executors; by default it is a new one in the shared folder.
    """
    where = folder or fresh_path(pages.sparkSession, "warc")
    rows = with_references(pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"),
    ))

    def run(batches):
        system, base = _open(where)
        system.create_dir(base, recursive=True)
        path, out, size, count, done = "", None, 0, 0, []

        def closed():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, count))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, size, count = f"{where}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(_open(path)[1], compression=None)
                member = record(row["page_id"], row["url"], row["payload"], row["sha1"], row["refers_to"])
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    closed()
        closed()
        p, s, c = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(s, pa.int64()), pa.array(c, pa.int64())],
                                         names=["path", "bytes", "records"])

    return stored(rows.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class Window:
    """A file's bytes from a position on, in chunks; little of them is held."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def take(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``start`` on."""
        n = max(0, min(n, self.size - start))
        if start < self.at or start + n > self.at + len(self.held):
            self.source.seek(start)
            self.at, self.held = start, self.source.read(min(max(n, _CHUNK), self.size - start))
        low = start - self.at
        return self.held[low : low + n]

    def find(self, start: int, stop: int) -> int:
        """The first place of the gzip magic in [start, stop), or -1."""
        while start < stop:
            part = self.take(start, min(_CHUNK, stop - start) + len(MAGIC) - 1)
            found = part.find(MAGIC)
            if 0 <= found < stop - start:
                return start + found
            start += _CHUNK
        return -1


def looks_like_record(window: Window, at: int) -> bool:
    """Whether a gzip member begins at ``at`` whose text begins as a WARC record's."""
    if window.take(at, 3) != MAGIC:
        return False
    try:
        head = zlib.decompressobj(31).decompress(window.take(at, 4096), 5)
    except zlib.error:
        return False
    return head == b"WARC/"


def member(window: Window, at: int, keep: bool = True) -> tuple[bytes, int] | None:
    """(content, end) of the member at ``at``, checksum verified; None if there is no such."""
    unpack, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            chunk = window.take(place, _HEADER)
            if not chunk:
                return None
            data = unpack.decompress(chunk)
            if keep:
                parts.append(data)
            place += len(chunk)
    except zlib.error:
        return None
    return b"".join(parts), place - len(unpack.unused_data)


def heads(window: Window, start: int, end: int):
    """(place, exit) of each candidate in [start, end) from which member follows member past the end.

    Bytes of the magic number may stand inside a record, even whole records inside another; what
    begins no such chain is dropped here, the rest is settled by ``follow``.
    """
    seen: set[int] = set()
    at = window.find(start, end)
    while at >= 0:
        if at not in seen and looks_like_record(window, at):
            place, visited = at, []
            while place < end:
                found = member(window, place, keep=False) if looks_like_record(window, place) else None
                if found is None:
                    break
                visited.append(place)
                place = found[1]
            if place >= end:
                seen.update(visited)
                yield at, place
        at = window.find(at + 1, end)


def follow(found: list[tuple[int, int, int]], size: int, range_bytes: int, path: str) -> list[tuple[int, int]]:
    """(range start, first record) of the ranges of a file in which records begin.

    ``found`` has (range start, candidate, exit). The first record begins at 0; where one range's
    chain ends the next one's begins, so no candidate inside a record is ever taken.
    """
    exits = {(start, at): end for start, at, end in found}
    out, place = [], 0
    while place < size:
        start = place // range_bytes * range_bytes
        if (start, place) not in exits:
            raise ValueError(f"no whole record at {place} of {path}")
        out.append((start, place))
        place = exits[start, place]
    return out


def parsed(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields in lower case, HTTP head, payload) of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


READ = ("path string, offset long, record_type string, page_id long, url string, refers_to long, "
        "payload_bytes long, payload_digest string, payload binary")


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives (path, bytes): each read by the task whose range it begins in.

    Tasks list the candidates of their ranges and where the members from each lead; the few
    numbers of a file, put together, tell which candidates are records; then each range is read
    from its first record on, and of its last record what lies behind the range.
    ``payload_bytes`` and ``payload_digest`` (bare hex SHA-1) are those of the full payload: of a
    response computed from it and held against the header, of a revisit taken from its headers;
    its payload is null. ``payloads=False`` leaves payloads null. A broken record or checksum
    raises an error.
    """
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    # tasks by number, as Spark would put the few bytes that name many ranges into one
    wanted = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    tasks = max(1, min(int(wanted), MOST_TASKS))
    ranges = manifest.select("path", "bytes", cut.alias("start")).repartition(tasks, "path", "start")

    def list_heads(batches):
        for batch in batches:
            rows = []
            for task in batch.to_pylist():
                system, inner = _open(task["path"])
                with system.open_input_file(inner) as source:
                    window, end = Window(source, task["bytes"]), min(task["bytes"], task["start"] + range_bytes)
                    rows += [(task["path"], task["bytes"], task["start"], *x) for x in heads(window, task["start"], end)]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "bytes", "start", "head", "exit"])

    def settle(t):
        path, size = t["path"][0].as_py(), t["bytes"][0].as_py()
        found = follow([x for x in zip(*(t[c].to_pylist() for c in ("start", "head", "exit"))) if x[1] is not None], size, range_bytes, path)
        start, first = zip(*found) if found else ((), ())
        n = len(found)
        return pa.table({"path": pa.array([path] * n, pa.string()), "bytes": pa.array([size] * n, pa.int64()),
                         "start": pa.array(start, pa.int64()), "first": pa.array(first, pa.int64())})

    listed = ranges.mapInArrow(list_heads, "path string, bytes long, start long, head long, exit long")
    # a file without any candidate must still be looked at
    listed = listed.unionByName(manifest.where("bytes > 0").select("path", "bytes"), allowMissingColumns=True)
    settled = listed.groupBy("path").applyInArrow(settle, "path string, bytes long, start long, first long")
    ranges = settled.repartition(tasks, "path", "start")

    def rows_of(path: str, size: int, start: int, at: int):
        system, inner = _open(path)
        with system.open_input_file(inner) as source:
            window, end = Window(source, size), min(size, start + range_bytes)
            while at < end:
                content, after = member(window, at)
                fields, http, payload = parsed(content)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                refers = None
                if fields["warc-type"] == "revisit":
                    named = dict(x.lower().split(": ", 1) for x in http.decode().split("\r\n")[1:])
                    n, refers, payload = int(named["content-length"]), _page(fields["warc-refers-to"]), None
                else:
                    n = len(payload)
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload at {at} of {path} is not what its digest says")
                yield (path, at, fields["warc-type"], _page(fields["warc-record-id"]), fields.get("warc-target-uri"),
                       refers, n, digest, payload if payloads else None)
                at = after

    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        for batch in batches:
            for task in batch.to_pylist():
                rows, held = [], 0
                for row in rows_of(task["path"], task["bytes"], task["start"], task["first"]):
                    rows.append(row)
                    held += row[6] if payloads else 100
                    if held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive every page and read the archives back: one row per page, without payloads.

    Null html is an empty payload, null urls and ids stay null. Rows that repeat a page_id are
    records of their own: with equal payloads none of those with the largest id revisits. An
    empty table gives no rows; other columns are not read.
    """
    return read(write(pages), payloads=False)
