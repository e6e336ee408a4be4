"""SimHash near-duplicates by bit-sliced comparison of fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.llm.base import components, keep_least, small_batches, stored
from threshcast.llm.remember import release

#: A bucket of more fingerprints is compared tile by tile, each tile in a task of its own.
TILE = 2048
_SHINGLES_AT_ONCE = 1 << 16
_ROWS_AT_ONCE = 1 << 18


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for a text without words or a null."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    total, counts = max(1, len(parts) - words + 1), np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for low in range(0, total, _SHINGLES_AT_ONCE):
        high = min(total, low + _SHINGLES_AT_ONCE)
        counts += _bit_counts([digest(join(parts[i : i + words]), seed) for i in range(low, high)])
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of 64-bit hashes; 0 for none."""
    parts = (_bit_counts(hashes[low : low + _SHINGLES_AT_ONCE]) for low in range(0, len(hashes), _SHINGLES_AT_ONCE))
    counts = sum(parts, np.zeros(64, np.int64))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        release()
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks so that two words at most ``radius`` bits apart agree under one of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(p) for p in combinations(parts, blocks - radius)]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 fingerprints: bit j of plane b of a row is bit b of member j."""
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view("u1").reshape(-1, 64, 8), axis=2, bitorder="little")
    turned = np.ascontiguousarray(bits.transpose(0, 2, 1))
    return np.packbits(turned, axis=2, bitorder="little").view("<u8").reshape(-1, 64)


def within(query: np.ndarray, block: np.ndarray, sliced: np.ndarray, valid: np.ndarray,
           radius: int) -> np.ndarray:
    """For each (query, block) row, the members of the block at most ``radius`` bits away.

    Distances are counted for 64 members at once in carry-save counters (one word for each bit
    of the count); a member whose count overflows the radius is set in ``over``. After every
    eight planes rows whose members all exceed the radius are abandoned.
    """
    width = max(1, radius.bit_length())
    over = ~valid[block]
    counters = np.zeros((width, len(query)), np.uint64)
    result, live = np.zeros(len(query), np.uint64), np.arange(len(query))
    for b in range(64):
        want = (query >> np.uint64(b)) & np.uint64(1)
        carry = sliced[block, b] ^ (np.uint64(0) - want)
        for level in range(width):
            carry, counters[level] = counters[level] & carry, counters[level] ^ carry
        over |= carry
        if b % 8 == 7:
            reached = _exceeds(counters, radius) | over
            stay = np.flatnonzero(~reached)
            if len(stay) < len(query):
                query, block, over, live = query[stay], block[stay], over[stay], live[stay]
                counters = counters[:, stay]
            if not len(query):
                return result
    result[live] = ~(_exceeds(counters, radius) | over)
    return result


def _exceeds(counters: np.ndarray, radius: int) -> np.ndarray:
    """Members whose counter is above the radius: comparison from the highest bit down."""
    above = np.zeros(counters.shape[1], np.uint64)
    equal = ~above
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            above |= equal & counters[level]
            equal = equal & ~counters[level]
    return above


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of ``n`` nodes, edges (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        after = root.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def tile_links(keys: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int, direct: bool = False):
    """Spanning links (index, index) of the fingerprints of many tiles.

    Rows are sorted by key. In a tile of one chunk all ``side`` are 0; in one of two chunks
    only rows of different sides are compared. With ``direct`` both ends of every link are within
    the radius, closer ones first among those found together; else each points at its least index.
    """
    direct_links = [np.zeros((2, 0), int)]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    blocks, queries, first = [], [], 0
    for s, e in zip(starts, ends):
        two = side[s:e].any()
        target = s + np.flatnonzero(side[s:e]) if two else np.arange(s, e)
        asking = s + np.flatnonzero(side[s:e] == 0) if two else target
        if not len(asking) or not len(target):
            continue
        pad = -len(target) % 64
        filled = np.r_[target, np.full(pad, -1)].reshape(-1, 64)
        n = len(filled)
        blocks.append(filled)
        queries.append((np.repeat(asking, n), np.tile(np.arange(first, first + n), len(asking))))
        first += n
    if not blocks:
        return tuple(direct_links[0])
    members = np.concatenate(blocks)
    valid = np.packbits(members >= 0, axis=1, bitorder="little").view("<u8").ravel()
    sliced = planes(np.where(members >= 0, fps[members], np.uint64(0)))
    asking, block = (np.concatenate(x) for x in zip(*queries))
    root = np.arange(len(fps))
    for low in range(0, len(asking), _ROWS_AT_ONCE):
        q, g = asking[low : low + _ROWS_AT_ONCE], block[low : low + _ROWS_AT_ONCE]
        found = within(fps[q], g, sliced, valid, radius)
        hit = np.flatnonzero(found)
        for part in range(0, len(hit), 4096):
            rows = hit[part : part + 4096]
            bits = np.unpackbits(found[rows].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
            row, member = np.nonzero(bits)
            pairs = np.stack([q[rows[row]], members[g[rows[row]], member]])
            if direct:
                pairs = pairs[:, np.argsort(np.bitwise_count(fps[pairs[0]] ^ fps[pairs[1]]), kind="stable")]
            a, b = root[pairs]
            new = np.flatnonzero(a != b)
            while direct and len(new):
                # the closest link of each component to one before it
                first = new[np.unique(np.maximum(a, b)[new], return_index=True)[1]]
                direct_links.append(pairs[:, first])
                root = _roots(len(fps), np.r_[a[first], np.arange(len(fps))], np.r_[b[first], root])
                pairs = pairs[:, new]
                a, b = root[pairs]
                new = np.flatnonzero(a != b)
            if len(new):
                root = _roots(len(fps), np.r_[a[new], np.arange(len(fps))], np.r_[b[new], root])
    child = np.flatnonzero(root != np.arange(len(fps)))
    return tuple(np.concatenate(direct_links, axis=1)) if direct else (child, root[child])


def links(prints: DataFrame, under: list[int], radius: int, direct: bool = False) -> DataFrame:
    """(u, v): links of the different fingerprints ``fp`` that agree under one of the masks
    ``under`` and are at most ``radius`` bits apart; of each tile a spanning forest, see ``tile_links``."""
    choice = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(
        F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(under))))
    keyed = prints.select("fp", choice.alias("c")).select("fp", "c.t", "c.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(TILE))
    tiled = (
        keyed.join(sizes, ["t", "key"])
        .withColumn("chunks", chunks)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(
            F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"),
            (F.col("mine") > F.col("other")).cast("int").alias("side"),
            "fp", "t", "key",
        )
    )

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def found(t: pa.Table):
            a, b = tile_links(
                t["tile"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy(), radius, direct
            )
            fps = t["fp"].to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["u", "v"])

        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            t = pa.Table.from_batches(held)
            tiles = t["tile"].to_numpy()
            last = int(np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]])[-1])
            if last:
                yield found(t.slice(0, last))
                held, rows = t.slice(last).to_batches(), t.num_rows - last
        if held:
            yield found(pa.Table.from_batches(held))

    # by number: tiles cost more than their bytes tell, so tasks are not to be merged by size
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        tiled.select("tile", "side", "fp")
        .repartition(tasks, "tile")
        .sortWithinPartitions("tile", "fp")
        .mapInArrow(compare, "u long, v long")
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                radius: int = 2, blocks: int = 5) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link at ``radius`` bits or fewer.

    ``component_id`` is the smallest doc_id reachable over links, the document's own included.
    Equal fingerprints are collapsed first, so any number of copies is one fingerprint. Two
    fingerprints within the radius agree in ``blocks - radius`` of the blocks their bits are
    cut into; buckets of such agreement are compared bit-sliced. A bucket of over ``TILE``
    fingerprints is dealt over tiles (pairs of chunks), each a group of its own; a tile gives
    back a spanning forest of its links, never all pairs.

    Null text counts as empty: fingerprint 0, linked like any other. Links are between
    fingerprints, so rows of a repeated doc_id are linked by their own texts and by nothing else,
    and rows without doc_id link others too; they get the component's smallest id (null when
    nobody in it has one). An empty table gives no rows. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = links(classes, masks(radius, blocks), radius)
    found = components(edges)
    rooted = classes.join(found, classes.fp == found.node, "left")
    rooted = rooted.select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest (id, text hash).

    Rows of one id and different texts are rows of their own, so texts are grouped by their hash;
    rows without an id stay, as no group can name them.
    """
    texts = docs.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    groups = near_groups(texts, **settings)
    named = groups.select(F.col("doc_id").alias("th"), F.col("component_id").alias("component")).distinct()
    return keep_least(docs, named, id_col, text_col)
