"""Removal of repeated byte strings by a distributed, common-prefix-aware suffix sort.

Sorting every suffix of the corpus would move several times its size, so the suffixes sorted are
those at *anchors*: in each window of ``window`` bytes the position whose ``gram`` bytes have the
least hash, leftmost of equals. Equal windows have their anchor at the same place, so windows can
only be equal when the suffixes at their anchors and the bytes before these agree. An anchor owns
a run of windows; a suffix is written with what its windows reach to the right, then to the left.

1. Documents are dealt into groups of about ``GROUP_BYTES``; anchors whose gram occurs nowhere
   else are dropped (sorted hashes, delta-coded, are exchanged by hash range).
2. Each group sorts its remaining suffixes into one front-coded run per hash bucket.
3. Buckets merge their runs by a loser tree. Every candidate knows how many bytes it shares with
   the last winner; the longer share wins unseen, equal shares are compared from there on.
4. Equal suffixes are repeats in full, save the earliest. Suffixes that agree in part have their
   windows matched by classes of right sides (common prefixes) and left sides, exactly.
5. Groups take the spans back and cut their texts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshcast.llm.base import small_batches
from threshcast.llm.remember import release

GROUP_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
_SLAB = 1 << 19
_LOW = np.uint64((1 << 24) - 1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def gram_size(window: int) -> int:
    if window < 8:
        raise ValueError("windows have 8 bytes at least")
    return min(32, max(8, window // 3 // 8 * 8))


def gram_hashes(buf: np.ndarray, low: int, n: int, gram: int) -> np.ndarray:
    """64-bit hashes of the grams at ``low``, ``low + 1``, ...; ``buf`` has 8 bytes of padding."""
    total = np.zeros(n, np.uint64)
    for j in range(0, gram, 8):
        word = np.ndarray(n, "<u8", buf.data, low + j, (1,))
        total += word * _ODD[j // 8]
        total ^= total >> np.uint64(29)
    total *= _ODD[3]
    total ^= total >> np.uint64(32)
    total *= _ODD[0]
    return total


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int):
    """(anchor, first window, last window, hash) of all runs of windows that share an anchor."""
    gram = gram_size(window)
    width, n = window - gram + 1, int(ends[-1]) if len(ends) else 0
    found = []
    long = ends - starts >= window
    first, last = starts[long], ends[long] - window + 1
    for low in range(0, n, _SLAB):
        a, b = np.searchsorted(last, low, "right"), np.searchsorted(first, low + _SLAB)
        if a >= b:
            continue
        high = min(low + _SLAB, int(last[b - 1]))
        m = high - low + width - 1
        hashes = gram_hashes(buf, low, m, gram)
        key = np.full(-(-m // width) * width, ~np.uint64(0))
        key[:m] = (hashes & ~_LOW) | np.arange(m, dtype=np.uint64)
        blocks = key.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        size = high - low
        at = (np.minimum(behind[:size], ahead[width - 1 : width - 1 + size]) & _LOW).astype(np.int64)
        marks = np.zeros(size + 1, np.int8)
        marks[np.maximum(first[a:b] - low, 0)] += 1
        np.add.at(marks, np.minimum(last[a:b] - low, size), -1)
        windows = np.flatnonzero(np.cumsum(marks[:size], dtype=np.int64) > 0)
        at = at[windows]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        stop = np.r_[new[1:], len(at)] - 1
        found.append((at[new] + low, windows[new] + low, windows[stop] + low, hashes[at[new]]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    at, lo, hi, h = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[new], lo[new], hi[np.r_[new[1:], len(at)] - 1], h[new]


class Group:
    """The documents of a group in order of id, as one buffer of bytes."""

    def __init__(self, t: pa.Table):
        release()
        present, at = pc.is_valid(t["_text"]), t.schema.get_field_index("_text")
        t = t.set_column(at, "_text", pc.fill_null(t["_text"], ""))
        order = pc.sort_indices(t, [("_id", "ascending"), ("_text", "ascending")], null_placement="at_end")
        texts = t["_text"].take(order).cast(pa.large_string()).combine_chunks()
        self.present = present.take(order).to_pylist()
        self.table = t.remove_column(at).take(order)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.buf = np.zeros(len(data) + 64, np.uint8)
        self.buf[: len(data)] = data
        self.starts, self.ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        ids = self.table["_id"].to_numpy(zero_copy_only=False) if self.table["_id"].null_count == 0 else np.array(
            [np.iinfo(np.int64).max if x is None else x for x in self.table["_id"].to_pylist()], np.int64)
        self.ids = ids.astype(np.int64)


def short(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash, mixed anew: hashes of anchors are minima, so their high bits are low."""
    h = (h ^ (h >> np.uint64(33))) * _ODD[1]
    return (h ^ (h >> np.uint64(29))) * _ODD[2] >> np.uint64(16)


def bucket_of(h48: np.ndarray, buckets: int) -> np.ndarray:
    return ((h48 >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences in as few bytes as the largest needs."""
    steps = np.diff(values, prepend=values[:1]).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + steps.view("u1").reshape(-1, 8)[:, :width].tobytes()


def unsqueeze(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :width] = body
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + np.uint64(int.from_bytes(blob[1:9], "little"))


def packed(x: object) -> bytes:
    raw = pickle.dumps(x, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes):
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def narrow(x) -> np.ndarray:
    x = np.asarray(x, np.int64)
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) and x.min() >= 0 else x


def agree(a: bytes, b: bytes, at: int) -> int:
    """How many bytes two strings share, given that they share ``at``."""
    n = min(len(a), len(b))
    while at < n and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return min(at, n)


def front_coded(keys: list[bytes]) -> tuple[list[int], bytes]:
    shared, rest, last = [], [], b""
    for key in keys:
        n = agree(last, key, 0)
        shared.append(n)
        rest.append(key[n:])
        last = key
    return shared, b"".join(rest)


def front_decoded(shared, lengths, rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for n, size in zip(shared.tolist(), lengths.tolist()):
        last = last[:n] + rest[at : at + size - n]
        at += size - n
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]):
    """(run, index, bytes shared with the string before) in the order of all strings.

    A run is its sorted strings and what each shares with its predecessor. Losers in the tree
    remember what they share with the winner that beat them, so no known prefix is compared
    again: only at equal shares strings are looked at, from the first unknown byte on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    if not runs:
        return
    current: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known, place = [0] * k, [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; the loser learns what it shares with the winner."""
        x, y = current[a], current[b]
        if y is None:
            return True
        if x is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        n = agree(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return True
        known[a] = n
        return False

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if beats(a, b):
            winners[node], losers[node] = a, b
        else:
            winners[node], losers[node] = b, a
    top = winners[1] if k > 1 else 0
    while current[top] is not None:
        i = place[top]
        yield top, i, known[top]
        keys, shared = runs[top]
        i += 1
        place[top] = i
        if i < len(keys):
            current[top], known[top] = keys[i], shared[i]
        else:
            current[top] = None
        node = (top + k) >> 1
        while node:
            other = losers[node]
            if not beats(top, other):
                losers[node], top = top, other
            node >>= 1


def sorted_runs(group: Group, window: int, flagged: np.ndarray, at, lo, hi, h48, buckets: int):
    """(bucket, blob) of the group's sorted suffixes; equal ones are one entry with copies."""
    pick = np.flatnonzero(flagged)
    if not len(pick):
        return
    n = int(group.ends[-1])
    raw = group.buf[:n].tobytes()
    turned = raw[::-1]
    doc = np.searchsorted(group.starts, at[pick], "right") - 1
    # empty documents share their start with the next one: the last of equal starts holds the text
    bucket = bucket_of(h48[pick], buckets)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        items = []
        for j in part.tolist():
            i = pick[j]
            a, first, last = int(at[i]), int(lo[i]), int(hi[i])
            right = last + window - a
            items.append((raw[a : last + window] + turned[n - a : n - first] + right.to_bytes(4, "big"), j))
        items.sort()
        keys, owners, copies = [], [], []
        for key, j in items:
            if keys and keys[-1] == key:
                copies.append((len(keys) - 1, j))
            else:
                keys.append(key)
                owners.append(j)
        shared, rest = front_coded(keys)
        owners = np.array(owners)
        copy = np.array(copies, np.int64).reshape(-1, 2)
        begin = lo[pick] - group.starts[doc]
        yield int(bucket[part[0]]), packed({
            "shared": narrow(shared), "length": narrow([len(x) for x in keys]), "rest": rest,
            "id": group.ids[doc[owners]], "doc": narrow(doc[owners]), "start": narrow(begin[owners]),
            "entry": narrow(copy[:, 0]), "copy_doc": narrow(doc[copy[:, 1]]), "copy_start": narrow(begin[copy[:, 1]]),
        })


def bucket_spans(blobs: list[tuple[int, bytes]], window: int):
    """(group, document, start, end) arrays of repeated bytes found in a bucket's runs."""
    release()
    runs = [unpacked(b) for _, b in blobs]
    groups = np.array([g for g, _ in blobs], np.int64)
    keys = [front_decoded(r["shared"], r["length"], r["rest"]) for r in runs]
    which, index, common = [], [], []
    for r, i, n in merged([(k, x["shared"].tolist()) for k, x in zip(keys, runs)]):
        which.append(r)
        index.append(i)
        common.append(n)
    which, index, common = np.array(which), np.array(index), np.array(common, np.int64)
    base = np.cumsum([0] + [len(k) for k in keys])
    flat = base[which] + index
    joined = lambda name: np.concatenate([r[name].astype(np.int64) for r in runs])
    ids, doc, start, length = (joined(x)[flat] for x in ("id", "doc", "start", "length"))
    group = groups[which]
    right = np.array([int.from_bytes(keys[r][i][-4:], "big") for r, i in zip(which.tolist(), index.tolist())], np.int64)
    left = length - 4 - right
    reach = left + right  # from the first window's start to the last one's end
    same = np.r_[False, (common[1:] == length[1:]) & (length[1:] == length[:-1])] if len(flat) else np.zeros(0, bool)
    family = np.cumsum(~same) - 1
    order = np.lexsort((start, doc, group, ids, family))
    rep = np.zeros(len(flat), bool)
    rep[order[np.r_[True, np.diff(family[order]) > 0]]] = True
    spans = [(group[~rep], doc[~rep], start[~rep], (start + reach)[~rep])]
    # copies inside a group are never the earliest of their family
    back = np.empty(len(flat), np.int64)
    back[flat] = np.arange(len(flat))
    for r, x in enumerate(runs):
        if len(x["entry"]):
            own = back[base[r] + x["entry"].astype(np.int64)]
            begin = x["copy_start"].astype(np.int64)
            spans.append((np.full(len(own), groups[r]), x["copy_doc"].astype(np.int64), begin, begin + reach[own]))
    spans += partial_spans(window, family, rep, common, left, right, ids, group, doc, start,
                           [keys[r][i] for r, i in zip(which[rep].tolist(), index[rep].tolist())])
    return [np.concatenate(x) for x in zip(*spans)]


def partial_spans(window, family, rep, common, left, right, ids, group, doc, start, rep_keys):
    """Windows of different suffixes that agree: equal right sides and equal left sides.

    ``rep`` marks one member of each family of equal suffixes, the earliest. Families are in
    sorted order, so suffixes share n bytes on the right when no neighbour between shares less.
    """
    if not len(family):
        return []
    at_first = np.flatnonzero(np.r_[True, np.diff(family) > 0])
    shared = common[at_first]
    where = np.flatnonzero(rep)[np.argsort(family[rep], kind="stable")]
    keys = [rep_keys[i] for i in np.argsort(family[rep], kind="stable")]
    gram = gram_size(window)
    kin = np.cumsum(shared < gram)
    several = np.flatnonzero(np.bincount(kin)[kin] > 1)
    if not len(several):
        return []
    offsets = np.cumsum([0] + [len(k) for k in keys])
    data = np.frombuffer(b"".join(keys), np.uint8)
    early = several[np.lexsort((start[where[several]], doc[where[several]], group[where[several]], ids[where[several]]))]
    own = where[early]
    l, r = left[own], right[own]
    width = window - gram + 1
    repeated = np.zeros((len(early), width), bool)
    side = np.zeros(len(early), np.int64)
    for d in range(width):
        if d:
            far = np.flatnonzero(l >= d)
            if not len(far):
                break
            byte = data[offsets[early[far]] + r[far] + d - 1]
            side[far] = np.unique(side[far] * 256 + byte, return_inverse=True)[1]
            side[l < d] = 0
        active = np.flatnonzero((l >= d) & (window - r <= d))
        if len(active) < 2:
            continue
        match = np.cumsum(shared < window - d)[early[active]]
        both = match * (len(early) + 1) + side[active]
        _, first = np.unique(both, return_index=True)
        again = np.ones(len(active), bool)
        again[first] = False
        repeated[active[again], d] = True
    # a suffix's windows in the order of the text begin at the largest distance
    edges = np.diff(repeated[:, ::-1].astype(np.int8), axis=1, prepend=0, append=0)
    row, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    whose = own[row]
    origin = start[whose] + l[row] - (width - 1)
    return [(group[whose], doc[whose], origin + begin, origin + end - 1 + window)]


def cut_texts(group: Group, doc, start, end):
    """(removed, spans, kept bytes) of each document of the group, in its order."""
    n = len(group.buf) - 64
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, group.starts[doc] + start, 1)
    np.add.at(step, group.starts[doc] + end, -1)
    gone = np.cumsum(step[:n]) > 0
    total = np.r_[0, np.cumsum(gone)]
    begins = gone & ~np.r_[False, gone[:-1]]
    inner = group.starts[(group.starts < n) & (group.ends > group.starts)]
    begins[inner] = gone[inner]
    heads = np.r_[0, np.cumsum(begins)]
    kept = [group.buf[s:e][~gone[s:e]].tobytes() if total[e] > total[s] else group.buf[s:e].tobytes()
            for s, e in zip(group.starts, group.ends)]
    return total[group.ends] - total[group.starts], heads[group.ends] - heads[group.starts], kept


def cut_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text",
                keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) and the columns ``keep`` of every row.

    Every byte covered by a ``window``-byte string that also starts earlier (smaller id, or same
    document and earlier start) goes; overlaps count, strings never cross documents and are
    judged on the input. ``kept`` holds the remaining bytes; ``as_text`` gives them as text, without
    what is left of characters whose bytes went in part, and null for a null. Null text counts as empty. Rows of
    a repeated id are separate documents, ordered by text; rows without an id come last. An
    empty table gives no rows. Columns in ``keep`` come back as ``keep_<name>`` so that their
    names never clash; other columns are not read. One exchange of the texts by group serves
    all three passes. Groups and buckets grow in number with the input, not in size; a string
    that very many documents share is one entry per group.
    """
    small_batches(docs)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups, buckets = 64 + total // GROUP_BYTES, 48 + total // BUCKET_BYTES
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    dealt = docs.select(
        F.pmod(F.xxhash64(F.coalesce(ident, F.xxhash64(text))), F.lit(groups)).alias("_g"),
        ident.alias("_id"), text.alias("_text"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep],
    )
    by_group = dealt.groupBy("_g")

    def propose(key, t):
        g = Group(t)
        values = np.unique(short(anchors(g.buf, g.starts, g.ends, window)[3]))
        rows = []
        if len(values):
            owner = bucket_of(values, buckets)
            for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(owner)) + 1):
                rows.append((int(owner[part[0]]), key[0].as_py(), squeeze(values[part])))
        b, k, v = zip(*rows) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(b, pa.int64()), "_g": pa.array(k, pa.int64()), "blob": pa.array(v, pa.binary())})

    def recur(key, t):
        parts = [unsqueeze(x) for x in t["blob"].to_pylist()]
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        equal = values[order][1:] == values[order][:-1]
        several = np.zeros(len(values), bool)
        several[order[1:][equal]] = True
        several[order[:-1][equal]] = True
        out = [(g, key[0].as_py(), np.packbits(several[source == i]).tobytes())
               for i, g in enumerate(t["_g"].to_pylist())]
        k, b, v = zip(*out)
        return pa.table({"_g": pa.array(k, pa.int64()), "bucket": pa.array(b, pa.int64()), "bits": pa.array(v, pa.binary())})

    def runs(key, t, flags):
        rows = []
        if t.num_rows:
            g = Group(t)
            at, lo, hi, h = anchors(g.buf, g.starts, g.ends, window)
            values, inverse, count = np.unique(short(h), return_inverse=True, return_counts=True)
            flagged, owner = count > 1, bucket_of(values, buckets)
            for b, bits in zip(flags["bucket"].to_pylist(), flags["bits"].to_pylist()):
                low, high = np.searchsorted(owner, b), np.searchsorted(owner, b, "right")
                flagged[low:high] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
            rows = [(b, key[0].as_py(), blob) for b, blob in
                    sorted_runs(g, window, flagged[inverse], at, lo, hi, short(h), buckets)]
        b, k, v = zip(*rows) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(b, pa.int64()), "_g": pa.array(k, pa.int64()), "blob": pa.array(v, pa.binary())})

    def merge(key, t):
        group, doc, start, end = bucket_spans(list(zip(t["_g"].to_pylist(), t["blob"].to_pylist())), window)
        rows = []
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else ():
            rows.append((int(group[part[0]]), packed([narrow(doc[part]), narrow(start[part]), narrow(end[part])])))
        k, v = zip(*rows) if rows else ((), ())
        return pa.table({"_g": pa.array(k, pa.int64()), "spans": pa.array(v, pa.binary())})

    fields = [dealt.schema[f"keep_{c}"] for c in keep]
    result = T.StructType([
        T.StructField("doc_id", T.LongType()), *fields, T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
    ])
    kept_type = pa.string() if as_text else pa.binary()

    def cut(t, spans):
        parts = [unpacked(x) for x in spans["spans"].to_pylist()]
        doc, start, end = ([np.concatenate([p[i].astype(np.int64) for p in parts]) for i in range(3)]
                           if parts else [np.zeros(0, np.int64)] * 3)
        if not t.num_rows:
            empty = {f.name: pa.array([], pa.null()) for f in result.fields}
            empty |= {f"keep_{c}": t[f"keep_{c}"] for c in keep}
            typed = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": kept_type}
            return pa.table({k: pa.array([], typed[k]) if k in typed else v for k, v in empty.items()})
        g = Group(t)
        removed, count, kept = cut_texts(g, doc, start, end)
        if as_text:
            kept = [k.decode("utf-8", "ignore") if there else None for k, there in zip(kept, g.present)]
        return pa.table({
            "doc_id": g.table["_id"], **{f"keep_{c}": g.table[f"keep_{c}"] for c in keep},
            "n_bytes": pa.array(g.ends - g.starts), "n_removed": pa.array(removed.astype(np.int64)),
            "n_spans": pa.array(count.astype(np.int64)), "kept": pa.array(kept, kept_type),
        })

    proposed = by_group.applyInArrow(propose, "bucket long, _g long, blob binary")
    recurring = proposed.groupBy("bucket").applyInArrow(recur, "_g long, bucket long, bits binary")
    sorted_ = by_group.cogroup(recurring.groupBy("_g")).applyInArrow(runs, "bucket long, _g long, blob binary")
    spans = sorted_.groupBy("bucket").applyInArrow(merge, "_g long, spans binary")
    return by_group.cogroup(spans.groupBy("_g")).applyInArrow(cut, result)


def with_kept_text(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   length_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeats cut out of the text and the length column brought up to date.

    Of a character whose bytes went in part the rest goes too. A row whose text was null or
    untouched keeps it as it is; ties, repeated and missing ids and very long texts as in
    ``cut_repeats``. An empty table gives no rows. All columns of ``docs`` come back in their
    order; the text is exchanged once.
    """
    others = tuple(c for c in docs.columns if c != text_col)
    cut = cut_repeats(docs, window, id_col, text_col, keep=others, as_text=True)
    changed, out = F.col("n_removed") > 0, []
    for c in docs.columns:
        if c == text_col:
            new = F.col("kept")
        elif c == length_col:
            length = F.length("kept").cast(docs.schema[c].dataType)
            new = F.when(changed, length).otherwise(F.col(f"`keep_{c}`"))
        else:
            new = F.col(f"`keep_{c}`")
        out.append(new.alias(c))
    return cut.select(*out)


def digest(kept: DataFrame) -> DataFrame:
    """The hash of what is left instead of the bytes."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")

