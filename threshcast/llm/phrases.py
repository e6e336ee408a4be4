"""Phrase collocations from weighted acyclic automata over words.

1. Tasks count the n-grams of up to ``longest`` words of their texts, a shard at a time, sort them
   and build an acyclic count transducer: an arc's weight is how often the words up to it occur in
   a row, and states with equal arcs behind them are one state. A shard's automaton is cut into
   prefix ranges, so what is exchanged is one blob for each shard and range.
2. Each prefix range unites its automata and sums their weights. Ranges come from a sample of
   whole n-grams, so a frequent first word or pair spreads over several of them; sums of what lies
   across a border are added up afterwards.
3. Candidates ask for the counts of their parts. Requests go to the range of the part and are
   composed with its automaton. A range that many ask is copied, each copy answers some of them.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threshcast.llm.base import forget, small_batches, stored
from threshcast.llm.remember import release

#: Bytes of text of one shard, and of the part of the corpus whose n-grams make one prefix range.
SHARD_BYTES, RANGE_BYTES = 8 << 20, 12 << 20
#: Requests that one copy of a range answers.
REQUESTS = 400_000
#: Documents of the sample that the ranges are taken from, and its n-grams for each range.
SAMPLE_DOCS, SAMPLE_GRAMS = 4000, 100
_KEY_BYTES = 64

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECE_END = re.compile(b"[" + _ENDS + b"]")
_FOLD = bytes(
    10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def _slices(text: bytes):
    """A long text in parts of about a shard, cut behind the end of a piece."""
    low = 0
    while len(text) - low > SHARD_BYTES:
        end = _PIECE_END.search(text, low + SHARD_BYTES)
        if end is None:
            break
        yield text[low : end.end()]
        low = end.end()
    yield text[low:]


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words in byte order, and all words in text order by their place in that list,
    from 1; 0 stands where a piece ends."""
    found = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
    known = sorted(set(found) - {b"", b"\n"})
    place = dict(zip(known, range(1, len(known) + 1)))
    place[b""], place[b"\n"] = -1, 0
    ids = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
    return known, ids[ids >= 0]


def grams_of(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each word the ``longest`` words from it on, one array for each; 0 behind the piece."""
    padded = np.concatenate([ids, np.zeros(longest, np.int64)])
    parts = [padded[k : k + len(ids)] for k in range(longest)]
    for k in range(1, longest):
        parts[k] = np.where(parts[k - 1] > 0, parts[k], 0)
    starts = ids > 0
    return [p[starts] for p in parts]


def summed(parts: list[np.ndarray], weights: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different n-grams in order and the sums of their weights; ids are at most ``size``."""
    if not len(weights):
        return parts, weights
    bits = max(1, int(size).bit_length())
    if bits * len(parts) < 64:
        key = parts[0]
        for p in parts[1:]:
            key = key << bits | p
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(parts[::-1])
    parts = [p[order] for p in parts]
    first = np.flatnonzero(_changes(parts))
    return [p[first] for p in parts], np.add.reduceat(weights[order], first)


def _changes(parts: list[np.ndarray]) -> np.ndarray:
    """True where a row of sorted n-grams differs from the one before."""
    new = np.zeros(len(parts[0]), bool)
    new[:1] = True
    for p in parts:
        new[1:] |= p[1:] != p[:-1]
    return new


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges (start, size), one range after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)


@dataclass
class Layer:
    """Arcs of all states of one depth: state s has arcs first[s] to first[s + 1], by label."""

    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray


class Counts:
    """Acyclic automaton of n-grams; the weight of a path's last arc is how often it occurs.

    Labels are places in ``words`` from 1. ``target`` is a state of the next layer, -1 for none.
    """

    def __init__(self, words: list[bytes], layers: list[Layer]) -> None:
        self.words, self.layers = words, layers

    @classmethod
    def build(cls, words: list[bytes], parts: list[np.ndarray], weights: np.ndarray, share: bool = True) -> Counts:
        """From different n-grams in order (0 behind their end). A state is final once all
        n-grams of its prefix have gone by; equal states are then kept once (``share``)."""
        layers: list[Layer] = []
        target_of_row = np.full(len(weights), -1)  # state behind each row's words up to the depth
        for depth in range(len(parts) - 1, -1, -1):
            rows = np.flatnonzero(parts[depth] > 0)
            arcs = rows[_changes([p[rows] for p in parts[: depth + 1]])]
            own = np.where(parts[depth] > 0, weights, 0)  # n-grams that end before are not the arc's
            sums = np.add.reduceat(own, arcs) if len(arcs) else np.zeros(0, np.int64)
            begins = np.flatnonzero(_changes([p[arcs] for p in parts[:depth]])) if depth else np.zeros(min(1, len(arcs)), np.int64)
            layer = Layer(np.r_[begins, len(arcs)], parts[depth][arcs], sums, target_of_row[arcs])
            state = np.arange(len(begins))
            if share and depth:
                layer, state = _shared(layer)
            layers.append(layer)
            target_of_row = np.full(len(weights), -1)
            if depth:
                # the state belongs to the first row of its prefix, which may be a row that ends there
                prefix = np.flatnonzero(_changes(parts[:depth]))
                owner = np.searchsorted(prefix, arcs[begins], side="right") - 1
                target_of_row[prefix[owner]] = state
        return cls(words, layers[::-1])

    def grams(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The n-grams it was built from: a path weighs what its further arcs don't take over."""
        depth = len(self.layers)
        root = self.layers[0]
        at = np.arange(len(root.label))
        path = [root.label]
        out_parts: list[list[np.ndarray]] = [[] for _ in range(depth)]
        out_weights = []
        for k, layer in enumerate(self.layers):
            weight, target = layer.weight[at], layer.target[at]
            rest, size = weight.copy(), np.zeros(len(at), np.int64)
            if k + 1 < depth:
                below = self.layers[k + 1]
                go = target >= 0
                size[go] = below.first[target[go] + 1] - below.first[target[go]]
                total = np.add.reduceat(np.r_[below.weight, 0], below.first[:-1]) if len(below.label) else np.zeros(0)
                rest[go] -= total[target[go]].astype(np.int64)
            stay = rest > 0
            for j in range(depth):
                out_parts[j].append(path[j][stay] if j <= k else np.zeros(int(stay.sum()), np.int64))
            out_weights.append(rest[stay])
            if k + 1 < depth:
                start = np.where(target >= 0, below.first[np.maximum(target, 0)], 0) if len(below.label) else np.zeros(len(at), np.int64)
                again = np.repeat(np.arange(len(at)), size)
                at = _spread(start, size)
                path = [p[again] for p in path] + [below.label[at]]
        return [np.concatenate(p) for p in out_parts], np.concatenate(out_weights)

    def compose(self, asked: list[list[bytes]]) -> np.ndarray:
        """Weights of phrases (lists of words): the acceptor of the phrases is followed through
        the layers, all phrases at once; 0 for a phrase that no path spells."""
        place = dict(zip(self.words, range(1, len(self.words) + 1)))
        depth = len(self.layers)
        if any(not 0 < len(p) <= depth for p in asked):
            raise ValueError("a phrase has no words or more than the automaton")
        labels = np.array([[place.get(w, -1) for w in p] + [0] * (depth - len(p)) for p in asked], np.int64)
        labels = labels.reshape(len(asked), depth)
        out, state = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        live = np.arange(len(asked))
        base = len(self.words) + 2
        for k, layer in enumerate(self.layers):
            owner = np.repeat(np.arange(len(layer.first) - 1), np.diff(layer.first))
            keys = owner * base + layer.label
            live = live[(labels[live, k] > 0) & (state[live] >= 0)]
            if not len(keys) or not len(live):
                out[live] = 0
                break
            want = state[live] * base + labels[live, k]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            ends = labels[live, k + 1] == 0 if k + 1 < depth else np.ones(len(live), bool)
            out[live[hit & ends]] = layer.weight[at[hit & ends]]
            live, at = live[hit & ~ends], at[hit & ~ends]
            state[live] = layer.target[at]
        return out

    def dump(self) -> bytes:
        slim = [tuple(_slim(x) for x in (y.first, y.label, y.weight, y.target)) for y in self.layers]
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((b"\n".join(self.words), slim), 5))

    @classmethod
    def load(cls, blob: bytes) -> Counts:
        words, layers = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        return cls(words.split(b"\n") if words else [], [Layer(*(x.astype(np.int64) for x in y)) for y in layers])


def _slim(x: np.ndarray) -> np.ndarray:
    """Numbers (-1 and more) in as few bytes as hold them."""
    top = int(x.max(initial=0))
    return x.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _shared(layer: Layer) -> tuple[Layer, np.ndarray]:
    """Equal states kept once, and for each old state the new one."""
    n = len(layer.first) - 1
    if n < 2:
        return layer, np.arange(n)
    size = np.diff(layer.first)
    arc = np.zeros(len(layer.label), np.uint64)
    for values, odd in ((layer.label, 0x9E3779B97F4A7C15), (layer.weight, 0xC2B2AE3D27D4EB4F), (layer.target + 1, 0x165667B19E3779F9)):
        arc = (arc ^ values.astype(np.uint64)) * np.uint64(odd)
        arc ^= arc >> np.uint64(29)
    digest = np.add.reduceat(arc, layer.first[:-1])
    order = np.lexsort((digest, size))
    new = np.r_[True, (digest[order][1:] != digest[order][:-1]) | (size[order][1:] != size[order][:-1])]
    twin = np.empty(n, np.int64)
    twin[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    # equal digests are checked arc by arc; a state that only seems equal stays as it is
    mine, its = _spread(layer.first[:-1], size), _spread(layer.first[twin], size)
    same = np.ones(len(mine), bool)
    for values in (layer.label, layer.weight, layer.target):
        same &= values[mine] == values[its]
    equal = np.logical_and.reduceat(same, np.cumsum(size) - size)
    twin = np.where(equal, twin, np.arange(n))
    keep = np.flatnonzero(twin == np.arange(n))
    number = np.cumsum(twin == np.arange(n)) - 1
    at = _spread(layer.first[keep], size[keep])
    return Layer(np.r_[0, np.cumsum(size[keep])], layer.label[at], layer.weight[at], layer.target[at]), number[twin]


def union(automata: list[Counts]) -> Counts:
    """One automaton with the summed weights of all."""
    words = pa.chunked_array([pa.array(a.words, pa.binary()) for a in automata], pa.binary()).unique()
    words = words.take(pc.array_sort_indices(words)).to_pylist()
    place = dict(zip(words, range(1, len(words) + 1)))
    depth = len(automata[0].layers)
    parts: list[list[np.ndarray]] = [[] for _ in range(depth)]
    weights = []
    for a in automata:
        turned = np.fromiter((place[w] for w in a.words), np.int64, len(a.words))
        own, weight = a.grams()
        for k, p in enumerate(own):
            parts[k].append(np.r_[0, turned][p])
        weights.append(weight)
    every, total = summed([np.concatenate(p) for p in parts], np.concatenate(weights), len(words))
    return Counts.build(words, every, total, share=False)


def route(cuts: list[tuple], words: tuple) -> int:
    """The prefix range of an n-gram: how many cuts are not above it."""
    return bisect_right(cuts, words)


def _borders(cuts: list[tuple], known: list[bytes], parts: list[np.ndarray]) -> list[int]:
    """Where each cut falls in n-grams in order; words are compared, a prefix comes first."""
    out = []
    for cut in cuts:
        low, high = 0, len(parts[0])
        for k, word in enumerate(cut):
            i = bisect_left(known, word)
            exact = i < len(known) and known[i] == word
            column = parts[k][low:high]
            begin = low + int(np.searchsorted(column, i + 1, "left"))
            if not exact:
                low = high = begin
                break
            low, high = begin, low + int(np.searchsorted(column, i + 1, "right"))
        out.append(low)
    return out


def shard(texts: list[bytes], longest: int, cuts: list[tuple]):
    """(range, automaton) of the n-grams of some texts."""
    known, ids = words_of(texts)
    parts = grams_of(ids, longest)
    parts, weights = summed(parts, np.ones(len(parts[0]), np.int64), len(known))
    borders = [0, *_borders(cuts, known, parts), len(weights)]
    for number, (low, high) in enumerate(zip(borders, borders[1:])):
        if low < high:
            own = [p[low:high] for p in parts]
            used = np.unique(np.concatenate(own))
            used = used[used > 0]
            words = [known[i - 1] for i in used.tolist()]
            turn = np.zeros(len(known) + 1, np.int64)
            turn[used] = np.arange(1, len(used) + 1)
            yield number, Counts.build(words, [turn[p] for p in own], weights[low:high])


def _layout(docs: DataFrame, longest: int) -> dict[str, list[tuple]]:
    """Cuts between the prefix ranges of every language of more than one range.

    Sizes are counted over all texts; the n-grams that become cuts come from a sample. Its size
    is a parameter, and only how even the ranges are depends on it, not the result.
    """
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n"))
    large = {r["lang"]: (r["size"], r["n"]) for r in sizes.filter(F.col("size") > RANGE_BYTES).collect()}
    if not large:
        return {}
    share = min(1.0, SAMPLE_DOCS / min(n for _, n in large.values()))
    wanted = {k: SAMPLE_GRAMS * (1 + size // RANGE_BYTES) / (1 + size * share / 6) for k, (size, _) in large.items()}

    def run(batches):
        draw = np.random.default_rng(1)
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                known, ids = words_of([text])
                parts = grams_of(ids, longest)
                pick = np.flatnonzero(draw.random(len(parts[0])) < wanted[lang])
                for row in zip(*(p[pick].tolist() for p in parts)):
                    found.append((lang, [known[i - 1][:_KEY_BYTES] for i in row if i]))
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.binary()))], names=["lang", "gram"]
            )

    some = docs.filter(F.col("lang").isin(list(large))).sample(False, share, 1)
    grams: dict[str, list[tuple]] = {k: [] for k in large}
    for r in some.mapInArrow(run, "lang string, gram array<binary>").collect():
        grams[r["lang"]].append(tuple(bytes(w) for w in r["gram"]))
    cuts = {}
    for lang, (size, _) in large.items():
        found, ranges = sorted(grams[lang]), 1 + size // RANGE_BYTES
        at = [len(found) * i // ranges for i in range(1, ranges)]
        cuts[lang] = sorted({found[i] for i in at if i < len(found)})
    return cuts


#: a and the product l r may have 16 digits: exact, and an error beyond.
_SCORE = (
    "(CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)) * CAST(a AS DECIMAL(38,0)))"
    " DIV (CAST(l AS DECIMAL(38,0)) * CAST(r AS DECIMAL(38,0)))"
)
_GRAMS = "lang string, range int, words array<binary>, weight long"


def _count(docs: DataFrame, cuts: dict[str, list[tuple]], longest: int, least: int) -> DataFrame:
    """(lang, range, words, weight): n-grams of ``least`` and more, with no words all of a range;
    what the borders of a range may part is given whatever its weight."""

    def shards(batches):
        release()
        texts: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for part in _slices(text):
                    texts.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= SHARD_BYTES:
                        yield from blobs(texts)
                        texts, size = {}, 0
        yield from blobs(texts)

    def blobs(texts):
        for lang in list(texts):
            for number, found in shard(texts.pop(lang), longest, cuts.get(lang, [])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([number], pa.int32()), pa.array([found.dump()], pa.binary())],
                    names=["lang", "range", "blob"],
                )

    def unite(key, group):
        release()
        lang, number = key[0].as_py(), key[1].as_py()
        whole = union([Counts.load(b.as_py()) for b in group.column("blob")])
        words, weights = [], []
        words.append([])
        weights.append(int(whole.layers[0].weight.sum()))
        name = [None, *whole.words]
        path = [whole.layers[0].label]
        for k, layer in enumerate(whole.layers):
            keep = layer.weight >= least
            if k + 1 < len(whole.layers) and len(keep):
                keep[[0, -1]] = True  # its first and last n-gram may go on in another range
            for row in zip(*(p[keep].tolist() for p in path)):
                words.append([name[i] for i in row])
            weights += layer.weight[keep].tolist()
            if k + 1 < len(whole.layers):
                below = whole.layers[k + 1]
                owner = np.full(len(below.first) - 1, -1)
                go = layer.target >= 0
                owner[layer.target[go]] = np.flatnonzero(go)
                again = np.repeat(owner, np.diff(below.first))
                path = [p[again] for p in path] + [below.label]
        n = len(weights)
        return pa.Table.from_arrays(
            [pa.array([lang] * n), pa.array([number] * n, pa.int32()),
             pa.array(words, pa.list_(pa.binary())), pa.array(weights, pa.int64())],
            names=["lang", "range", "words", "weight"],
        )

    made = docs.mapInArrow(shards, "lang string, range int, blob binary")
    # a partition for about each range, so that a task unites few of them however many there are
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = made.repartition(max(tasks, 2 * sum(len(c) + 1 for c in cuts.values())), "lang", "range")
    return made.groupBy("lang", "range").applyInArrow(unite, _GRAMS)


def _ask(counts: DataFrame, parts: DataFrame, cuts: dict[str, list[tuple]]) -> DataFrame:
    """``parts`` (lang, part, ...) with ``f``, the weight of the part in ``counts``."""

    def routed(batches):
        for batch in batches:
            names = batch.schema.names
            lang, words = (batch.column(names.index(c)).to_pylist() for c in ("lang", "part"))
            own = [route(cuts.get(a, []), tuple(w)) for a, w in zip(lang, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*names, "range"])

    def schema(df: DataFrame) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    asked = stored(parts.mapInArrow(routed, schema(parts) + ", range int"), "asked")
    own = counts.select("lang", F.col("words").alias("part"), "weight").mapInArrow(
        routed, "lang string, part array<binary>, weight long, range int"
    )
    many = asked.groupBy("lang", "range").agg(F.ceil(F.count("*") / F.lit(REQUESTS)).cast("int").alias("copies"))
    asked = asked.join(F.broadcast(many), ["lang", "range"])
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("phrase"), F.col("copies")).cast("int")).drop("copies")
    own = own.join(F.broadcast(many), ["lang", "range"])
    own = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    out = [c for c in asked.columns if c not in ("copy", "range")]

    def answer(key, left, right):
        words = sorted({w for p in left.column("part").to_pylist() for w in p})
        place = dict(zip(words, range(1, len(words) + 1)))
        grams = left.column("part").to_pylist()
        depth = max([1, *map(len, grams), *(len(p) for p in right.column("part").to_pylist())])
        rows = sorted(([place[w] for w in p] + [0] * (depth - len(p)), n) for p, n in zip(grams, left.column("weight").to_pylist()))
        answers = _known(words, rows, depth).compose(right.column("part").to_pylist()) if rows else [0] * right.num_rows
        return pa.Table.from_arrays([*(right.column(c) for c in out), pa.array(answers, pa.int64())], names=[*out, "f"])

    kinds = ", ".join(f"{c} {dict(asked.dtypes)[c]}" for c in out)
    return own.groupBy("lang", "range", "copy").cogroup(asked.groupBy("lang", "range", "copy")).applyInArrow(answer, kinds + ", f long")


def _known(words: list[bytes], rows: list[tuple[list[int], int]], depth: int) -> Counts:
    """An automaton whose paths are the given phrases in order, each with its own weight; a
    phrase whose beginning is not given gets a path that weighs nothing on the way."""
    every: dict[tuple, int] = {}
    for ids, n in rows:
        for k in range(1, depth + 1):
            if ids[k - 1]:
                every.setdefault(tuple(ids[:k]), 0)
        every[tuple(i for i in ids if i)] = n
    layers, states = [], {(): 0}
    for k in range(1, depth + 1):
        level = sorted(p for p in every if len(p) == k)
        begin = np.zeros(len(states) + 1, np.int64)
        for p in level:
            begin[states[p[:-1]] + 1] += 1
        layers.append(Layer(np.cumsum(begin), np.array([p[-1] for p in level], np.int64),
                            np.array([every[p] for p in level], np.int64), np.arange(len(level))))
        states = {p: i for i, p in enumerate(level)}
    return Counts(words, layers)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside: int = 50,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Phrases of 2 to ``longest`` words whose parts go together more than chance has it.

    Per language: n words in all, f(phrase) contiguous occurrences within pieces, candidates with
    f >= ``least``; of the ways to cut a candidate in two the one with the least
    floor(1000000 a^2 / (l r)) counts. Candidates inside a longer candidate with at least
    ``inside`` percent of their occurrences are dropped. The first ``top`` of each language by
    score, a and phrase are returned. Null texts count as empty, a null language as ``und``; no
    candidates, no rows. Equal texts count each time; ids and other columns are not looked at.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    small_batches(docs)
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    cuts = _layout(rows, longest)
    parted = stored(_count(rows, cuts, longest, least), "grams")
    counts = parted.groupBy("lang", "words").agg(F.sum("weight").alias("weight"))
    counts = stored(counts.filter((F.col("weight") >= least) | (F.size("words") == 0)), "counts")
    forget(parted)
    words, size = F.col("words"), F.size("words")
    phrase = F.array_join(F.transform(words, lambda w: w.cast("string")), " ")
    found = counts.filter(size > 1).select("lang", phrase.alias("phrase"), "words", F.col("weight").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    sides = found.select("lang", "phrase", "a", "words", cut)
    left, right = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, size)
    sides = sides.select(
        "lang", "phrase", "a", "k",
        F.explode(F.array(F.struct(F.lit("l").alias("side"), left.alias("part")),
                          F.struct(F.lit("r").alias("side"), right.alias("part")))).alias("s"),
    ).select("lang", "phrase", "a", "k", "s.side", "s.part")
    answers = _ask(counts.filter(size.between(1, longest - 1)), sides, cuts)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    by_cut = answers.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), of("l"), of("r"))
    scored = by_cut.withColumn("score", F.expr(_SCORE))
    best = scored.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    parts = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m)),
    ))
    covers = found.filter(size > 2).select("lang", F.explode(F.array_distinct(parts)).alias("words"), "a")
    covers = covers.groupBy("lang", phrase.alias("phrase")).agg(F.max("a").alias("most"))
    kept = best.join(covers, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))
    )
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter(size == 0).select("lang", F.col("weight").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
