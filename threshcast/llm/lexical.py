"""Ranked lexical search over an index of document shards, best intervals first.

The index holds every document: shards of neighbouring rows, each with its terms in order and
their posting lists. A posting's impact is the whole number it adds to a score, known once the
corpus counts are. Over the impacts of a shard's asked lists lies one sparse table of range
maxima. A search starts with the interval of all documents of the shard; the sum of the lists'
maxima inside an interval bounds every score in it. The interval with the highest bound is
split at the document of its largest impact, that document is scored, and the search ends when
no bound reaches the k-th best score found so far, in this shard or in those before it.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threshcast.llm.base import small_batches
from threshcast.llm.remember import release
from threshcast.session import fresh_path

#: Text and documents of one shard; bytes of items that are searched for at once.
SHARD_BYTES, SHARD_DOCS = 4 << 20, 8192
BLOCK_BYTES = 2 << 20
#: An interval of no more documents is scored whole instead of being split.
LEAF = 128

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other than ASCII characters; A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


_INDEX = (
    "n_docs long, n_terms long, ids binary, lengths binary, terms binary, starts binary, ords binary, tfs binary"
)


def _index_row(ids: list, texts: list[bytes]) -> dict:
    """One shard: per document its id and length, per term in order its documents and counts."""
    found = [terms_of(t) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    every = [t for part in found for t in part]
    known = sorted(set(every))
    place = dict(zip(known, range(len(known))))
    term = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
    key, tf = np.unique(term * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    starts = np.searchsorted(key, np.arange(len(known) + 1) * len(texts))
    known_id = np.array([i is not None for i in ids])
    return {
        "n_docs": int((lengths > 0).sum()),
        "n_terms": int(lengths.sum()),
        "ids": np.r_[known_id.astype(np.int64), [i or 0 for i in ids]].astype("<i8").tobytes(),
        "lengths": lengths.astype("<i8").tobytes(),
        "terms": b"\n".join(known),
        "starts": starts.astype("<i8").tobytes(),
        "ords": (key % len(texts)).astype("<u2").tobytes(),
        "tfs": tf.astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows, written to the shared folder: one row for each shard."""

    def run(batches):
        release()
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(one)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield pa.RecordBatch.from_pylist([_index_row(ids, texts)], schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_index_row(ids, texts)], schema)

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _INDEX.split(", ")])
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    path = fresh_path(docs.sparkSession, "index")
    rows.mapInArrow(run, _INDEX).write.option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


class Shard:
    """Posting lists of the asked terms of one shard, with impacts and range maxima."""

    def __init__(self, row: dict, weights: dict[bytes, int], n_docs: int, n_terms: int) -> None:
        both = np.frombuffer(row["ids"], "<i8")
        self.size = len(both) // 2
        self.known, self.ids = both[: self.size], both[self.size :]
        known = row["terms"].split(b"\n") if row["terms"] else []
        starts = np.frombuffer(row["starts"], "<i8")
        asked = [(i, t) for i, t in enumerate(known) if t in weights]
        which = np.array([i for i, _ in asked], np.int64)
        begin, count = starts[which], starts[which + 1] - starts[which]
        at = _spread(begin, count)
        self.ord = np.frombuffer(row["ords"], "<u2").astype(np.int64)[at]
        tf = np.frombuffer(row["tfs"], "<i4").astype(np.int64)[at]
        lengths = np.frombuffer(row["lengths"], "<i8")
        m = 25 + np.array([75 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        w = np.array([weights[t] for _, t in asked], np.int64)
        list_of = np.repeat(np.arange(len(asked)), count)
        self.impact = w[list_of] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.ord]))
        self.end = np.cumsum(count)
        self.begin = self.end - count
        self.key = list_of * self.size + self.ord  # ascending: lists in order, documents in each
        self.place = {t: i for i, (_, t) in enumerate(asked)}
        self.best = self._table(int(count.max(initial=1)))

    def _table(self, longest: int) -> list[np.ndarray]:
        """``best[k][i]``: the place of the largest of the 2^k impacts from i on, first of equals.

        One table over all lists one after another; ranges asked for stay within a list.
        """
        levels = [np.arange(len(self.impact))]
        for k in range(1, longest.bit_length()):
            left, half = levels[-1][: -(1 << (k - 1))], levels[-1][1 << (k - 1) :]
            levels.append(np.where(self.impact[left] >= self.impact[half], left, half))
        return levels

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of the largest impact in each range of places (low to high, not empty)."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            a, b = self.best[k][low[own]], self.best[k][high[own] - (1 << k)]
            out[own] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out

    def scores(self, lists: np.ndarray, times: np.ndarray, low: np.ndarray, high: np.ndarray, a: int, b: int) -> np.ndarray:
        """Scores of the documents from a to b: the lists' postings there, added up."""
        at = _spread(low, high - low)
        out = np.zeros(b - a, np.int64)
        np.add.at(out, self.ord[at] - a, self.impact[at] * np.repeat(times, high - low))
        return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Best:
    """The k best (score, id) so far; equal scores by ascending id, a missing id last."""

    def __init__(self, k: int) -> None:
        self.k, self.heap = k, []

    def least(self) -> int:
        """A score below this can't come in any more."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, known: bool, one: int) -> None:
        row = (score, known, -one)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, row)
        elif row > self.heap[0]:
            heapq.heapreplace(self.heap, row)

    def add_many(self, shard: Shard, first: int, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least())
        if len(good) > self.k:  # only the k first of them by score and id can stay
            ids, known = shard.ids[first + good], shard.known[first + good]
            good = good[np.lexsort((ids, -known, -scores[good]))[: self.k]]
        for i in good.tolist():
            self.add(int(scores[i]), bool(shard.known[first + i]), int(shard.ids[first + i]))


def search(shard: Shard, item: Counter, best: Best) -> None:
    """Brings the shard's documents that belong among the best into ``best``."""
    own = [(shard.place[t], n) for t, n in item.items() if t in shard.place]
    if not own:
        return
    lists, times = (np.array(c, np.int64) for c in zip(*sorted(own)))
    waiting: list[tuple] = []

    def wait(a: int, b: int, low: np.ndarray, high: np.ndarray, of: np.ndarray) -> None:
        some = high > low
        low, high, of = low[some], high[some], of[some]
        if a >= b or not len(low):
            return
        top = shard.maxima(low, high)
        gains = shard.impact[top] * times[of]
        bound = int(gains.sum())
        if bound >= best.least():
            heapq.heappush(waiting, (-bound, a, b, low, high, of, int(top[gains.argmax()])))

    wait(0, shard.size, shard.begin[lists], shard.end[lists], np.arange(len(lists)))
    while waiting:
        bound, a, b, low, high, of, top = heapq.heappop(waiting)
        if -bound < best.least():
            return
        if b - a <= LEAF:
            best.add_many(shard, a, shard.scores(lists[of], times[of], low, high, a, b))
            continue
        middle = int(shard.ord[top])
        here = np.searchsorted(shard.key, lists[of] * shard.size + middle)
        holds = (here < high) & (shard.ord[np.minimum(here, len(shard.ord) - 1)] == middle)
        score = int((shard.impact[here[holds]] * times[of][holds]).sum())
        if score >= best.least():
            best.add(score, bool(shard.known[middle]), int(shard.ids[middle]))
        wait(a, middle, low, here, of)
        wait(middle + 1, b, here + holds, high, of)


def rank(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each item, scores above 0.

    Items are searched for in blocks of about ``BLOCK_BYTES``; a block is sent to all tasks, each
    of which goes through its shards of the index and keeps k documents an item. Every row of
    ``items`` is an item of its own, also where ids repeat; a null text has no terms and no result.
    """
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    text = F.coalesce(text_col, F.lit(""))
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text.alias("text"))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    schema = "item long, item_id long, doc_id long, score long"
    out = None
    for b in range(blocks if n_terms else 0):
        asked = [(r["item_id"], Counter(terms_of(r["text"].encode()))) for r in rows.filter(block == b).collect()]
        ranked = _block(index, asked, n_docs, n_terms, k, schema, b)
        out = ranked if out is None else out.union(ranked)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def _block(index: DataFrame, asked: list, n_docs: int, n_terms: int, k: int, schema: str, number: int) -> DataFrame:
    wanted = frozenset(t for _, item in asked for t in item)

    def frequencies(batches):
        found: Counter = Counter()
        for batch in batches:
            for known, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes = np.diff(np.frombuffer(starts, "<i8"))
                for i, t in enumerate(known.split(b"\n") if known else []):
                    if t in wanted:
                        found[t] += int(sizes[i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"]
        )

    counted = index.select("terms", "starts").mapInArrow(frequencies, "term binary, df long")
    counted = counted.groupBy("term").agg(F.sum("df").alias("df")).collect()  # terms of the block at most
    weights = {bytes(r["term"]): weight(n_docs, r["df"]) for r in counted}

    def searched(batches):
        release()
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.slice(row, 1).to_pylist()[0], weights, n_docs, n_terms)
                for (_, item), own in zip(asked, best):
                    search(shard, item, own)
        rows = [
            (number << 40 | i, asked[i][0], -one if known else None, score)
            for i, own in enumerate(best)
            for score, known, one in own.heap
        ]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc_id", "score"]
        )

    return index.mapInArrow(searched, schema)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents for every item.

    Every document row is indexed: null and empty texts have no terms and are never found, rows
    with a repeated id are documents of their own, a missing id comes last among equal scores.
    Empty tables give no rows; columns other than id and text are not looked at.
    """
    return rank(build_index(docs), items, k)
