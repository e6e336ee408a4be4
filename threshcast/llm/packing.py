"""Best-fit packing of tokenised documents into sequences, planned on the length histogram."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threshcast.llm.base import small_batches, stored
from threshcast.llm.remember import Remembered, held

#: Strings whose ids a task remembers at most; later new ones are encoded each time they come.
REMEMBERED = 600_000
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: How the tokenizer itself cuts texts of the first 256 code points, after lower-casing.
_CUTS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
)


class WordEncoder:
    """Token ids of texts by ``word_bpe``, each different word encoded once.

    Its pre-tokeniser never joins what a blank parts and drops blanks, so the ids of a text are
    those of its words one after another. Texts of the first 256 code points, where letters and
    digits are few and fixed, are cut as the tokenizer cuts them, which gives fewer different
    strings; others, and texts that may hold its special tokens, are cut at spaces and line ends.
    """

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks keep the cores busy
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode = lambda part: [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        self.remembered = Remembered(encode, "<u4", REMEMBERED if remembered is None else remembered)

    @staticmethod
    def cut(text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return _CUTS.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.remembered.ids([self.cut(t) for t in texts])


def encoder(path: str, remembered: int | None = None) -> WordEncoder:
    """One encoder for each Python worker."""
    return held((WordEncoder, path, remembered), lambda: WordEncoder(path, remembered))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
           remembered: int | None = None) -> DataFrame:
    """Token pieces of every row: ids of the text, then ``end_id``, cut every ``capacity`` ids.

    ``ids_crc32`` is the checksum of the ids as little-endian 32-bit numbers; ``with_ids`` adds
    the ids themselves. ``tokenizer`` is a path on every machine.
    """

    def run(batches):
        enc = encoder(tokenizer, remembered)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows: list[tuple] = []
                blocks = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        block = ids[start : start + capacity]
                        rows.append((doc, k, start, len(block), zlib.crc32(block.tobytes())))
                        blocks.append(block)
                columns = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([b.astype(np.int64) for b in blocks], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths instead of single documents.

    Gives slots (length, first_rank, n, first_sequence, per_sequence, offset): the n pieces of
    ``length`` from rank ``first_rank`` on go to sequences first_sequence, first_sequence + 1,
    ..., ``per_sequence`` to each, the first at ``offset`` and the next behind it. Sequences with
    the same room form one run, so the work depends on how many lengths and rooms there are
    (both at most ``capacity``), not on how many documents.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("a length is below 1 or above the capacity")
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)
    slots, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = capacity // length
                first, many = fresh, -(-left // each)
                fresh += many
                room = capacity
            else:
                each = room // length
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            full = min(many, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, capacity - room))
                rooms[room - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < many and left:
                slots.append((length, rank, left, first + full, left, capacity - room))
                rooms[room - left * length].append((first + full, 1))
                left, full = 0, full + 1
            if full < many:
                rooms[room].append((first + full, many - full))
        rooms.pop(0, None)
    return slots


SLOTS = "length long, first_rank long, n long, first_sequence long, per_sequence long, offset0 long"


def pack(cut: DataFrame, capacity: int, id_col: str = "doc_id", piece_col: str = "piece") -> DataFrame:
    """``cut`` (rows with a ``length``) with ``sequence_id`` and ``offset``, as few sequences as
    best fit gives.

    The histogram (at most ``capacity`` rows) is planned on the driver; its slots are broadcast,
    at most about capacity squared / 2 small rows whatever the input. Rows take slots by rank
    within their length. Ranks are counted in parts of a length, then shifted by the sizes of
    the parts before, so a length that most rows share is not gathered. ``cut`` must be a stored
    table, as it is read three times. Rows with the same id and piece take different slots.
    """
    spark = cut.sparkSession
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    total = sum(r.n for r in counted)
    parts = max(1, total // 4096)
    slots = spark.createDataFrame(plan({r.length: r.n for r in counted}, capacity), SLOTS)
    part = F.pmod(F.xxhash64(id_col, piece_col), F.lit(parts))
    sizes = cut.groupBy("length", part.alias("part")).agg(F.count("*").alias("size"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("length", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    local = W.partitionBy("length", "part").orderBy(id_col, piece_col)
    ranked = (
        cut.withColumn("part", part)
        .withColumn("local_rank", F.row_number().over(local) - 1)
        .join(shifts, ["length", "part"])
        .withColumn("rank", F.col("shift") + F.col("local_rank"))
    )
    inside = F.col("rank") - F.col("first_rank")
    slot = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    fits = (
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("n"))
    )
    return ranked.join(slot, fits).select(
        *[F.col(f"`{c}`") for c in cut.columns],
        (F.col("first_sequence") + F.floor(inside / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("offset0") + inside % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                   remembered: int | None = None) -> DataFrame:
    """Every document's pieces with their sequence and place.

    Null text counts as empty (one piece, the end id alone). Longer documents are cut into pieces
    of ``capacity``; nothing else is cut. Rows with a repeated or missing id are packed as
    documents of their own. An empty table gives no rows; other columns are ignored.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids, remembered), "pieces")
    return pack(cut, capacity)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
