"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Merges go by rank, so what follows a text can change its tokens only through a chain of merges
of falling rank that starts at its end. ``lookahead`` follows all chains the merge list allows
and gives the most bytes that one can span: token borders further from the end than that are
final, whatever comes. The transducer keeps those bytes and one block, and emits the rest.

Two facts make this right. A border that survives all merges parts a text into two that are
encoded on their own; and where two texts with a common beginning differ first at a border p,
the merge of t and u across p was kept from one of them by an earlier merge (t', w) right behind
u, where t' is u or ends u's derivation. Both need each token to be made by one merge only.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.llm.base import small_batches
from threshcast.llm.packing import tokenizer_path
from threshcast.llm.remember import Remembered, held

#: Words whose ids a task remembers at most; later new ones are encoded each time they come.
REMEMBERED = 400_000
#: Characters of a text that are looked at in one go, and bytes that a transducer takes in one go.
CHUNK, BLOCK = 1 << 16, 1 << 12
_SHORT = 64
_NEVER = np.int32(2**31 - 1)

# The classes in which byte-level pre-tokenisers cut, for all texts and for Latin-1.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_LATIN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
_CUTS, _LATIN_CUTS = regex.compile(_PATTERN), re.compile(_LATIN)
_RUNS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")]


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes behind a border after which nothing can move it any more (one character a byte).

    ``reach`` of a merge (t, u) is the length of u and the longest reach of an earlier merge that
    takes u, or a right end of u's derivation before that was used up, as its left part.
    """
    made: set[str] = set()
    left: dict[str, int] = {}  # the longest reach so far of merges with this left part
    ends: dict[str, int] = {}  # the same for the right ends of a token's derivation
    most = 0
    for a, b in merges:
        if a + b in made or len(a + b) < 2:
            raise ValueError("a token is made by two merges: no bounded lookahead is known")
        made.add(a + b)
        reach = len(b) + max(left.get(b, 0), ends.get(b, 0))
        most = max(most, reach)
        ends[a + b] = max(left.get(b, 0), ends.get(b, 0))
        left[a] = max(left.get(a, 0), reach)
    return most


class ByteModel:
    """Merges, ids and bytes of a byte-level BPE model file (the tokenizers library's JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or odd or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE models without a normaliser are supported")
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("only the byte-level pre-tokeniser without a prefix blank is supported")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take blanks or stand alone are not supported")
        names = byte_names()
        ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = lookahead(pairs)
        self.first = np.zeros(256, np.int32)
        for name, byte in names.items():
            self.first[byte] = ids[name]
        self.size = 1 + max([*ids.values(), *[t["id"] for t in spec["added_tokens"]]])
        rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.rank = rank
        keys = np.array([a * self.size + b for a, b in rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in rank.values()], np.int32)[order]
        self.merged = np.zeros(len(pairs), np.int32)
        for r, made in rank.values():
            self.merged[r] = made
        self.bytes = [b""] * self.size
        for name, i in ids.items():
            self.bytes[i] = bytes(names[c] for c in name)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            known = all(c in names for c in content)
            self.bytes[i] = bytes(names[c] for c in content) if known else content.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("|".join(map(re.escape, longest_first))) if self.added else None
        self.texts = [str(i) for i in range(self.size)]

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many short words at once: every round does the first merge of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(flat):
            rank = np.full(len(flat), _NEVER, np.int32)
            same = word[:-1] == word[1:]
            rank[:-1][same] = self._pair_ranks(flat[:-1][same], flat[1:][same])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(flat)]))
            open_ = least != _NEVER
            done_ids.append(flat[~open_])
            done_words.append(word[~open_])
            flat, word, rank, least = flat[open_], word[open_], rank[open_], least[open_]
            if not len(flat):
                break
            hit = rank == least
            # of hits in a row (the same token again and again) every other one counts
            index = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, 0))
            at = index[hit & ((index - begin) % 2 == 0)]
            flat[at] = self.merged[rank[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            flat, word = flat[stay], word[stay]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
        of = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(words))
        return np.split(ids[order], np.cumsum(counts)[:-1]) if words else []

    def block(self, data: bytes) -> list[int]:
        """Ids of one longer run of bytes, merges taken from a heap by rank and place."""
        ids = self.first[np.frombuffer(data, np.uint8)].tolist()
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = get((made, ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = get((ids[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], made, found[1]))
        return [i for i in ids if i >= 0]


class Transducer:
    """Ids of one run of bytes that comes in parts; holds ``lookahead`` bytes and one block."""

    def __init__(self, model: ByteModel) -> None:
        self.model, self.held = model, b""

    def feed(self, part: bytes) -> Iterator[list[int]]:
        """Ids that nothing behind ``part`` can change."""
        room = BLOCK + self.model.lookahead
        for low in range(0, len(part), BLOCK):
            self.held += part[low : low + BLOCK]
            if len(self.held) < room:
                continue
            final, end, ids = len(self.held) - self.model.lookahead, 0, []
            for i in self.model.block(self.held):
                size = len(self.model.bytes[i])
                if end + size >= final:
                    break
                ids.append(i)
                end += size
            self.held = self.held[end:]
            yield ids

    def finish(self) -> list[int]:
        ids, self.held = self.model.block(self.held), b""
        return ids


class Encoder:
    """Ids of texts in parts of any size: ``feed`` the parts, then ``finish``.

    Held back between parts: what may be the beginning of an added token, the last two words
    (a contraction or blanks may go on), and the transducer of a word that is still open.
    """

    def __init__(self, model: ByteModel, remembered: Remembered | None = None) -> None:
        self.model, self.remembered = model, remembered or word_memory(model)
        self.text = self.rest = ""
        self.open: tuple[Transducer, regex.Pattern] | None = None

    @staticmethod
    def cut(text: str) -> list[str]:
        return (_LATIN_CUTS if text.isascii() or _is_latin(text) else _CUTS).findall(text)

    def _ids(self, words: list[str]) -> Iterator[np.ndarray]:
        if words:
            yield from self.remembered.ids([words])

    def _run(self, part: str) -> Iterator[np.ndarray]:
        """More of the open word; ``rest`` is what lies behind it."""
        transducer, pattern = self.open
        end = pattern.match(part).end()
        blank = pattern is _RUNS[3]
        if blank:  # its last blank belongs to the next word, should there be one
            part, end = self.rest + part, end + len(self.rest) - 1
        for ids in transducer.feed(part[:end].encode()):
            yield np.array(ids, np.int32)
        self.rest = part[end:]
        if len(self.rest) > blank:
            yield np.array(transducer.finish(), np.int32)
            self.open = None

    def _feed(self, part: str) -> Iterator[np.ndarray]:
        if self.open:
            yield from self._run(part)
            if self.open:
                return
            part = ""
        words = self.cut(self.rest + part)
        yield from self._ids(words[:-2])
        last = words[-1] if words else ""
        if len(last) <= CHUNK:
            self.rest = "".join(words[-2:])
            return
        yield from self._ids(words[-2:-1])
        kind = next(i for i, p in enumerate(_RUNS) if p.match(last[1]).end() or i == 3)
        self.open, self.rest = (Transducer(self.model), _RUNS[kind]), ""
        if kind == 3:
            self.rest, last = last[:1], last[1:]
        else:
            yield from map(_array, self.open[0].feed(last[:1].encode()))
            last = last[1:]
        yield from self._run(last)

    def _finish(self) -> Iterator[np.ndarray]:
        if self.open:
            transducer, self.open = self.open[0], None
            yield from map(_array, transducer.feed(self.rest.encode()))
            yield np.array(transducer.finish(), np.int32)
        else:
            yield from self._ids(self.cut(self.rest))
        self.rest = ""

    def feed(self, part: str) -> Iterator[np.ndarray]:
        text, self.text = self.text + part, ""
        done = 0
        if self.model.added_pattern:
            for found in self.model.added_pattern.finditer(text):
                yield from self._feed(text[done : found.start()])
                yield from self._finish()
                yield np.array([self.model.added[found.group()]], np.int32)
                done = found.end()
            tail = text[done:]
            keep = max((k for t in self.model.added for k in range(1, len(t)) if tail.endswith(t[:k])), default=0)
            text, self.text = tail[: len(tail) - keep], tail[len(tail) - keep :]
        if text:
            yield from self._feed(text)

    def finish(self) -> Iterator[np.ndarray]:
        if self.text:
            text, self.text = self.text, ""
            yield from self._feed(text)
        yield from self._finish()

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a whole text, part after part."""
        for low in range(0, len(text), CHUNK):
            yield from self.feed(text[low : low + CHUNK])
        yield from self.finish()


def _array(ids: list[int]) -> np.ndarray:
    return np.array(ids, np.int32)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def word_memory(model: ByteModel, most: int = REMEMBERED) -> Remembered:
    """Ids of words by the transducer: short ones many at once, others in a stream."""

    def encode(words: list[str]) -> list[np.ndarray]:
        parts = [w.encode() for w in words]
        short = [p for p in parts if len(p) <= _SHORT]
        found = iter(model.words(short))
        return [next(found) if len(p) <= _SHORT else _long(model, p) for p in parts]

    return Remembered(encode, "<i4", most)


def _long(model: ByteModel, data: bytes) -> list[int]:
    transducer = Transducer(model)
    return [*(i for ids in transducer.feed(data) for i in ids), *transducer.finish()]


class Decoder:
    """Text of ids that come in parts: bytes of an unfinished character wait for the next ones.

    Bytes that are no UTF-8 give U+FFFD, one for each longest beginning of a character.
    """

    def __init__(self, model: ByteModel) -> None:
        self.bytes = model.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def transcode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
              with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, and the ``ids`` if wanted.

    A null text counts as empty: no tokens, digests of nothing. Every row is taken by itself, so
    ids may repeat or be missing; an empty table gives no rows, other columns are ignored. A very
    long text goes through part by part; its ids are never held together unless asked for.
    ``model`` is a path on every machine.
    """

    def run(batches):
        loaded, memory = held((ByteModel, model), lambda: _loaded(model))
        kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if with_ids else [])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [_digests(loaded, ids, with_ids) for ids in encode_texts(loaded, memory, texts)]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)

    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def _loaded(path: str) -> tuple[ByteModel, Remembered]:
    model = ByteModel(path)
    return model, word_memory(model)


def encode_texts(model: ByteModel, memory: Remembered, texts: list[str]) -> Iterator[Iterable[np.ndarray]]:
    """For each text its ids in parts, made while they are asked for.

    Texts of one part and without added tokens are looked up together, a few at a time.
    """
    special, at = model.added_pattern, 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= 8 * CHUNK and len(texts[end]) <= CHUNK:
            if special and special.search(texts[end]):
                break
            size, end = size + len(texts[end]), end + 1
        for ids in memory.ids([Encoder.cut(t) for t in texts[at:end]]):
            yield (ids,)
        if end == at or (end < len(texts) and size + len(texts[end]) <= 8 * CHUNK):
            yield Encoder(model, memory).encode(texts[end])
            end += 1
        at = end


def _digests(model: ByteModel, parts: Iterable[np.ndarray], with_ids: bool) -> tuple:
    decoder = Decoder(model)
    of_ids, of_text = hashlib.sha256(), hashlib.sha256()
    count, kept = 0, []
    for part in parts:
        if not len(part):
            continue
        ids = part.tolist()
        of_ids.update((b"," if count else b"") + ",".join(map(model.texts.__getitem__, ids)).encode())
        of_text.update(decoder.feed(ids).encode())
        count += len(ids)
        if with_ids:
            kept += ids
    of_text.update(decoder.finish().encode())
    return (count, of_ids.hexdigest(), of_text.hexdigest(), *([kept] if with_ids else []))


def byte_model_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")
