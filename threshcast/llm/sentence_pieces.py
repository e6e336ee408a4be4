"""SentencePiece models on the tokenizers library: rebuilt from the model file, checked, run in batches."""

from __future__ import annotations

import hashlib
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.llm.remember import Remembered, held

#: Strings whose ids a task remembers at most; later new ones are encoded each time they come.
REMEMBERED = 1_000_000
_MARK = "▁"
# Fixed values of the model file's format: kinds of pieces and of models.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


class PieceCoder:
    """Encoder and decoder with the ids that SentencePiece itself gives.

    The protobuf gives the pieces, their scores and kinds, and the normaliser's settings. A BPE
    model's merges are all pairs of pieces that make a piece, best score first; a unigram model
    takes the scores as they are. If no piece has a marker behind another character, nothing is
    ever merged over the start of a run of markers; texts are then cut there and each different
    string is encoded once, in multithreaded batches. Each new string is also encoded by
    SentencePiece: ``wrong`` holds those with other ids.
    """

    def __init__(self, model: bytes, threads: int = 1):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from tokenizers import Tokenizer, normalizers

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.threads = threads
        self.spec = proto.normalizer_spec
        kinds = [p.type for p in proto.pieces]
        names = [p.piece for p in proto.pieces]
        self.user = sorted((n for n, k in zip(names, kinds) if k == _USER), key=len, reverse=True)
        self.unknown = kinds.index(_UNKNOWN)
        charsmap = self.spec.precompiled_charsmap
        self.charsmap = normalizers.Precompiled(charsmap) if charsmap else None
        self.backend = Tokenizer(self._model(proto, names, kinds))
        self.cuttable = not self.user and not any(re.search(f"[^{_MARK}]{_MARK}", n) for n in names)
        self.bytes = [self._bytes_of(n, k) for n, k in zip(names, kinds)]
        self.remembered = Remembered(self._fresh, "i4", REMEMBERED if self.cuttable else 0)
        self.wrong: set[str] = set()
        # names of pieces that text never gives; a unigram backend would find them in a text
        hidden = [n for n, k in zip(names, kinds) if k not in (_NORMAL, _USER)]
        named = self.user or (hidden if proto.trainer_spec.model_type == _UNIGRAM else [])
        self.left_alone = re.compile("|".join(map(re.escape, named))) if named else None

    def _model(self, proto, names: list[str], kinds: list[int]):
        from tokenizers import models

        trainer = proto.trainer_spec
        if trainer.model_type == _UNIGRAM:
            scores = [(n, p.score) for n, p in zip(names, proto.pieces)]
            return models.Unigram(scores, self.unknown, trainer.byte_fallback)
        if trainer.model_type != _BPE:
            raise ValueError("unigram and BPE models are supported")
        ids = {n: i for i, n in enumerate(names)}
        usable = {n for n, k in zip(names, kinds) if k in (_NORMAL, _USER)}
        pairs = []
        for name in usable:
            for cut in range(1, len(name)):
                left, right = name[:cut], name[cut:]
                if left in usable and right in usable:
                    pairs.append((-proto.pieces[ids[name]].score, ids[left], ids[right], left, right))
        merges = [(left, right) for *_, left, right in sorted(pairs)]
        return models.BPE(ids, merges, unk_token=names[self.unknown], fuse_unk=True, byte_fallback=trainer.byte_fallback)

    def _bytes_of(self, name: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(name[3:5], 16)])
        if kind == _CONTROL:
            return b""
        return (" ⁇ " if kind == _UNKNOWN else name.replace(_MARK, " ")).encode()

    def normalise(self, text: str) -> str:
        """The text as the model sees it: mapped characters, blanks trimmed, markers for blanks."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.spec.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text.lstrip(" ")).rstrip(" " + _MARK)
        if text and self.spec.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", _MARK) if self.spec.escape_whitespaces else text

    def cut(self, text: str) -> list[str]:
        """Strings that can be encoded on their own."""
        return re.findall(f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+", text) if self.cuttable else [text] * bool(text)

    def _fresh(self, strings: list[str]) -> list[list[int]]:
        ids = [e.ids for e in self.backend.encode_batch(strings, add_special_tokens=False)]
        self._verify(strings, ids)
        return ids

    def _verify(self, strings: list[str], ids: list[list[int]]) -> None:
        """SentencePiece's ids of the same strings; its own prefix stands for the first marker."""
        prefixed = self.spec.add_dummy_prefix and not self.spec.remove_extra_whitespaces
        for s, got in zip(strings, ids):
            if self.cuttable and (prefixed or self.spec.remove_extra_whitespaces) and s[0] == _MARK:
                plain = s[1:].replace(_MARK, " ")
                if self.spec.remove_extra_whitespaces and plain != plain.strip(" "):
                    continue
                if plain and self.reference.encode(plain) != got:
                    self.wrong.add(s)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they are SentencePiece's.

        Texts that hold the name of a user-defined piece, or for a unigram model of a control or
        byte piece, are left to SentencePiece itself.
        """
        odd = [i for i, t in enumerate(texts) if self.left_alone and self.left_alone.search(t)]
        split = [self.cut(self.normalise(t)) for t in texts]
        for i in odd:
            split[i] = []
        out = self.remembered.ids(split)
        if self.cuttable:
            same = [not self.wrong or self.wrong.isdisjoint(words) for words in split]
        else:
            same = [x.tolist() == self.reference.encode(t) for t, x in zip(texts, out)]
        for i, ids in zip(odd, self.reference.encode([texts[i] for i in odd], num_threads=self.threads)):
            out[i], same[i] = np.array(ids, np.int32), True
        return out, same

    def decode(self, ids) -> str:
        """The text of ids: bytes joined, markers as blanks, the first blank taken off."""
        table = self.bytes
        raw = b"".join([table[i] for i in ids])
        if self.spec.remove_extra_whitespaces:
            raw = raw.lstrip(b" ")
        elif self.spec.add_dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def coder(path: str, threads: int = 1) -> PieceCoder:
    """One coder for each Python worker."""
    return held((PieceCoder, path, threads), lambda: PieceCoder(Path(path).read_bytes(), threads))


CODED = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean, parity boolean"


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                     threads: int = 1) -> DataFrame:
    """Ids of every row's text, the hash of the text decoded from them, and two checks.

    ``round_trip``: the decoded text is the text. ``parity``: the ids are those of SentencePiece.
    ``model`` is a path on every machine. Null text counts as empty (no ids). Rows keep their
    multiplicity and null ids; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        work = coder(model, threads)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, same = work.encode(texts)
                decoded = [work.decode(x.tolist()) for x in ids]
                sizes = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(sizes).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32())),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                    pa.array([a == b for a, b in zip(texts, decoded)]), pa.array(same),
                ], names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip", "parity"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, CODED)


def decode_ids(coded: DataFrame, model: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """(all columns, ``into``): the texts of arrays of ids; null ids give null."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        work = coder(model)
        for batch in batches:
            texts = [None if x is None else work.decode(x) for x in batch[ids_col].to_pylist()]
            yield batch.append_column(into, pa.array(texts, pa.string()))

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField(into, StringType())]))
