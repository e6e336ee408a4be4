"""Language identification that weighs text, declared language, address suffix and host."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshcast.llm.base import small_batches, stored
from threshcast.llm.remember import release
from threshcast.session import broadcast_if_small

#: Labelled rows (as expected by a hash of their text) the text model is fitted on at most.
TRAIN_ROWS = 4000
#: Bins of hashed byte trigrams.
BINS = 1 << 15
#: Neighbouring trigrams say much the same, so this many count as one; the text as a whole
#: counts as at most ``_WHOLE`` of them.
_DEPENDENT, _WHOLE = 4.0, 400.0
#: Strength of the parent in the priors: rows that a domain's or the whole corpus's shares are worth.
STRENGTH = 8.0
#: A document is rejected under this posterior, or when fewer letters than ``LEAST_LETTERS`` are read.
LEAST_POSTERIOR, LEAST_LETTERS = 0.5, 3
#: A text is of no known language when its trigrams are, on the mean, by ``FAR`` nats less likely in
#: each than if all bins were as likely, and the text is long enough to tell.
FAR, FAR_LETTERS = 1.0, 40
_ABOUT = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class TextModel:
    """Log-probabilities of trigram bins for each language; a tenth of each is spread evenly."""

    languages: list[str]
    table: np.ndarray


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bins, index of the text) of all trigrams of letters and single blanks between them.

    A-Z are lowered; what is not a letter (bytes over 127 count as letters) reads as a blank.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = _LOWER[np.frombuffer(b"".join([b" " + p + b" " for p in parts]), np.uint8)]
    ends = np.cumsum([len(p) + 2 for p in parts])
    letter = _LETTER[b]
    keep = letter | np.r_[False, letter[:-1]]
    keep[np.r_[0, ends[:-1]]] = True
    where = np.flatnonzero(keep)
    c = np.where(letter[where], b[where], 32).astype(np.uint32)
    owner = np.searchsorted(ends, where, "right")
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    bins = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(17)
    inside = (owner[:-2] == owner[2:]) & (owner[2:] < len(texts)) & letter[where][1:-1]
    return bins[inside].astype(np.int64), owner[2:][inside]


def _slabs(texts: list[str]):
    """Lists of texts of about 256 KB; a longer text is read in parts with an overlap of two."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for low in range(0, max(1, len(text)), _ABOUT):
            part = text[max(0, low - 2) : low + _ABOUT]
            held.append((i, part))
            size += len(part)
            if size >= _ABOUT:
                yield held
                held, size = [], 0
    if held:
        yield held


def text_scores(texts: list[str], model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log-probabilities by language, number of trigrams) of each text, whole."""
    sums, count = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for slab in _slabs(texts):
        bins, owner = trigrams([t for _, t in slab])
        if not len(bins):
            continue
        which = np.array([i for i, _ in slab])[owner]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        np.add.at(sums, which[first], np.add.reduceat(model.table[bins], first, axis=0))
        np.add.at(count, which[first], np.diff(np.r_[first, len(which)]))
    return sums, count


def code(label: Column) -> Column:
    """A label's primary part: 'EN-us' and 'en_US' are 'en'; blank is null."""
    x = F.lower(F.regexp_extract(label.cast("string"), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(x != "", x)


def fit_text(rows: DataFrame, text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS) -> TextModel:
    """Trigram model from labelled rows, about ``train_rows`` of them drawn by a hash of the text.

    Counts are summed by Spark; the driver gets languages x ``BINS`` numbers at most.
    """
    held = rows.select(F.col(f"`{text_col}`").alias("text"), code(F.col(f"`{label_col}`")).alias("label")).where(
        "text is not null and label is not null"
    )
    small_batches(rows)
    total = held.count()
    if total > train_rows:
        share = int(train_rows / total * (1 << 30))
        held = held.where(F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 30)) < share)

    def count(batches):
        release()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            labels = np.array(batch.column(1).to_pylist(), object)
            for label in sorted(set(labels)):
                total = np.zeros(BINS, np.int64)
                for slab in _slabs([t for t, x in zip(texts, labels) if x == label]):
                    total += np.bincount(trigrams([t for _, t in slab])[0], minlength=BINS)
                full = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(full), pa.string()), pa.array(full), pa.array(total[full])], names=["label", "bin", "n"]
                )

    counts = held.mapInArrow(count, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.label for r in counts})
    n = np.zeros((BINS, max(1, len(languages))))
    for r in counts:
        n[r.bin, languages.index(r.label)] = r.n
    table = np.log(0.9 * (n + 0.01) / (n.sum(axis=0) + 0.01 * BINS) + 0.1 / BINS)
    return TextModel(languages or ["und"], table)


def place_of(address: Column) -> Column:
    """struct(host, domain, suffix) of an address; what is no address is a host as it stands."""
    plain = F.coalesce(address.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    host = F.when(host != "", host).otherwise(F.lower(plain))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return F.struct(host.alias("host"), F.when(domain != "", domain).otherwise(host).alias("domain"), suffix.alias("suffix"))


@dataclass
class Evidence:
    """Everything fitted: the text model, log P(declared | language), and log weights by host."""

    text: TextModel
    declared: dict[str, list[float]]
    hosts: DataFrame
    elsewhere: list[float]


def _shared(sums: np.ndarray, count: np.ndarray, model: TextModel) -> np.ndarray:
    worth = np.minimum(count / _DEPENDENT, _WHOLE) / np.maximum(count, 1)
    return sums * worth[:, None]


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, text: TextModel, text_col: str = "text", declared: Column | None = None, address: Column | None = None) -> Evidence:
    """Weights from grouped sums of the text posteriors of all rows.

    A host's shares are drawn to its domain's, these to the whole corpus's, by ``STRENGTH`` rows
    each. Suffixes and declared languages weigh by how often they stand with each language.
    Only whole-corpus sums and declared languages (the known ones, others, none) reach the
    driver; hosts stay a table.
    """
    k = len(text.languages)
    names = [f"p{i}" for i in range(k)]
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), _declared(declared, text).alias("declared"),
                       place_of(F.lit(None) if address is None else address).alias("place"))

    def score(batches):
        release()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            p = _posterior(_shared(*text_scores(texts, text), text))
            arrays = [batch.column(1), batch.column(2), *[pa.array(p[:, i]) for i in range(k)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["declared", "place", *names])

    schema = T.StructType([rows.schema["declared"], rows.schema["place"], *[T.StructField(n, T.DoubleType()) for n in names]])
    sums = [F.sum(n).alias(n) for n in names]
    cells = rows.mapInArrow(score, schema).groupBy("declared", "place").agg(*sums)
    cells = stored(cells, "language").select("declared", "place.*", *names)
    total = np.array(cells.agg(*sums).first() or [0.0] * k, float)
    total = np.nan_to_num(total) + 1.0
    said = {r[0]: np.array(r[1:], float) for r in cells.groupBy("declared").agg(*sums).collect()}
    values = [*text.languages, "other"]
    logs = {v: np.log((said.get(v, 0.0) + 0.5) / (total + 0.5 * len(values))).tolist() for v in values}
    share = total / total.sum()
    hosts = cells.groupBy("host", "domain", "suffix").agg(*sums)
    domains = cells.groupBy("domain").agg(*[F.sum(n).alias(f"d{n}") for n in names])
    suffixes = cells.where("suffix <> ''").groupBy("suffix").agg(*[F.sum(n).alias(f"s{n}") for n in names])
    joined = hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left")
    row = lambda prefix: sum((F.col(f"{prefix}{n}") for n in names[1:]), F.col(f"{prefix}{names[0]}"))
    weights = []
    for i, n in enumerate(names):
        parent = (F.col(f"d{n}") + STRENGTH * float(share[i])) / (row("d") + STRENGTH)
        prior = (F.col(n) + STRENGTH * parent) / (row("") + STRENGTH)
        suffix = (F.col(f"s{n}") + STRENGTH * float(share[i])) / (row("s") + STRENGTH) / float(share[i])
        weights.append(F.log(prior) + F.coalesce(F.log(suffix), F.lit(0.0)))
    table = joined.select(F.col("host").alias("_host"), F.array(*weights).alias("_weights"))
    return Evidence(text, logs, table, np.log(share).tolist())


def _declared(declared: Column | None, text: TextModel) -> Column:
    if declared is None:
        return F.lit(None).cast("string")
    said = code(declared)
    return F.when(said.isin(text.languages), said).when(said.isNotNull(), "other")


def identify(docs: DataFrame, evidence: Evidence, text_col: str = "text", declared: Column | None = None, address: Column | None = None) -> DataFrame:
    """``docs`` with a struct ``_language``: language, posterior, text_language, letters, kept.

    The posterior is the product of the text's likelihood, the declared language's, the suffix's
    and the host's prior. Hosts join by broadcast while their counted rows are few, else by a
    shuffled join that Spark may split. ``kept`` is false for rows with hardly a letter, for
    texts unlike every known language, and where no language reaches ``LEAST_POSTERIOR``; the
    language of the first two is 'und'. Null text counts as empty. Every row comes back once;
    ``_language`` and names starting with ``_lid`` are the only names taken.
    """
    text = evidence.text
    columns = list(docs.columns)
    held = docs.withColumns({"_lid_declared": _declared(declared, text), "_lid_host": place_of(F.lit(None) if address is None else address)["host"]})
    hosts = broadcast_if_small(evidence.hosts, derived=True)
    held = held.join(hosts, F.col("_lid_host") == F.col("_host"), "left")
    held = held.select(*[F.col(f"`{c}`") for c in columns], F.col("_lid_declared"), F.col("_weights").alias("_lid_weights"))
    at, said, elsewhere = columns.index(text_col), evidence.declared, evidence.elsewhere

    def fuse(batches):
        release()
        none = np.zeros(len(text.languages))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            sums, count = text_scores(texts, text)
            logs = _shared(sums, count, text)
            by_text = logs.argmax(axis=1)
            far = (sums / np.maximum(count, 1)[:, None]).max(axis=1) < -np.log(BINS) - FAR
            logs = logs + np.array([said.get(d, none) for d in batch.column(len(columns)).to_pylist()]).reshape(logs.shape)
            logs += np.array([w or elsewhere for w in batch.column(len(columns) + 1).to_pylist()], float).reshape(logs.shape)
            p = _posterior(logs)
            best = p.argmax(axis=1)
            known = (count >= LEAST_LETTERS) & ~(far & (count >= FAR_LETTERS))
            top = p[np.arange(len(best)), best]
            value = pa.StructArray.from_arrays([
                pa.array([text.languages[b] if x else "und" for b, x in zip(best, known)]), pa.array(top),
                pa.array([text.languages[b] if n else "und" for b, n in zip(by_text, count)]), pa.array(count.astype(np.int64)),
                pa.array(known & (top >= LEAST_POSTERIOR)),
            ], names=["language", "posterior", "text_language", "letters", "kept"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], value], names=[*columns, "_language"])

    kind = T.StructType([T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()),
                         T.StructField("text_language", T.StringType()), T.StructField("letters", T.LongType()), T.StructField("kept", T.BooleanType())])
    return held.mapInArrow(fuse, T.StructType([*docs.schema.fields, T.StructField("_language", kind)]))


def of_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_language``: the text model from its own labels, source as the host."""
    text = fit_text(docs)
    hints = {"declared": F.col("lang"), "address": F.col("source")}
    return identify(docs, fit(docs, text, **hints), **hints)


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is told, columns as they were."""
    return of_documents(docs).where("_language.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
