"""Quality rules and robust multivariate outliers per language and source."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshcast.llm.base import forget, stored
from threshcast.session import broadcast_if_small

# The base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

#: Share of a group's rows that the least determinant is sought over.
CORE = 0.75
#: Groups with fewer rows are pooled with others of their language, then with all others.
LEAST_ROWS = 60
#: Concentration steps at most; fewer when no determinant falls by more than ``STILL``.
STEPS, STILL = 12, 1e-3
#: A row is rejected beyond the distance that so small a share of a normal population passes.
TAIL = 1e-6
#: Added to the diagonal of every scatter matrix: spread that is never held against a text.
FLOORS = (0.05, 0.3, 0.3, 0.3)
_SLAB = 1 << 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_X = tuple(f"x{i}" for i in range(len(FLOORS)))


def repeated_words(ids: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether each word stands in a window of ``window`` words found twice or more in its text.

    Windows get exact names by doubling: names of 1, 2, 4 ... words from pairs of names before.
    """
    n = len(ids)
    if n <= window:
        return np.zeros(n, bool)
    names, size = ids.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        pair = names[:-step] * (int(names.max()) + 1) + names[step:]
        names, size = np.unique(pair, return_inverse=True)[1], size + step
    whole = np.flatnonzero(owner[: len(names)] == owner[window - 1 :])
    key = owner[whole].astype(np.int64) * (len(names) + 1) + names[whole]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    marks = np.zeros(n + 1, np.int64)
    starts = whole[count[inverse] > 1]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return np.cumsum(marks[:n]) > 0


def text_counts(texts: list[str]) -> np.ndarray:
    """A row of ``COUNTS`` for each text, whole."""
    out, at = np.zeros((len(texts), len(COUNTS)), np.int64), 0
    while at < len(texts):
        known: dict[bytes, int] = {}
        ids: list[int] = []
        sizes, first = [], at
        while at < len(texts) and (at == first or len(ids) < _SLAB):
            text = texts[at]
            words = text.encode("utf-8", "surrogatepass").split()
            ids.extend([known.setdefault(w, len(known)) for w in words])
            lines = [x for x in text.split("\n") if x.strip(BLANKS)]
            blanks = sum(map(text.count, BLANKS))
            out[at, :4] = (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)))
            sizes.append(len(words))
            at += 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        repeated = repeated_words(np.array(ids, np.int64), owner)
        out[first:at, 4] = np.bincount(owner[repeated], minlength=len(sizes))
    return out


def counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(doc_id, lang, source, COUNTS) of every row; null text has no words."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = text_counts([t or "" for t in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(COUNTS))]],
                    names=["doc_id", "lang", "source", *COUNTS],
                )

    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), named(lang_col).alias("lang"),
                       named(source_col).alias("source"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def transformed() -> list[Column]:
    """Logarithms of the mean word length and of counts of symbols, repeated lines and words,
    each against the root of the text's words, by which such counts spread."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(F.col(c) / F.sqrt(words))
    return [F.log(F.col("word_chars") / words), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``group``: language and source, or what a small group is pooled in.

    Null where even all small groups together are too few to say what is usual.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST_ROWS).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    rest = small.where(F.col("n_lang") < LEAST_ROWS).agg(F.sum("n_lang")).first()[0] or 0
    name = (
        F.when(F.col("n") >= LEAST_ROWS, F.concat_ws("\x01", F.lit("own"), "lang", "source"))
        .when(F.col("n_lang") >= LEAST_ROWS, F.concat_ws("\x01", F.lit("language"), "lang"))
        .when(F.lit(rest >= LEAST_ROWS), F.lit("rest"))
    )
    names = sizes.join(small, "lang", "left").select("lang", "source", name.alias("group"))
    return rows.join(broadcast_if_small(names, derived=True), ["lang", "source"], "left")


def _near(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance from their group's centre."""
    k = len(_X)
    gap = [F.col(x) - F.get("centre", F.lit(i)) for i, x in enumerate(_X)]
    terms = [
        (1 if i == j else 2) * gap[i] * gap[j] * F.get("precision", F.lit(i * k + j)) for i in range(k) for j in range(i, k)
    ]
    d2 = sum(terms[1:], terms[0])
    joined = rows.join(broadcast_if_small(params, derived=False), "group")
    return joined.withColumn("d2", d2).drop("centre", "precision", "log_det")


def _solved(moments: DataFrame) -> DataFrame:
    """(group, centre, precision, log_det) from sums of products; a small matrix per group."""

    def run(batches):
        k = len(_X)
        for batch in batches:
            if not batch.num_rows:
                continue
            centre = np.array(batch["centre"].to_pylist(), float)
            scatter = np.array(batch["scatter"].to_pylist(), float).reshape(-1, k, k) + np.diag(np.square(FLOORS))
            precision = np.linalg.inv(scatter)
            yield pa.RecordBatch.from_arrays([
                batch["group"], pa.array(centre.tolist()), pa.array(precision.reshape(-1, k * k).tolist()),
                pa.array(np.linalg.slogdet(scatter)[1]),
            ], names=["group", "centre", "precision", "log_det"])

    return moments.mapInArrow(run, "group string, centre array<double>, precision array<double>, log_det double")


def _concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Centre and scatter of the ``CORE`` share of each group nearest to the present centre."""
    near = _near(rows, params)
    bound = near.groupBy("group").agg(F.percentile_approx("d2", CORE, 5000).alias("bound"))
    kept = near.join(broadcast_if_small(bound, derived=True), "group").where("d2 <= bound")
    pairs = {(i, j): F.covar_pop(_X[min(i, j)], _X[max(i, j)]) for i in range(len(_X)) for j in range(len(_X))}
    moments = kept.groupBy("group").agg(F.array(*[F.avg(x) for x in _X]).alias("centre"), F.array(*pairs.values()).alias("scatter"))
    return stored(_solved(moments), "mcd")


def fit_groups(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates (group, centre, precision, log_det).

    Starts from medians and median deviations, then takes concentration steps, each a pass of
    grouped aggregation in which the determinant never rises. Quantiles are mergeable sketches
    and sums are combined before shuffles, so no group is gathered. The scatter is scaled so that
    a group's median distance is what normal data would have.
    """
    medians = rows.groupBy("group").agg(*[F.percentile_approx(x, 0.5, 5000).alias(f"m{x}") for x in _X])
    away = rows.join(broadcast_if_small(medians, derived=True), "group")
    spread = away.groupBy("group").agg(
        F.array(*[F.first(f"m{x}") for x in _X]).alias("centre"),
        F.array(*[F.pow(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col(f"m{x}")), 0.5, 5000), 2) for x in _X]).alias("v"),
    )
    k = len(_X)
    diagonal = [F.get("v", F.lit(i)) if i == j else F.lit(0.0) for i in range(k) for j in range(k)]
    params = stored(_solved(spread.select("group", "centre", F.array(*diagonal).alias("scatter"))), "mcd")
    last = None
    for _ in range(STEPS):
        after = _concentrated(rows, params)
        forget(params)
        params = after
        total, groups = params.agg(F.sum("log_det"), F.count("*")).first()
        if last is not None and abs(last - (total or 0.0)) <= STILL * max(1, groups):
            break
        last = total or 0.0
    middle = _near(rows, params).groupBy("group").agg(F.percentile_approx("d2", 0.5, 5000).alias("middle"))
    usual = chi_square_above(0.5, k)
    scale = F.greatest(F.col("middle") / usual, F.lit(1.0))
    return params.join(middle, "group").withColumn(
        "precision", F.transform("precision", lambda p: p / scale)
    ).drop("middle")


def chi_square_above(tail: float, k: int) -> float:
    """The value that a chi-square variable of an even number ``k`` of degrees exceeds with ``tail``."""
    above = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > tail else (low, mid)
    return high


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, COUNTS, base_failed, distance, kept) of every row.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. Of the others
    each language and source has its usual vector of transformed counts and its spread; rows too
    far from it go (``distance`` is squared). Null language or source is a group like any other;
    null text has no words and fails. Small groups are pooled; where all rows are too few
    nothing more is rejected and the distance is null. Repeated rows are judged alike; an empty
    table gives no rows. Only the four columns named are read.
    """
    rows = stored(counted(docs, id_col, text_col, lang_col, source_col), "counts").withColumn("base_failed", base_failed())
    good = rows.where(~F.col("base_failed")).withColumns(dict(zip(_X, transformed())))
    good = stored(grouped(good), "vectors")
    usable = good.where(F.col("group").isNotNull())
    params = stored(fit_groups(usable), "mcd")
    limit = chi_square_above(TAIL, len(_X))
    near = _near(usable, params).select(*rows.columns, F.col("d2").alias("distance"))
    none = F.lit(None).cast("double").alias("distance")
    unknown = good.where(F.col("group").isNull()).select(*rows.columns, none)
    failed = rows.where("base_failed").select(*rows.columns, none)
    out = near.union(unknown).union(failed)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)
    return out.withColumn("kept", kept)
