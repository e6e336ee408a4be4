"""Non-negative matrix factorisation X ~ W H on long tables.

Multiplicative updates for the squared error (Lee and Seung, 2001), started from NNDSVD
(Boutsidis and Gallopoulos, 2008) or from a seeded table. A completed matrix is never built:
a cell without entry equals its row's fill value, so with delta = value - fill

    X h  =  fill * sum(h) + sum over entries of delta * h

and the same for the transpose. Rows may stand for several equal rows through a weight (the
times of one day). Only k-by-k sums reach the driver; W and H stay tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshcast.functions.columns import cols as named, key_fraction
from threshcast.operators.joins import equi_join
from threshcast.operators.matrix import day_weights, row_means, target_days
from threshcast.operators.series import SERIES_ROWS, largest_group
from threshcast.session import BROADCAST_ROWS, broadcast_if_small, cut, discard, observed

_TINY = float(np.finfo(np.float32).eps)


@dataclass
class ImplicitMatrix:
    """``entries`` (row, col, x) and ``rows`` (row, fill, weight), one line per matrix row."""

    entries: DataFrame
    rows: DataFrame


@dataclass
class Factors:
    """``W`` (row, w array) and ``H`` (col, h array); objective after each sweep."""

    W: DataFrame
    H: DataFrame
    rank: int
    objective: list[float] = field(default_factory=list)

    def write(self, path: str) -> None:
        self.W.write.mode("overwrite").parquet(f"{path}/W")
        self.H.write.mode("overwrite").parquet(f"{path}/H")

    @classmethod
    def read(cls, spark, path: str) -> Factors:
        W, H = spark.read.parquet(f"{path}/W"), spark.read.parquet(f"{path}/H")
        return cls(W, H, W.select(F.max(F.size("w"))).first()[0])


def implicit_target_matrix(
    obs: DataFrame, time: str, site: str, value: str, order=(), fill_target: bool = True
) -> ImplicitMatrix:
    """The completed target matrix as day rows, each weighted by its number of times."""
    days = target_days(obs, time, site, value, order, fill_target)
    entries = cut(
        days.select(F.col("day").alias("row"), F.col(site).alias("col"), F.col(value).alias("x"))
    )
    weights = day_weights(obs, time).withColumnRenamed("day", "row")
    means = row_means(entries, "row", "x").withColumnRenamed("row_mean", "fill")
    return ImplicitMatrix(entries, equi_join(means, weights, ["row"]))


def dense_matrix(entries: DataFrame) -> ImplicitMatrix:
    """Wrap a table (row, col, x) in which absent cells are 0."""
    rows = entries.select("row").distinct()
    return ImplicitMatrix(
        entries, rows.select("row", F.lit(0.0).alias("fill"), F.lit(1).alias("weight"))
    )


class _Work:
    """The matrix laid out for repeated products with thin factor tables."""

    def __init__(self, x: ImplicitMatrix, broadcast_rows: int = BROADCAST_ROWS) -> None:
        self.rows = cut(x.rows)
        n_rows, n_cols = self.rows.count(), x.entries.select("col").distinct().count()
        self.n_cols = n_cols
        self.small_rows, self.small_cols = n_rows <= broadcast_rows, n_cols <= broadcast_rows
        entries = x.entries.join(self._row_side(self.rows), "row")
        entries = entries.select("row", "col", (F.col("x") - F.col("fill")).alias("delta"))
        if not self.small_rows and largest_group(entries, ["row"]) <= SERIES_ROWS:
            # too many rows to broadcast W: lay entries out by row once, W follows that layout
            entries = entries.repartition("row")
        self.entries = cut(entries)

    def _row_side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small_rows else df

    def _col_side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small_cols else df

    def times_cols(
        self, cols: DataFrame, names: list[str], sums: list[float], rows: DataFrame | None = None
    ) -> DataFrame:
        """``rows`` (row, fill, weight, ...) with y_j, where y = X V for a column table V."""
        rows = self.rows if rows is None else rows
        part = (
            self.entries.join(self._col_side(cols.select("col", *names)), "col")
            .groupBy("row")
            .agg(*[F.expr(f"sum(delta * {c}) AS __{c}") for c in names])
        )
        y = [
            f"fill * {_number(s)} + coalesce(__{c}, 0D) AS y{j}"
            for j, (c, s) in enumerate(zip(names, sums, strict=True))
        ]
        joined = rows.join(self._row_side(part), "row", "left")
        return joined.selectExpr(*rows.columns, *y)

    def times_rows(
        self, rows: DataFrame, names: list[str], fills: list[float], cols: DataFrame | None = None
    ) -> DataFrame:
        """(col, z_j) or ``cols`` with z_j, where z = X' U for a row table U; ``fills`` are its
        sums of weight * fill * u_j."""
        thin = rows.selectExpr("row", *[f"weight * {c} AS {c}" for c in names])
        part = (
            self.entries.join(self._row_side(thin), "row")
            .groupBy("col")
            .agg(*[F.expr(f"sum(delta * {c}) AS __{c}") for c in names])
        )
        z = [
            f"__{c} + {_number(f)} AS z{j}"
            for j, (c, f) in enumerate(zip(names, fills, strict=True))
        ]
        if cols is None:
            return part.selectExpr("col", *z)
        return cols.join(self._col_side(part), "col").selectExpr(*cols.columns, *z)

    def squared_norm(self) -> float:
        """Sum of squares over all cells of the completed matrix."""
        joined = self.entries.join(self._row_side(self.rows), "row")
        fill, delta, w = F.col("fill"), F.col("delta"), F.col("weight")
        inner = joined.agg(F.sum(w * delta * (delta + 2 * fill))).first()[0] or 0.0
        base = self.rows.agg(F.sum(w * fill * fill)).first()[0] or 0.0
        return inner + base * self.n_cols


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _products(names: list[str], weight: str = "1D") -> list[str]:
    k = len(names)
    return [f"sum({weight} * {names[i]} * {names[j]})" for i in range(k) for j in range(i, k)]


def _square(row: tuple, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for (i, j), v in zip(pairs, row, strict=False):
        out[i, j] = out[j, i] = v or 0.0
    return out


def _gram(df: DataFrame, names: list[str], weight: str = "1D", more=()) -> tuple:
    """k-by-k sums of products of columns, with further sums, in one aggregate row."""
    products = _products(names, weight)
    row = [v or 0.0 for v in df.selectExpr(*products, *more).first()]
    return _square(row, len(names)), row[len(products) :]


def _written(df: DataFrame, names: list[str], weight: str = "1D", more=(), before=None) -> tuple:
    """``df`` written to the shared folder, and what ``_gram`` gives, seen while writing: one job.

    ``before`` is the table it replaces; its files go once the new ones exist.
    """
    products = _products(names, weight)
    out, row = observed(df, "factors", *[F.expr(e) for e in [*products, *more]])
    if before is not None:
        discard(before)
    row = [v or 0.0 for v in row]
    return out, _square(row, len(names)), row[len(products) :]


def _sums(names: list[str], weight: str = "1D") -> list[str]:
    return [f"sum({weight} * {c})" for c in names]


def _mix(names: list[str], matrix: np.ndarray) -> list[str]:
    """Row vector of columns times a small constant matrix, as SQL text."""
    return [
        " + ".join(f"{c} * {_number(matrix[i, j])}" for i, c in enumerate(names))
        for j in range(matrix.shape[1])
    ]


def _nndsvd(work: _Work, k: int, passes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Leading singular pairs by orthogonal iteration, then their non-negative parts."""
    m = min(k + 2, work.n_cols)
    if k > m:
        raise ValueError(f"rank {k} exceeds the {work.n_cols} columns of the matrix")
    v = [f"v{j}" for j in range(m)]
    cols = work.entries.select("col").distinct()
    draws = [key_fraction(["col"], seed + j).alias(c) for j, c in enumerate(v)]
    V = cols.select("col", *draws)
    sums = np.array(V.selectExpr(*_sums(v)).first(), dtype=float)
    for _ in range(passes):
        y, z = [f"y{j}" for j in range(m)], [f"z{j}" for j in range(m)]
        Y = cut(work.times_cols(V, v, list(sums)))
        fills = list(Y.selectExpr(*_sums(y, "weight * fill")).first())
        Z = cut(work.times_rows(Y, y, fills))
        G, sums = _gram(Z, z, more=_sums(z))
        values, vectors = np.linalg.eigh(G)
        good = values > values.max() * 1e-14
        whiten = vectors[:, good] / np.sqrt(values[good])
        m = int(good.sum())
        v, sums = [f"v{j}" for j in range(m)], np.array(sums) @ whiten
        V = Z.selectExpr("col", *[f"{c} AS v{j}" for j, c in enumerate(_mix(z, whiten))])
    y = [f"y{j}" for j in range(m)]
    Y = cut(work.times_cols(V, v, list(sums)))
    B, _ = _gram(Y, y, "weight")
    values, vectors = np.linalg.eigh(B)
    order = np.argsort(values)[::-1][:k]
    sigma, rotate = np.sqrt(np.maximum(values[order], 0.0)), vectors[:, order]
    r = len(order)
    scale = rotate / np.where(sigma > 0, sigma, 1.0)
    mixed = [f"{c} AS u{j}" for j, c in enumerate(_mix(y, scale))]
    U = Y.selectExpr("row", "fill", "weight", *mixed)
    V = V.selectExpr("col", *[f"{c} AS v{j}" for j, c in enumerate(_mix(v, rotate))])

    def part_norms(df: DataFrame, prefix: str, weight: str) -> np.ndarray:
        """Norms of the positive and of the negative part of each vector."""
        squares = [
            f"sum({weight} * pow(greatest({sign}{prefix}{j}, 0D), 2))"
            for sign in ("", "-")
            for j in range(r)
        ]
        return np.sqrt(np.array([x or 0.0 for x in df.selectExpr(*squares).first()])).reshape(2, r)

    nu, nv = part_norms(U, "u", "weight"), part_norms(V, "v", "1D")
    w_cols, h_cols = [], []
    for j in range(k):
        if j >= r:
            w_cols.append(f"0D AS w{j}")
            h_cols.append(f"0D AS h{j}")
        elif j == 0:
            factor = _number(np.sqrt(sigma[0]))
            w_cols.append(f"abs(u0) * {factor} AS w0")
            h_cols.append(f"abs(v0) * {factor} AS h0")
        else:
            side = int(np.argmax(nu[:, j] * nv[:, j]))
            sign = "" if side == 0 else "-"
            strength = np.sqrt(sigma[j] * nu[side, j] * nv[side, j])
            for prefix, norm, out, name in (("u", nu, w_cols, "w"), ("v", nv, h_cols, "h")):
                factor = strength / norm[side, j] if norm[side, j] > 0 else 0.0
                value = f"greatest({sign}{prefix}{j}, 0D) * {_number(factor)}"
                out.append(f"if({value} < 1e-6D, 0D, {value}) AS {name}{j}")
    return U.selectExpr("row", "fill", "weight", *w_cols), V.selectExpr("col", *h_cols)


def _seeded(work: _Work, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Positive numbers that depend on the key and the seed alone."""
    W = work.rows.select(
        "*", *[(key_fraction(["row"], seed + j) + 0.1).alias(f"w{j}") for j in range(k)]
    )
    H = work.entries.select("col").distinct()
    H = H.select(
        "col", *[(key_fraction(["col"], seed + k + j) + 0.1).alias(f"h{j}") for j in range(k)]
    )
    return W, H


def _given(work: _Work, k: int, start: Factors) -> tuple[DataFrame, DataFrame]:
    W = equi_join(work.rows, start.W, ["row"])
    return (
        W.select("row", "fill", "weight", *[F.col("w")[j].alias(f"w{j}") for j in range(k)]),
        start.H.select("col", *[F.col("h")[j].alias(f"h{j}") for j in range(k)]),
    )


def factorise(
    x: ImplicitMatrix,
    rank: int = 4,
    init: str = "nndsvd",
    sweeps: int = 1000,
    tol: float = 1e-4,
    seed: int = 42,
    start: Factors | None = None,
    svd_passes: int = 6,
    broadcast_rows: int = BROADCAST_ROWS,
) -> Factors:
    """W and H of ``rank`` parts; stops when 10 sweeps gain less than ``tol`` of the start.

    One sweep reads the entries twice and shuffles only partial sums per row and per column.
    The objective comes from sums the update needs anyway. Zeros stay zero under the updates.
    """
    k, work = rank, _Work(x, broadcast_rows)
    if start is not None:
        W, H = _given(work, k, start)
    elif init == "nndsvd":
        W, H = _nndsvd(work, k, svd_passes, seed)
    elif init == "seeded":
        W, H = _seeded(work, k, seed)
    else:
        raise ValueError("init must be 'nndsvd' or 'seeded'")
    w, h = [f"w{j}" for j in range(k)], [f"h{j}" for j in range(k)]
    W, _, _ = _written(W, w)
    H, HH, h_sums = _written(H, h, more=_sums(h))
    norm = work.squared_norm()
    history: list[float] = []
    first = _start_error(work, W, H, w, h, HH, h_sums, norm) if tol > 0 else 0.0
    for sweep in range(1, sweeps + 1):
        products = work.times_cols(H, h, h_sums, W)
        products = products.selectExpr("row", "fill", "weight", *_steps(w, "y", HH))
        W, WW, fills = _written(products, w, "weight", _sums(w, "weight * fill"), W)
        products = work.times_rows(W, w, fills, H.select("col", *h))
        z = [f"z{j}" for j in range(k)]
        cross = "sum(" + " + ".join(f"{c} * z{j}" for j, c in enumerate(h)) + ")"
        products = products.selectExpr("col", *_steps(h, "z", WW), *z)
        H, HH, sums = _written(products, h, more=[*_sums(h), cross], before=H)
        h_sums, inner = sums[:k], sums[k]
        history.append(0.5 * max(norm - 2 * inner + float((WW * HH).sum()), 0.0))
        if tol > 0 and sweep % 10 == 0:
            before = history[-11] if len(history) > 10 else first
            gain = np.sqrt(2 * before) - np.sqrt(2 * history[-1])
            if first > 0 and gain / np.sqrt(2 * first) < tol:
                break
    W, H = W.select("row", F.array(*w).alias("w")), H.select("col", F.array(*h).alias("h"))
    return Factors(W, H, k, history)


def _start_error(work, W, H, w, h, HH, h_sums, norm) -> float:
    dot = " + ".join(f"{c} * y{j}" for j, c in enumerate(w))
    inner = work.times_cols(H, h, h_sums, W).selectExpr(f"sum(weight * ({dot}))").first()[0] or 0.0
    WW, _ = _gram(W, w, "weight")
    return 0.5 * max(norm - 2 * inner + float((WW * HH).sum()), 0.0)


def _steps(names: list[str], top: str, gram: np.ndarray) -> list[str]:
    """value * top / below for each part; a denominator of 0 becomes a tiny number."""
    return [
        f"{c} * {top}{j} / if(({below}) = 0D, {_number(_TINY)}, {below}) AS {c}"
        for j, (c, below) in enumerate(zip(names, (f"({m})" for m in _mix(names, gram)), strict=True))
    ]


def reconstruct(
    requested: DataFrame,
    W: DataFrame,
    H: DataFrame,
    time: str,
    site: str,
    rank: int,
    name: str = "predictions",
) -> DataFrame:
    """Dot product w(time) . h(site) for the requested rows only; NULL if either is unknown.

    ``W`` has (``time``, w) and ``H`` has (``site``, h). The grid of all pairs is not built;
    factor tables of counted size are broadcast, so the requested rows stay where they are.
    """
    W, H = broadcast_if_small(W, derived=True), broadcast_if_small(H, derived=True)
    out = equi_join(equi_join(requested, W, [time], "left"), H, [site], "left")
    dot = " + ".join(f"get(w, {j}) * get(h, {j})" for j in range(rank))
    return out.select(*named(requested.columns), F.expr(dot).alias(name))
