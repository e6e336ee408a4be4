"""Forecast scores as aggregate columns.

Each function returns ``{name: Column}`` for one ``agg`` call, so every score of a group is
computed in one pass with partial aggregation before the shuffle. The state is a few numbers
per group, hence a group of any size is safe.

Class of a row = class of its *true* value. A score of an empty class is NULL in the core
suite and -1 in the regression suite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threshcast.functions.columns import at_least, col, positive_or
from threshcast.functions.fixed_values import EXCEEDANCE, PRECAUTION


def _count(mask: Column) -> Column:
    return F.count(F.when(mask, F.lit(1)))


def _ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if otherwise is None else F.coalesce(r, F.lit(float(otherwise)))


def _r2(y: Column, p: Column, rows: Column) -> Column:
    """1 - SSE/SST; constant truth gives 1 for a perfect forecast, else 0; NULL below 2 rows."""
    both = rows & y.isNotNull() & p.isNotNull()
    n = _count(both)
    sse = F.sum(F.when(both, (y - p) * (y - p)))
    sst = F.var_pop(F.when(both, y)) * n
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(n >= 2, F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(flat))


def confusion(y: str, p: str, threshold: float = EXCEEDANCE) -> dict[str, Column]:
    t, f = at_least(y, threshold), at_least(p, threshold)
    return {
        "TP": _count(t & f),
        "FP": _count(~t & f),
        "TN": _count(~t & ~f),
        "FN": _count(t & ~f),
    }


def core_suite(
    y: str, p: str, threshold: float = EXCEEDANCE, precaution: float = PRECAUTION
) -> dict[str, Column]:
    """Counts, root mean squared errors, R2, weighted percentage errors, detection rates."""
    yc, pc = col(y), col(p)
    t, f = at_least(y, threshold), at_least(p, threshold)
    square = (yc - pc) * (yc - pc)
    out = confusion(y, p, threshold)
    out["rmse"] = F.sqrt(F.avg(square))
    out["rmse_safe"] = F.sqrt(F.avg(F.when(~t, square)))
    out["rmse_exceedance"] = F.sqrt(F.avg(F.when(t, square)))
    out["r2"] = _r2(yc, pc, F.lit(True))
    for name, rows in (("wmape_safe", ~t), ("wmape_exceedance", t)):
        out[name] = 100.0 * _ratio(
            F.sum(F.when(rows, F.abs(yc - pc))), F.sum(F.when(rows, F.abs(yc)))
        )
    out["sensitivity"] = _ratio(_count(t & f), _count(t), 1.0)
    out["specificity"] = _ratio(_count(~t & ~f), _count(~t), 1.0)
    out["precautionary_sensitivity"] = _ratio(
        _count(t & at_least(p, precaution)), _count(t), 1.0
    )
    return out


def weighted_error(y: Column, p: Column, rows: Column, empty: float) -> Column:
    """Sum of |y-p| over the sum of y on rows with y other than 0 (weights follow the truth)."""
    used = rows & (y != 0)
    top = F.sum(F.when(used, F.signum(y) * F.abs(y - p)))
    return F.when(_count(used) == 0, F.lit(float(empty))).otherwise(
        _ratio(top, F.sum(F.when(used, y)))
    )


def regression_suite(
    y: str, p: str, threshold: float = EXCEEDANCE, no_weight: float = 0.0
) -> dict[str, Column]:
    """Errors after forecasts of 0 or less became 5.

    Root mean squared error, R2 and range-normalised error are on ``log1p``; per class the
    normalised error is on raw values. ``no_weight`` is the weighted error of a class whose
    true values are all 0. No rows at all score like one perfect forecast of 5.
    """
    yc, pc = col(y), positive_or(p)
    ly, lp = F.log1p(yc), F.log1p(pc)
    t = at_least(y, threshold)
    every, safe = F.lit(True), yc < threshold

    def normalised(square: Column, value: Column, rows: Column) -> Column:
        spread = F.max(F.when(rows, value)) - F.min(F.when(rows, value))
        error = F.sqrt(F.avg(F.when(rows, square)))
        return F.when(spread == 0, F.lit(-1.0)).otherwise(100.0 * F.try_divide(error, spread))

    log_square, square = (ly - lp) * (ly - lp), (yc - pc) * (yc - pc)
    nothing = F.count(F.lit(1)) == 0
    out = {
        "log_rmse": F.when(nothing, 0.0).otherwise(F.sqrt(F.avg(log_square))),
        "mae": F.when(nothing, 0.0).otherwise(F.avg(F.abs(yc - pc))),
        "log_nrmse": F.when(nothing, -1.0).otherwise(normalised(log_square, ly, every)),
        "weighted_mape": weighted_error(yc, pc, every, no_weight),
        "log_weighted_mape": weighted_error(ly, lp, every, no_weight),
        "log_r2": _r2(ly, lp, every),
    }
    for name, rows in (("safe", safe), ("exceedance", t)):
        n = _count(rows)
        empty = 0.0 if name == "safe" else -1.0

        def known(value: Column, rows_n: Column = n, if_nothing: float = empty) -> Column:
            missing = F.when(nothing, F.lit(if_nothing)).otherwise(F.lit(-1.0))
            return F.when(rows_n == 0, missing).otherwise(value)

        out[f"mae_{name}"] = known(F.avg(F.when(rows, F.abs(yc - pc))))
        out[f"weighted_mape_{name}"] = known(weighted_error(yc, pc, rows, no_weight))
        out[f"log_weighted_mape_{name}"] = known(weighted_error(ly, lp, rows, no_weight))
        out[f"nrmse_{name}"] = known(normalised(square, yc, rows), if_nothing=-1.0)
        out[f"log_r2_{name}"] = F.when(n == 0, F.when(~nothing, F.lit(-1.0))).otherwise(
            _r2(ly, lp, rows)
        )
    return out


def classification_rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates from the four counts; 0 where a denominator is 0."""

    def fbeta(beta: float, hit: Column, false_alarm: Column, miss: Column) -> Column:
        b = beta * beta
        return _ratio((1 + b) * hit, (1 + b) * hit + b * miss + false_alarm, 0.0)

    recall_safe, recall_exceedance = _ratio(tn, tn + fp, 0.0), _ratio(tp, tp + fn, 0.0)
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn, 0.0),
        "recall_safe": recall_safe,
        "recall_exceedance": recall_exceedance,
        "precision_safe": _ratio(tn, tn + fn, 0.0),
        "precision_exceedance": _ratio(tp, tp + fp, 0.0),
        "balanced_accuracy": (recall_exceedance + recall_safe) / 2,
        "specificity": _ratio(tn, tn + fp, 0.0),
        "fbeta_safe_1_5": fbeta(1.5, tn, fn, fp),
        "fbeta_exceedance_1_5": fbeta(1.5, tp, fp, fn),
        "fbeta_safe_2": fbeta(2.0, tn, fn, fp),
        "fbeta_exceedance_2": fbeta(2.0, tp, fp, fn),
    }


def classification_suite(
    y: str, p: str, threshold: float = EXCEEDANCE, precaution: float = PRECAUTION
) -> dict[str, Column]:
    """Rates of both labels, the four counts, and hits at the precautionary threshold."""
    counts = confusion(y, p, threshold)
    tp, fp, tn, fn = (counts[k] for k in ("TP", "FP", "TN", "FN"))
    t = at_least(y, threshold)
    warned = _count(t & at_least(p, precaution) & ~at_least(p, threshold))
    out = classification_rates(tp, fp, tn, fn)
    out.update(
        {
            "tn": tn,
            "fp": fp,
            "fn": fn,
            "tp": tp,
            "precautionary": warned + tp,
            "recall_precautionary": _ratio(warned + tp, tp + fn, 0.0),
        }
    )
    return out


def log_percentage_error(y: str, p: str) -> Column:
    """Mean of |log1p y - log1p p| / log1p y over rows where log1p y is not 0."""
    ly, lp = F.log1p(col(y)), F.log1p(col(p))
    return F.avg(F.abs(F.try_divide(ly - lp, ly)))


def aliased(scores: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in scores.items()]
