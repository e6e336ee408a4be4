"""Trees of several members grown side by side from histograms of binned features.

For losses whose rows weigh the same. Features are binned once for a fit; after that a pass over
the table counts the rows of all members' open nodes by bin, and a node's best split is read off its
sums: one job for each level of the trees, however many members there are. The rule is that of
``pyspark.ml``'s decision trees: the same cuts between bins, variance as impurity, and no child
below the least number of rows; a task's rows are added in their order, as there, so that even
gains that are equal but for rounding fall alike on a table of one partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshcast.operators.trees import Tree

#: Different values of a feature up to which its cuts are exact; a task with more keeps SUMMARY
#: of them, spaced evenly by rows, each with the rows up to it.
EXACT, SUMMARY = 10_000, 2_000
#: Rows from which a table is dealt over all cores.
DEALT = 1 << 15
#: Bytes of sums a task holds at once; open nodes beyond wait for the next pass.
SUMS_BYTES = 64 << 20
#: Bytes of all tasks' sums up to which the driver adds them up itself.
COLLECT_BYTES = 64 << 20
_ROWS_AT_ONCE, _HELD_AT_ONCE = 1 << 16, 1 << 19
#: Labels of less variance than that are equal.
_EPSILON = 2.0**-52


@dataclass(frozen=True)
class Cuts:
    """``own[g][f]`` are the cuts of feature f for the rows of condition g, ``all[f]`` those of all conditions."""

    own: list[list[np.ndarray]]
    all: list[np.ndarray]

    def binned(self, x: str) -> Column:
        """The places of a row's features among all cuts, two bytes each."""
        every = self.all

        @F.arrow_udf("binary")
        def places(rows: pa.Array) -> pa.Array:
            values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(every))
            at = np.empty(values.shape, "<u2")
            for f, cuts in enumerate(every):
                at[:, f] = np.searchsorted(cuts, values[:, f])
            ends = np.arange(len(rows) + 1, dtype=np.int32) * (2 * len(every))
            return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(at)])

        return places(x)

    def lookup(self, group: int, feature: int) -> np.ndarray:
        """The bin of a condition's rows by their place among all cuts."""
        own, every = self.own[group][feature], self.all[feature]
        return np.append(np.searchsorted(own, every), len(own)).astype(np.int64)


def thresholds(values: np.ndarray, rows: np.ndarray, max_bins: int) -> np.ndarray:
    """Cuts between sorted different values that stand in so many rows: between all of them if
    they are few, else where the rows passed come closest to even shares."""
    values, rows = values[rows > 0], rows[rows > 0]
    splits = min(max_bins, int(rows.sum())) - 1
    if len(values) < 2:
        return np.zeros(0)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= splits:
        return middle
    stride, kept = rows.sum() / (splits + 1), []
    passed, target = np.cumsum(rows, dtype=np.float64), stride
    for i in range(1, len(values)):
        if abs(passed[i - 1] - target) < abs(passed[i] - target):
            kept.append(middle[i - 1])
            target += stride
    return np.array(kept)


def _merged(values: Sequence[np.ndarray], rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different values, sorted, and their rows by condition; short of SUMMARY if they were over EXACT."""
    value, at = np.unique(np.concatenate(values), return_inverse=True)
    every = np.concatenate(rows)
    total = np.stack([np.bincount(at, every[:, g], len(value)) for g in range(every.shape[1])], axis=1)
    if len(value) <= EXACT:
        return value, total
    passed = np.cumsum(total.sum(axis=1))
    share = np.minimum((passed * SUMMARY / passed[-1]).astype(np.int64), SUMMARY - 1)
    first = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
    return value[np.r_[first[1:], len(value)] - 1], np.add.reduceat(total, first)


def cuts_of(data: DataFrame, x: str, groups: Sequence[Column], n_features: int, max_bins: int) -> Cuts:
    """Cuts of all features for the rows of each condition, from all rows in one pass."""
    n_groups = len(groups)

    def summed(batches):
        held: list = [([], []) for _ in range(n_features)]
        for t in _pieces(batches, _ROWS_AT_ONCE):
            values = _flat(t["x"], np.float64).reshape(t.num_rows, n_features)
            own = _flat(t["own"], np.float64).reshape(t.num_rows, n_groups)
            for f in range(n_features):
                # rows of no condition take no part
                some = own.any(axis=1)
                held[f][0].append(values[some, f])
                held[f][1].append(own[some])
                held[f] = tuple([part] for part in _merged(*held[f]))

        for f, (values, rows) in enumerate(held):
            if values:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], pa.int32()), pa.array([values[0]], pa.list_(pa.float64())),
                     pa.array([rows[0].ravel()], pa.list_(pa.float64()))], names=["f", "value", "rows"],
                )

    def settled(t: pa.Table) -> pa.Table:
        parts = [np.asarray(v.values) for v in t["value"]]
        rows = [np.asarray(r.values).reshape(-1, n_groups) for r in t["rows"]]
        value, total = _merged(parts, rows)
        cuts = [thresholds(value, total[:, g], max_bins) for g in range(n_groups)]
        return pa.table([t["f"].slice(0, 1), pa.array([cuts], pa.list_(pa.list_(pa.float64())))], names=["f", "cuts"])

    own = F.array(*[F.coalesce(g, F.lit(False)).cast("double") for g in groups]).alias("own")
    parts = data.select(F.col(x).alias("x"), own).mapInArrow(summed, "f int, value array<double>, rows array<double>")
    found = parts.groupBy("f").applyInArrow(settled, "f int, cuts array<array<double>>").collect()
    by = {r["f"]: [np.array(c, np.float64) for c in r["cuts"]] for r in found}
    none = [np.zeros(0)] * n_groups
    features = [by.get(f, none) for f in range(n_features)]
    return Cuts([[cuts[g] for cuts in features] for g in range(n_groups)], [np.unique(np.concatenate(c)) for c in features])


def _flat(column: pa.ChunkedArray, kind) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).astype(kind, copy=False)


@dataclass
class Plan:
    """What decides a member's tree: its label (``level`` for the pinball loss's signs, else residuals),
    the condition of its rows, that of its cuts, the features it may use and its limits."""

    place: int
    level: float | None
    rows: int
    cuts: int
    features: list[int]
    max_depth: int
    min_leaf: int


class _Growing:
    """A tree so far: for each node its rows, sum and sum of squares of labels, and the place of its
    split among all cuts."""

    def __init__(self, plan: Plan) -> None:
        self.plan, self.tree = plan, Tree()
        self.tree.add()
        self.split, self.depth, self.stats = [0], [0], [None]

    def child(self, at: int, stats: np.ndarray) -> int:
        self.split.append(0)
        self.depth.append(self.depth[at] + 1)
        self.stats.append(stats)
        return self.tree.add()

    def divide(self, node: int, best: tuple | None, cuts: Cuts) -> list[int]:
        """Split a node that may be, and give those of its children that may be split in turn."""
        if best is None or not self.open(node):
            return []
        f, cut, left, right = best
        self.tree.feature[node], self.tree.threshold[node] = f, cut
        self.split[node] = int(np.searchsorted(cuts.all[f], cut))
        sides = self.tree.left[node], self.tree.right[node] = self.child(node, left), self.child(node, right)
        return [c for c in sides if self.open(c)]

    def open(self, node: int) -> bool:
        if self.depth[node] >= self.plan.max_depth:
            return False
        own = self.stats[node]
        return own is None or (own[0] >= 2 * max(1, self.plan.min_leaf) and abs(_impurity(*own)) >= _EPSILON)

    def finished(self) -> tuple[Tree, dict[int, tuple[float, float]]]:
        """The tree in order of first visit, leaves numbered from the left, with their sums. Two
        leaves of one mean are one."""
        out, sums = Tree(), {}
        tree, mean = self.tree, lambda own: own[1] / own[0] if own[0] else 0.0

        def even(i: int) -> bool:
            """Whether all below a node is one leaf."""
            if tree.feature[i] < 0:
                return True
            a, b = tree.left[i], tree.right[i]
            return even(a) and even(b) and mean(self.stats[a]) == mean(self.stats[b])

        def copy(i: int) -> int:
            if even(i):
                sums[len(sums)] = (float(self.stats[i][1]), float(self.stats[i][0]))
                return out.add(value=len(sums) - 1)
            here = out.add(tree.feature[i], tree.threshold[i])
            out.left[here], out.right[here] = copy(tree.left[i]), copy(tree.right[i])
            return here

        copy(0)
        return out, sums


def _impurity(n, s, q):
    """Variance of labels, from rows, sum and sum of squares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def _best(plan: Plan, cuts: Cuts, sums: list[np.ndarray], own: list[np.ndarray | None]) -> list[tuple]:
    """For each of some nodes its best split (feature, cut, sums left, sums right), or None, and its
    ``own`` sums (rows, sum and sum of squares of labels), from its bins if not known yet."""
    nodes, least = len(own), max(1, plan.min_leaf)
    best, most = [None] * nodes, np.zeros(nodes)
    known = np.array([[np.nan] * 3 if o is None else o for o in own]).T
    for f, bins in zip(plan.features, sums):
        if bins.shape[2] < 2:
            continue
        passed = np.cumsum(bins, axis=2)
        left, right = passed[:, :, :-1], passed[:, :, -1:] - passed[:, :, :-1]
        known = np.where(np.isnan(known), left[:, :, 0] + right[:, :, 0], known)
        whole = known[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = left[0] / whole[0], right[0] / whole[0]
            gain = _impurity(*whole) - share[0] * _impurity(*left) - share[1] * _impurity(*right)
        gain = np.where((left[0] >= least) & (right[0] >= least), gain, -np.inf)
        at = np.argmax(gain, axis=1)
        top = gain[np.arange(nodes), at]
        for i in np.flatnonzero(top > most):
            cut = float(cuts.own[plan.cuts][f][at[i]])
            best[i], most[i] = (f, cut, left[:, i, at[i]], right[:, i, at[i]]), top[i]
    known = np.where(np.isnan(known), sums[0].sum(axis=2), known)
    return list(zip(best, known.T))


def grow(now: DataFrame, plans: Sequence[Plan], conditions: Sequence[Column], cuts: Cuts, tasks: int, counted: bool = False) -> list[tuple[Tree, dict]]:
    """A tree for each plan, from a table with ``__b`` (binned features), ``y`` and ``F`` (scores). Signs
    may be ``counted`` instead of added, which is quicker and rounds sums otherwise."""
    grown = [_Growing(p) for p in plans]
    waiting = [(k, 0) for k in range(len(grown))]  # a tree of one leaf needs its sums, too
    while waiting:
        taken, size = [], 0
        for k, node in waiting:
            size += 24 * sum(len(cuts.own[plans[k].cuts][f]) + 1 for f in plans[k].features)
            if taken and size > SUMS_BYTES:
                break
            taken.append((k, node))
        waiting = waiting[len(taken) :]
        by: dict[int, list[int]] = {}
        for k, node in taken:
            by.setdefault(k, []).append(node)
        found = _sums(now, [(grown[k], nodes) for k, nodes in by.items()], conditions, cuts, tasks, counted)
        for (k, nodes), sums in zip(by.items(), found):
            g = grown[k]
            for node, (best, own) in zip(nodes, _best(g.plan, cuts, sums, [g.stats[n] for n in nodes])):
                g.stats[node] = own
                waiting += [(k, c) for c in g.divide(node, best, cuts)]
    return [g.finished() for g in grown]


def grow_alone(plan: Plan, cuts: Cuts, columns: np.ndarray, rows: np.ndarray, label: np.ndarray) -> tuple[Tree, dict]:
    """The tree that ``grow`` gives, from ``rows`` of a table held in memory: its binned features, a
    line each, and labels."""
    grown, square = _Growing(plan), label * label
    lookups = [cuts.lookup(plan.cuts, f) for f in plan.features]
    waiting = [(0, rows)]
    while waiting:
        node, rows = waiting.pop()
        here, weights, sums = columns[:, rows], (None, label[rows], square[rows]), []
        for f, look in zip(plan.features, lookups):
            code, width = look[here[f]], len(cuts.own[plan.cuts][f]) + 1
            sums.append(np.stack([np.bincount(code, w, width) for w in weights])[:, None])
        best, grown.stats[node] = _best(plan, cuts, sums, [grown.stats[node]])[0]
        further = grown.divide(node, best, cuts)
        if further:
            low = here[best[0]] <= grown.split[node]
            sides = (rows[low], rows[~low])
            waiting += [(c, sides[c != grown.tree.left[node]]) for c in further]
    return grown.finished()


def values_of(tree: Tree, cuts: Cuts, columns: np.ndarray) -> np.ndarray:
    """The value of a tree for all rows of a table as ``grow_alone`` takes it."""
    split = [int(np.searchsorted(cuts.all[f], t)) if f >= 0 else 0 for f, t in zip(tree.feature, tree.threshold)]
    out, waiting = np.empty(columns.shape[1]), [(0, np.arange(columns.shape[1]))]
    while waiting:
        node, rows = waiting.pop()
        if tree.feature[node] < 0:
            out[rows] = tree.value[node]
            continue
        low = columns[tree.feature[node]][rows] <= split[node]
        waiting += [(tree.left[node], rows[low]), (tree.right[node], rows[~low])]
    return out


def moved(trees: Sequence[Sequence[Tree]], cuts: Cuts) -> Column:
    """The scores of a row after further rounds (lists of trees, one for each score)."""

    @F.arrow_udf("array<double>")
    def scores(binned: pa.Array, before: pa.Array) -> pa.Array:
        columns = columns_of(pa.chunked_array([binned]), len(cuts.all))
        out = _flat(pa.chunked_array([before]), np.float64).reshape(len(binned), -1).copy()
        for side in trees:
            for k, tree in enumerate(side):
                out[:, k] += values_of(tree, cuts, columns)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return scores("__b", "F")


def leaf_quantiles(now: DataFrame, trees: Sequence[Tree], levels: Sequence[float], rows: Sequence[int],
                   conditions: Sequence[Column], cuts: Cuts, accuracy: int) -> list[dict[int, float]]:
    """By tree and leaf the level's quantile of the residuals, at most one in ``accuracy`` of a leaf's
    rows off: of more residuals than that in a batch of rows, so many are kept, spaced evenly by rank."""
    numbered = [replace(t, value=[float(k) for k in range(len(t.feature))]) for t in trees]
    n_features, n_conditions = len(cuts.all), len(conditions)

    def kept(batches):
        for t in _pieces(batches, _HELD_AT_ONCE):
            columns, y = columns_of(t["b"], n_features), t["y"].to_numpy()
            scores = _flat(t["F"], np.float64).reshape(t.num_rows, -1)
            own = _flat(t["own"], bool).reshape(t.num_rows, n_conditions) if n_conditions else None
            for k, tree in enumerate(numbered):
                leaf, rest = values_of(tree, cuts, columns).astype(np.int32), y - scores[:, k]
                if rows[k] >= 0:
                    leaf, rest = leaf[own[:, rows[k]]], rest[own[:, rows[k]]]
                order = np.lexsort((rest, leaf))
                leaf, rest = leaf[order], rest[order]
                starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else np.zeros(0, np.int64)
                last, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for a, b in zip(starts, np.append(starts[1:], len(leaf))):
                    ends = a + np.arange(1, min(b - a, accuracy) + 1) * (b - a) // min(b - a, accuracy)
                    last.append(ends - 1)
                    weight.append(np.diff(ends, prepend=a))
                last, weight = np.concatenate(last), np.concatenate(weight)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), *(pa.array([v], pa.list_(kind)) for v, kind in (
                        (leaf[last], pa.int32()), (rest[last], pa.float64()), (weight, pa.int64())))],
                    names=["m", "leaf", "rest", "weight"],
                )

    def settled(t: pa.Table) -> pa.Table:
        m = t["m"][0].as_py()
        leaf, rest, weight = (_flat(t[c], kind) for c, kind in (("leaf", np.int32), ("rest", np.float64), ("weight", np.int64)))
        order = np.lexsort((rest, leaf))
        leaf, rest, weight = leaf[order], rest[order], weight[order]
        found = []
        for number in np.unique(leaf):
            a, b = np.searchsorted(leaf, [number, number + 1])
            passed = np.cumsum(weight[a:b])
            rank = max(1, math.ceil(levels[m] * int(passed[-1])))
            found.append((int(number), float(rest[a + np.searchsorted(passed, rank)])))
        return pa.table({"m": pa.array([m] * len(found), pa.int32()), "leaf": pa.array([f[0] for f in found], pa.int32()),
                         "q": pa.array([f[1] for f in found], pa.float64())})

    wanted = [F.col("__b").alias("b"), "y", "F"]
    if n_conditions:
        wanted.append(F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]).alias("own"))
    parts = now.select(*wanted).mapInArrow(kept, "m int, leaf array<int>, rest array<double>, weight array<long>")
    out: list[dict[int, float]] = [{} for _ in trees]
    for r in parts.groupBy("m").applyInArrow(settled, "m int, leaf int, q double").collect():
        out[r["m"]][r["leaf"]] = r["q"]
    return out


def _pieces(batches, rows: int):
    """Tables of at least so many rows, the last of what is left."""
    waiting, count = [], 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, count = [], 0
    if count:
        yield pa.Table.from_batches(waiting).combine_chunks()


def columns_of(binned: pa.ChunkedArray, n_features: int) -> np.ndarray:
    """Binned features, a line each."""
    rows = np.concatenate([_bytes(c, 2 * n_features) for c in binned.chunks]).view("<u2")
    return np.ascontiguousarray(rows.reshape(-1, n_features).T)


def _sums(now: DataFrame, asked: list[tuple[_Growing, list[int]]], conditions: Sequence[Column], cuts: Cuts, tasks: int, counted: bool):
    """For each tree asked and feature the rows, sums and sums of squares of labels of its nodes by bin."""
    n_features, n_conditions = len(cuts.all), len(conditions)
    orders = []
    for g, nodes in asked:
        p = g.plan
        sizes = [len(cuts.own[p.cuts][f]) + 1 for f in p.features]
        lookups = [cuts.lookup(p.cuts, f) for f in p.features]
        # a condition whose cuts are all there are needs no lookup
        lookups = [None if np.array_equal(x, np.arange(len(x))) else x for x in lookups]
        slot = {node: i for i, node in enumerate(nodes)}
        orders.append((p.place, p.level, p.rows, p.features, sizes, lookups, slot, (g.tree.feature, g.split, g.tree.left, g.tree.right)))

    def summed(batches):
        held = [[np.zeros((3, len(slot) * size)) for size in sizes] for _, _, _, _, sizes, _, slot, _ in orders]
        for t in _pieces(batches, _ROWS_AT_ONCE):
            n = t.num_rows
            columns = columns_of(t["b"], n_features)
            y = t["y"].to_numpy()
            scores = _flat(t["F"], np.float64).reshape(n, -1)
            own = _flat(t["own"], bool).reshape(n, n_conditions) if n_conditions else None
            for sums, (place, level, rows, features, sizes, lookups, slot, tree) in zip(held, orders):
                start = None if rows < 0 else np.flatnonzero(own[:, rows])
                index, at = _reached(tree, columns, start, slot, n)
                if not len(at):
                    continue
                take = (lambda c: c) if index is None else (lambda c: c[index])  # noqa: B023
                score, truth = take(scores[:, place]), take(y)
                if level is not None and counted:
                    side = at + len(slot) * ~(truth < score)
                    for s, f, size, look in zip(sums, features, sizes, lookups):
                        code = side * size
                        code += take(columns[f]) if look is None else look[take(columns[f])]
                        low, high = np.bincount(code, minlength=2 * s.shape[1]).reshape(2, -1)
                        s += np.stack([low + high, high * level + low * (level - 1), high * level**2 + low * (level - 1) ** 2])
                    continue
                if level is None:
                    label = truth - score
                else:  # a missing number is above any other, as in Spark
                    label = np.where(truth < score, level - 1, level)
                square = label * label
                for s, f, size, look in zip(sums, features, sizes, lookups):
                    code = take(columns[f]).astype(np.int64) if look is None else look[take(columns[f])]
                    code += at * size
                    s[0] += np.bincount(code, minlength=s.shape[1])
                    s[1] += np.bincount(code, label, s.shape[1])
                    s[2] += np.bincount(code, square, s.shape[1])

        for k, sums in enumerate(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([b"".join(s.tobytes() for s in sums)], pa.binary())], names=["k", "sums"]
            )

    def added(t: pa.Table) -> pa.Table:
        k = t["k"][0].as_py()
        # in an order of their own, so that sums do not depend on when tasks end
        parts = sorted(s.as_py() for s in t["sums"])
        total = sum(np.frombuffer(p) for p in parts)
        return pa.table([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "sums"])

    wanted = [F.col("__b").alias("b"), "y", "F"]
    if n_conditions:
        wanted.append(F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]).alias("own"))
    parts = now.select(*wanted).mapInArrow(summed, "k int, sums binary")
    size = sum(24 * len(o[6]) * sum(o[4]) for o in orders)
    if size * tasks > COLLECT_BYTES:
        parts = parts.groupBy("k").applyInArrow(added, "k int, sums binary")
    of: dict[int, list[bytes]] = {}
    for r in parts.collect():
        of.setdefault(r["k"], []).append(bytes(r["sums"]))
    out = []
    for k, (_, _, _, _, sizes, _, slot, _) in enumerate(orders):
        total = sum((np.frombuffer(p) for p in sorted(of.get(k, []))), np.zeros(3 * len(slot) * sum(sizes)))
        ends = np.cumsum([0, *(3 * len(slot) * width for width in sizes)])
        out.append([total[a:b].reshape(3, len(slot), width) for a, b, width in zip(ends[:-1], ends[1:], sizes)])
    return out


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a column of values of one length."""
    _, ends, data = column.buffers()
    low = int(np.frombuffer(ends, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[low : low + len(column) * width]


def _reached(tree: tuple, columns: np.ndarray, start: np.ndarray | None, slot: dict[int, int], n: int) -> tuple[np.ndarray | None, np.ndarray]:
    """The rows that reach a node with a slot (None for all rows), and their slots."""
    feature, split, left, right = tree
    if feature[0] < 0:
        return start, np.zeros(n if start is None else len(start), np.int64)
    index, at = [], []
    waiting = [(0, np.arange(n) if start is None else start)]
    while waiting:
        node, rows = waiting.pop()
        if feature[node] < 0:
            if node in slot:
                index.append(rows)
                at.append(np.full(len(rows), slot[node], np.int64))
            continue
        low = columns[feature[node]][rows] <= split[node]
        waiting += [(left[node], rows[low]), (right[node], rows[~low])]
    return (np.concatenate(index), np.concatenate(at)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))
