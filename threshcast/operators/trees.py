"""Regression trees as small node tables: grown by ``pyspark.ml``, cut back and valued here.

``pyspark.ml`` chooses the splits. What its leaves hold is then set anew from sums over the rows
that reach them, so penalties on leaf values, a limit on the number of leaves and values other than
means are possible. Trees are bounded by their depth, so node tables live on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the (rows, trees) table that are looked up at once.
_CELLS = 1 << 21

NODES = (
    "member int, round int, node int, feature int, threshold double, left int, right int, "
    "value double, gain double"
)


@dataclass
class Tree:
    """Nodes in order of first visit, left before right; ``feature`` -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, feature: int = -1, threshold: float = 0.0, value: float = 0.0, gain: float = 0.0) -> int:
        self.feature.append(feature)
        self.threshold.append(threshold)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        self.gain.append(gain)
        return len(self.feature) - 1

    @property
    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    @classmethod
    def grown(cls, root, features: Sequence[int]) -> tuple[Tree, dict[int, tuple[float, float]]]:
        """The tree below a fitted ``pyspark.ml`` root node, on the columns ``features`` of the whole
        vector, and for each leaf (numbered from the left) the sums of its rows' weighted labels
        and of their weights, which the fit has taken already."""
        tree, sums = cls(), {}

        def node(at) -> int:
            if at.subtreeDepth() == 0:
                weight, total, *_ = at.impurityStats().stats()
                sums[len(sums)] = (total, weight)
                return tree.add(value=len(sums) - 1)
            split = at.split()
            here = tree.add(features[split.featureIndex()], split.threshold())
            tree.left[here] = node(at.leftChild())
            tree.right[here] = node(at.rightChild())
            return here

        node(root)
        return tree, sums

    def rows(self, member: int, number: int) -> list[tuple]:
        return [
            (member, number, i, self.feature[i], self.threshold[i], self.left[i], self.right[i], self.value[i], self.gain[i])
            for i in range(len(self.feature))
        ]


def soft(total: float, l1: float) -> float:
    """``total`` moved towards 0 by ``l1``, not past it."""
    return max(0.0, abs(total) - l1) * (1.0 if total > 0 else -1.0)


def leaf_value(g: float, h: float, l1: float, l2: float) -> float:
    return soft(g, l1) / (h + l2) if h + l2 > 0 else 0.0


def fall(g: float, h: float, l1: float, l2: float) -> float:
    """Twice what the best value of a node takes off the penalised loss."""
    return soft(g, l1) ** 2 / (h + l2) if h + l2 > 0 else 0.0


def cut_back(tree: Tree, sums: dict[int, tuple[float, float]], leaves: int, l1: float, l2: float) -> Tree:
    """The best tree of at most ``leaves`` leaves inside a grown one.

    ``sums`` maps the number of a grown leaf to its (gradient, weight). Splits are taken in the
    order of their gain, parents before children, and only while they gain anything.
    """
    n = len(tree.feature)
    g, h = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):  # children come after their parent
        if tree.feature[i] < 0:
            g[i], h[i] = sums.get(int(tree.value[i]), (0.0, 0.0))
        else:
            a, b = tree.left[i], tree.right[i]
            g[i], h[i] = g[a] + g[b], h[a] + h[b]

    def gain(i: int) -> float:
        a, b = tree.left[i], tree.right[i]
        return fall(g[a], h[a], l1, l2) + fall(g[b], h[b], l1, l2) - fall(g[i], h[i], l1, l2)

    taken: dict[int, float] = {}
    waiting = [(-gain(0), 0)] if tree.feature[0] >= 0 else []
    while waiting and len(taken) + 1 < leaves:
        best, i = heapq.heappop(waiting)
        if best >= 0:
            break
        taken[i] = -best
        for child in (tree.left[i], tree.right[i]):
            if tree.feature[child] >= 0:
                heapq.heappush(waiting, (-gain(child), child))
    out = Tree()

    def copy(i: int) -> int:
        if i in taken:
            here = out.add(tree.feature[i], tree.threshold[i], gain=taken[i])
            out.left[here], out.right[here] = copy(tree.left[i]), copy(tree.right[i])
            return here
        return out.add(value=leaf_value(g[i], h[i], l1, l2))

    copy(0)
    return out


class Lookup:
    """Values of many trees for rows of numbers: all trees go down one step at a time."""

    def __init__(self, trees: Sequence[Tree]) -> None:
        size = max(len(t.feature) for t in trees)
        pad = lambda rows, kind: np.array([[*r, *[0] * (size - len(r))] for r in rows], kind).ravel()
        self.feature = pad([t.feature for t in trees], np.int64)
        self.threshold = pad([t.threshold for t in trees], np.float64)
        self.left = pad([t.left for t in trees], np.int64)
        self.right = pad([t.right for t in trees], np.int64)
        self.value = pad([t.value for t in trees], np.float64)
        self.base = np.arange(len(trees)) * size
        self.depth = max(_depth(t) for t in trees)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One column for each tree."""
        out = np.empty((len(x), len(self.base)))
        step = max(1, _CELLS // len(self.base))
        for low in range(0, len(x), step):
            part = x[low : low + step]
            row = np.arange(len(part))[:, None]
            at = np.tile(self.base, (len(part), 1))
            for _ in range(self.depth):
                feature = self.feature[at]
                down = np.where(part[row, np.maximum(feature, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(feature < 0, at, down + self.base)
            out[low : low + step] = self.value[at]
        return out


def _depth(tree: Tree) -> int:
    level = [0] * len(tree.feature)
    for i, f in enumerate(tree.feature):
        if f >= 0:
            level[tree.left[i]] = level[tree.right[i]] = level[i] + 1
    return max(level)


def tree_sql(tree: Tree, x: str) -> str:
    """The value of a tree as a SQL expression over an array column ``x``: for a few trees at a
    time, which then stay inside generated code."""

    def node(i: int) -> str:
        if tree.feature[i] < 0:
            return f"{tree.value[i]!r}D"
        yes, no = node(tree.left[i]), node(tree.right[i])
        return f"CASE WHEN {x}[{tree.feature[i]}] <= {tree.threshold[i]!r}D THEN {yes} ELSE {no} END"

    return node(0)


def tree_values(trees: Sequence[Tree], features: str = "features") -> Column:
    """An array with the value of each tree, looked up on Arrow batches."""
    lookup = Lookup(trees)

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            found = lookup(np.stack(x.to_numpy())) if len(x) else []
            yield pd.Series(list(found), dtype=object)

    return values(vector_to_array(features))


def leaf_means(lookup: np.ndarray, leaves: str) -> Column:
    """The mean over the trees of what their leaves hold: ``lookup[tree, leaf]`` is a vector and
    ``leaves`` a vector column of leaf numbers, as a ``pyspark.ml`` forest gives.

    On Arrow batches, one gather and one mean each; a join with a table of leaves would multiply
    the rows by the number of trees.
    """
    which = np.arange(lookup.shape[0])

    @F.pandas_udf("array<double>")
    def means(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            at = np.stack(x.to_numpy()).astype(np.int64) if len(x) else None
            yield pd.Series([] if at is None else list(lookup[which, at].mean(axis=1)), dtype=object)

    return means(vector_to_array(leaves))


def node_table(spark, trees: Sequence[Sequence[Tree]]) -> DataFrame:
    """Nodes of ``trees[round][member]``; as many rows as the model has nodes."""
    rows = [r for i, side in enumerate(trees) for m, t in enumerate(side) for r in t.rows(m, i)]
    return spark.createDataFrame(rows, NODES)


def read_nodes(nodes: DataFrame) -> list[list[Tree]]:
    trees: dict[tuple[int, int], Tree] = {}
    for r in sorted(nodes.collect(), key=lambda r: (r["round"], r["member"], r["node"])):
        tree = trees.setdefault((r["round"], r["member"]), Tree())
        here = tree.add(r["feature"], r["threshold"], r["value"], r["gain"])
        tree.left[here], tree.right[here] = r["left"], r["right"]
    rounds = 1 + max((i for i, _ in trees), default=-1)
    members = 1 + max((m for _, m in trees), default=-1)
    return [[trees[i, m] for m in range(members)] for i in range(rounds)]
