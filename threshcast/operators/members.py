"""Gradient boosting of several members side by side over one table.

Members are models of one kind that differ in loss, settings or the rows they may learn from:
the levels of a quantile ensemble, the folds and grid points of a search. A round grows one tree
for each member: those whose rows weigh the same together, a pass for each level of the trees
(``histograms.grow``), any other by a fit of its own (independent jobs, a few at a time). Both give
the sums that leaf values need; quantiles of residuals come from one grouped aggregation by member
and leaf, errors on held rows from one for all members, with the scores where these are written.
A table of scores, one number for each member and row, goes from round to round.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from threshcast.functions.columns import key_fraction
from threshcast.operators.histograms import DEALT, Cuts, Plan, columns_of, cuts_of, grow, grow_alone, leaf_quantiles, moved, values_of
from threshcast.operators.trees import Tree, cut_back, tree_sql, tree_values
from threshcast.session import discard, observed, settings

KEY = "__key"
#: Bytes of binned rows, targets and scores up to which a member is fitted whole in one task.
ALONE_BYTES = 32 << 20


@dataclass(frozen=True)
class Loss:
    """``kind`` is squared, poisson (scores are logs of means) or pinball (of a ``level``)."""

    kind: str = "squared"
    level: float = 0.5

    def start(self, y: Column, rows: Column, accuracy: int) -> Column:
        """The best constant, as an aggregate over the rows of a member."""
        own = F.when(rows, y)
        if self.kind == "pinball":
            return F.percentile_approx(own, self.level, accuracy).cast("double")
        return F.log(F.avg(own)) if self.kind == "poisson" else F.avg(own)

    def steps(self, y: Column, score: Column) -> tuple[Column, Column]:
        """Negative gradient and weight (second derivative, or 1) of a row."""
        if self.kind == "poisson":
            return y - F.exp(score), F.exp(score)
        if self.kind == "pinball":
            return F.when(y >= score, F.lit(self.level)).otherwise(F.lit(self.level - 1)), F.lit(1.0)
        return y - score, F.lit(1.0)

    @property
    def weighs(self) -> bool:
        """Whether rows have weights of their own."""
        return self.kind == "poisson"

    def value(self, y: Column, score: Column) -> Column:
        if self.kind == "poisson":
            return F.exp(score) - y * score
        if self.kind == "pinball":
            return F.when(y >= score, (y - score) * self.level).otherwise((score - y) * (1 - self.level))
        return (y - score) * (y - score) / 2

    def forecast(self, score: Column) -> Column:
        return F.exp(score) if self.kind == "poisson" else score


@dataclass(frozen=True)
class Growth:
    """How the trees of a member grow.

    Trees reach ``max_depth`` and are then cut back to the best ``leaves`` leaves. A leaf takes
    soft(sum of gradients, ``l1``) / (sum of weights + ``l2``); for the pinball loss it takes the
    level's quantile of its residuals instead. ``rate`` shrinks it.
    """

    rate: float = 0.1
    max_depth: int = 5
    leaves: int = 31
    min_leaf: int = 20
    l1: float = 0.0
    l2: float = 0.0
    row_share: float = 1.0
    row_period: int = 1
    feature_share: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Member:
    """``held`` is true, from the row's key alone, for rows the member must not learn from."""

    loss: Loss
    growth: Growth
    held: Column | None = None

    def learns(self) -> Column:
        return F.lit(True) if self.held is None else ~self.held


@dataclass
class Boosted:
    """Trees by round and member, and the members' first scores; ``losses`` are sums over the rows
    learnt from, by the number of rounds after which they were taken, and ``errors`` mean absolute
    errors over the rows held, after 0, 1, ... rounds."""

    members: list[Member]
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)
    losses: dict[int, list[float]] = field(default_factory=dict)
    errors: list[list[float]] = field(default_factory=list)
    scores: DataFrame | None = None

    def score(self, features: str = "features", rounds: int | None = None, members: Sequence[int] | None = None) -> list[Column]:
        """Scores of rows with a feature vector, for all members or those named."""
        picked = list(range(len(self.base)) if members is None else members)
        used = [side for side in self.trees[:rounds]]
        trees = [side[m] for m in picked for side in used]
        if not trees:
            return [F.lit(self.base[m]) for m in picked]
        values = tree_values(trees, features)
        n = len(used)
        total = lambda k: F.aggregate(F.slice(values, k * n + 1, n), F.lit(0.0), lambda a, b: a + b)
        return [F.lit(self.base[m]) + total(k) for k, m in enumerate(picked)]


@dataclass
class Boosting:
    """``at_once`` trees are grown side by side; scores are written every ``cut_every`` rounds."""

    rounds: int = 100
    cut_every: int = 5
    at_once: int = 4
    accuracy: int = 5000
    stop: Callable[[Boosted], bool] | None = None
    watch: bool = False

    def fit(self, data: DataFrame, members: Sequence[Member], n_features: int, max_bins: int, keep_scores: bool = False) -> Boosted:
        """``data`` has ``__key`` (a long that decides bags), ``x`` (an array of features), ``y`` and any
        further columns, which stay in the table of scores. ``watch`` takes the errors on held
        rows after every round; the losses are taken whenever scores are written. ``stop`` is
        asked when there are new ones."""
        members = list(members)
        starts = [m.loss.start(F.col("y"), m.learns(), self.accuracy).alias(f"s{i}") for i, m in enumerate(members)]
        *base, rows = data.agg(*starts, F.count(F.lit(1)).alias("rows")).first()
        if any(b is None or not math.isfinite(b) for b in base):
            raise ValueError("a member has no rows to learn from, or a mean that is not positive")
        out = Boosted(members, [float(b) for b in base])
        columns, pending = [c for c in data.columns if c != "F"], []
        level = [i for i, m in enumerate(members) if not m.loss.weighs]
        cuts, groups = None, self._conditions([m.learns() for m in members])
        if level:
            cuts = cuts_of(data, "x", groups[0], n_features, max_bins)
            data, columns = data.withColumn("__b", cuts.binned("x")), [*columns, "__b"]
        if not keep_scores and rows * (2 * n_features + 32) <= ALONE_BYTES and all(
            m.loss.kind == "squared" and m.growth.row_share >= 1 for m in members
        ):
            return self._alone(data, out, groups[1], n_features, cuts)
        loss = [F.sum(F.when(m.learns(), m.loss.value(F.col("y"), F.col("F")[i]))) for i, m in enumerate(members)]
        off = self._off(members) if self.watch else []
        table, first = observed(data.select(*columns, F.array(*[F.lit(b) for b in out.base]).alias("F")), "boosting", *loss, *off)
        out.losses[0] = list(first[: len(members)])
        if self.watch:
            out.errors.append(self._errors(first[len(members) :]))
        taken = self._taken(len(members))
        written, tasks, cores = table, 0, table.sparkSession.sparkContext.defaultParallelism
        if level:
            tasks = table.rdd.getNumPartitions()
            if tasks < cores and rows > DEALT:
                table, tasks = observed(table.repartition(cores), "boosting")[0], cores
                discard(written)
                written = table
        with ThreadPool(min(len(members), self.at_once)) as pool:
            for i in range(self.rounds):
                now = self._scored(table, columns, pending, members, cuts)
                if self.watch:
                    if len(out.errors) == i:
                        out.errors.append(self._errors(now.agg(*[o.alias(f"e{k}") for k, o in enumerate(off)]).first()))
                    if self.stop is not None and self.stop(out):
                        break
                single = inheritable_thread_target(table.sparkSession)(lambda m: self._grow(now, members[m], m, i, n_features, max_bins))
                grown = dict(zip(level, self._grown(now, members, level, groups[1], i, n_features, cuts, tasks, rows > DEALT)))
                others = [m for m in range(len(members)) if m not in grown]
                grown.update(zip(others, pool.map(single, others)))
                side = self._valued(now, out, [grown[m] for m in range(len(members))], i, cuts, rows)
                out.trees.append(side)
                pending = [*pending, side]
                if i + 1 in taken:
                    table, sums = observed(self._scored(table, columns, pending, members, cuts), "boosting", *loss, *off)
                    out.losses[i + 1] = list(sums[: len(members)])
                    if self.watch:
                        out.errors.append(self._errors(sums[len(members) :]))
                    discard(written)
                    written, pending = table, []
                    if not self.watch and self.stop is not None and self.stop(out):
                        break
        now = self._scored(table, columns, pending, members, cuts)
        if self.watch and len(out.errors) == len(out.trees):
            out.errors.append(self._errors(now.agg(*[o.alias(f"e{k}") for k, o in enumerate(off)]).first()))
        if keep_scores:
            out.scores = now
        else:
            discard(written)
        return out

    def _alone(self, data: DataFrame, out: Boosted, cuts_at: list[int], n_features: int, cuts: Cuts) -> Boosted:
        """All rounds of a member in one task, over a table so small that each member may have a copy
        of it: what the passes give, without a job for each level of a tree."""
        members, rounds, watch = out.members, self.rounds, self.watch
        plans = [
            [Plan(0, None, -1, c, self._features(m.growth, i, n_features), m.growth.max_depth, m.growth.min_leaf) for i in range(rounds)]
            for m, c in zip(members, cuts_at)
        ]
        growths, base, taken = [m.growth for m in members], out.base, self._taken(len(members))

        def fitted(batches):
            t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
            if t is None:
                return
            t = t.sort_by("at").combine_chunks()
            m, y, columns = t["m"][0].as_py(), t["y"].to_numpy(), columns_of(t["b"], n_features)
            learns, held = (t[c].to_numpy(zero_copy_only=False) for c in ("learns", "held"))
            own, score, trees, errors, losses = np.flatnonzero(learns), np.full(len(y), base[m]), [], [], []
            for i in range(rounds + 1):
                if watch:
                    errors.append(float(np.abs(y - score)[held].mean()) if held.any() else math.nan)
                if i == 0 or i in taken:
                    losses.append(float(((y - score)[own] ** 2).sum() / 2))
                if i == rounds:
                    break
                g = growths[m]
                tree, sums = grow_alone(plans[m][i], cuts, columns, own, y - score)
                tree = cut_back(tree, sums, g.leaves, g.l1, g.l2)
                tree.value = [v * g.rate for v in tree.value]
                score = score + values_of(tree, cuts, columns)
                trees.append([tree.feature, tree.threshold, tree.left, tree.right, tree.value, tree.gain])
            yield pa.RecordBatch.from_pydict({"m": pa.array([m], pa.int32()), "trees": [json.dumps(trees)],
                                              "errors": pa.array([errors], pa.list_(pa.float64())), "losses": [losses]})

        each = F.explode(F.array(*[
            F.struct(F.lit(i).alias("m"), F.coalesce(m.learns(), F.lit(False)).alias("learns"),
                     F.coalesce(F.lit(False) if m.held is None else m.held, F.lit(False)).alias("held"))
            for i, m in enumerate(members)
        ])).alias("p")
        rows = data.select(F.monotonically_increasing_id().alias("at"), F.col("__b").alias("b"), "y", each).select("at", "b", "y", "p.*")
        shape = "m int, trees string, errors array<double>, losses array<double>"
        found = sorted(rows.repartitionById(len(members), F.col("m")).mapInArrow(fitted, shape).collect(), key=lambda r: r["m"])
        trees = [[Tree(*t) for t in json.loads(r["trees"])] for r in found]
        errors, losses = list(zip(*(r["errors"] for r in found))), list(zip(*(r["losses"] for r in found)))
        for i in range(rounds + 1):
            if i == 0 or i in taken:
                out.losses[i] = list(losses[len(out.losses)])
                if i and not watch and self.stop is not None and self.stop(out):
                    break
            if watch:
                out.errors.append(list(errors[i]))
                if i < rounds and self.stop is not None and self.stop(out):
                    break
            if i < rounds:
                out.trees.append([t[i] for t in trees])
        return out

    def _taken(self, members: int) -> set[int]:
        """The rounds after which scores are written and losses taken."""
        return set(range(0, self.rounds, max(1, self.cut_every // members))) - {0}

    @staticmethod
    def _conditions(wanted: list[Column]) -> tuple[list[Column], list[int]]:
        """The different conditions, and which of them each of those wanted is."""
        names = [str(c) for c in wanted]
        first = {n: i for i, n in reversed(list(enumerate(names)))}
        order = sorted(first.values())
        return [wanted[i] for i in order], [order.index(first[n]) for n in names]

    def _grown(self, now: DataFrame, members: list[Member], picked: list[int], cuts_at: list[int], number: int,
               n_features: int, cuts: Cuts | None, tasks: int, counted: bool = False) -> list[tuple[Tree, dict]]:
        """Trees of the members whose rows weigh the same, from common passes."""
        if not picked:
            return []
        conditions, at = self._conditions([self._bag(members[m], number) for m in picked])
        every = len(conditions) == 1 and str(conditions[0]) == str(F.lit(True))
        plans = [
            Plan(m, members[m].loss.level if members[m].loss.kind == "pinball" else None, -1 if every else c, cuts_at[m],
                 self._features(members[m].growth, number, n_features), members[m].growth.max_depth, members[m].growth.min_leaf)
            for m, c in zip(picked, at)
        ]
        return grow(now, plans, [] if every else conditions, cuts, tasks, counted)

    @staticmethod
    def _features(g: Growth, number: int, n_features: int) -> list[int]:
        if g.feature_share >= 1:
            return list(range(n_features))
        return _draw(n_features, max(1, round(n_features * g.feature_share)), g.seed + number)

    @staticmethod
    def _off(members: list[Member]) -> list[Column]:
        """Aggregates with the mean absolute error of each member on the rows held from it."""
        errors = []
        for i, m in enumerate(members):
            off = F.abs(F.col("y") - m.loss.forecast(F.col("F")[i]))
            errors.append(F.avg(F.when(F.lit(False) if m.held is None else m.held, off)))
        return errors

    @staticmethod
    def _errors(found: Sequence[float | None]) -> list[float]:
        return [math.nan if e is None else e for e in found]

    def _scored(self, table: DataFrame, columns: list[str], pending: list[list[Tree]], members: list[Member], cuts: Cuts | None = None) -> DataFrame:
        """``table`` with the scores after the rounds not yet written."""
        if not pending:
            return table
        if cuts is not None and not any(m.loss.weighs for m in members):
            return table.select(*columns, moved(pending, cuts).alias("F"))
        after = [
            " + ".join([f"F[{m}]", *(tree_sql(side[m], "x") for side in pending)]) for m in range(len(members))
        ]
        return table.select(*columns, F.expr(f"array({', '.join(after)})").alias("F"))

    def _bag(self, member: Member, number: int) -> Column:
        own, g = member.learns(), member.growth
        if g.row_share < 1:
            own = own & (key_fraction([KEY], g.seed + number // g.row_period) < g.row_share)
        return own

    def _grow(self, now: DataFrame, member: Member, place: int, number: int, n_features: int, max_bins: int) -> tuple[Tree, dict]:
        g = member.growth
        gradient, weight = member.loss.steps(F.col("y"), F.col("F")[place])
        rows = now.filter(self._bag(member, number)).select(
            array_to_vector("x").alias("features"), (gradient / weight).alias("__z"), weight.alias("__w")
        )
        picked = self._features(g, number, n_features)
        if g.feature_share < 1:
            rows = VectorSlicer(inputCol="features", outputCol="__x", indices=picked).transform(rows)
        learner = DecisionTreeRegressor(
            featuresCol="__x" if g.feature_share < 1 else "features", labelCol="__z", weightCol="__w",
            maxDepth=g.max_depth, minInstancesPerNode=g.min_leaf, maxBins=max_bins, seed=g.seed + number,
        )
        fitted = learner.fit(rows)  # held: its JVM side goes with it
        return Tree.grown(fitted._java_obj.rootNode(), picked)

    def _valued(self, now: DataFrame, out: Boosted, grown: list[tuple[Tree, dict]], number: int, cuts: Cuts | None, rows: int) -> list[Tree]:
        """The grown trees cut back; a leaf's value comes from the sums the fit has taken, or for the
        pinball loss from the residuals of its rows, for all members in one aggregation."""
        side = []
        for (tree, sums), member in zip(grown, out.members):
            g = member.growth
            side.append(cut_back(tree, sums, g.leaves, g.l1, g.l2))
        if any(m.loss.kind == "pinball" for m in out.members):
            rest = self._quantiles(now, out.members, side, number, cuts, rows)
            for tree, member, found in zip(side, out.members, rest):
                if member.loss.kind == "pinball":
                    for leaf in tree.leaves:
                        tree.value[leaf] = found.get(leaf, 0.0)
        for tree, member in zip(side, out.members):
            tree.value = [v * member.growth.rate for v in tree.value]
        return side

    def _quantiles(self, now: DataFrame, members: list[Member], side: list[Tree], number: int, cuts: Cuts | None, rows: int) -> list[dict[int, float]]:
        """By member and leaf the level's quantile of the residuals, from mergeable sketches; one
        row for each leaf reaches the driver. Spark's sketch takes microseconds for each residual, so
        tables of many rows have sorted ones of the same accuracy."""
        if rows > DEALT and all(m.loss.kind == "pinball" for m in members):
            conditions, at = self._conditions([self._bag(m, number) for m in members])
            if len(conditions) == 1 and str(conditions[0]) == str(F.lit(True)):
                conditions, at = [], [-1] * len(members)
            return leaf_quantiles(now, side, [m.loss.level for m in members], at, conditions, cuts, self.accuracy)
        levels, parts = sorted({m.loss.level for m in members}), []
        for i, (tree, m) in enumerate(zip(side, members)):
            leaf = tree_sql(replace(tree, value=[float(k) for k in range(len(tree.feature))]), "x")
            rest = F.when(self._bag(m, number), F.col("y") - F.col("F")[i])
            parts.append(F.struct(F.lit(i).alias("m"), F.expr(leaf).cast("int").alias("leaf"), rest.alias("rest")))
        each = now.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter("rest is not null")
        groups = max(128, min(4096, 1 + sum(len(t.leaves) for t in side)))
        with settings(now.sparkSession, spark_sql_objectHashAggregate_sortBased_fallbackThreshold=groups):
            found = each.groupBy("m", "leaf").agg(F.percentile_approx("rest", levels, self.accuracy).alias("q")).collect()
        out: list[dict[int, float]] = [{} for _ in members]
        for r in found:
            out[r["m"]][r["leaf"]] = float(r["q"][levels.index(members[r["m"]].loss.level)])
        return out


def _draw(n: int, k: int, seed: int) -> list[int]:
    return sorted(random.Random(seed).sample(range(n), k))

