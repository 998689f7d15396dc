"""Seeded multi-objective search for formulas: NSGA-II on the driver, fitness in Spark batches.

The population is a few hundred trees at most; only its fitness needs the panel. One batch
evaluates all formulas of a generation that have no fitness yet.
"""

from __future__ import annotations

import hashlib
import random
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.factors import FACTORS
from ..operators.ic import INFEASIBLE, Fitness, composite_fitness
from ..sources.shared import Rounds
from .batch import evaluate
from .formula import MAX_NODES, Node, crossover, mutate, random_tree


class FitnessCache:
    """The latest `most` formulas' fitness, by SHA-256 of the formula."""

    def __init__(self, most: int = 10_000):
        self.most, self._of = most, OrderedDict()

    @staticmethod
    def key(tree: Node) -> str:
        return hashlib.sha256(str(tree).encode()).hexdigest()

    def get(self, tree: Node) -> Fitness | None:
        found = self._of.get(self.key(tree))
        if found is not None:
            self._of.move_to_end(self.key(tree))
        return found

    def put(self, tree: Node, fitness: Fitness) -> None:
        self._of[self.key(tree)] = fitness
        if len(self._of) > self.most:
            self._of.popitem(last=False)

    def __len__(self) -> int:
        return len(self._of)


def dominates(a: np.ndarray, b: np.ndarray) -> bool:
    return bool((a >= b).all() and (a > b).any())


def normalised(points: np.ndarray) -> np.ndarray:
    """Each objective from 0 to 1 over the points; 0.5 where all are equal."""
    low, span = points.min(0), np.ptp(points, axis=0)
    return np.where(span > 0, (points - low) / np.where(span > 0, span, 1), 0.5)


def fronts(points: np.ndarray) -> list[list[int]]:
    """Indices by non-dominated front, all objectives maximised."""
    better = (points[:, None] >= points[None]).all(2) & (points[:, None] > points[None]).any(2)
    left, out = set(range(len(points))), []
    while left:
        rest = sorted(left)
        own = [i for i in rest if not better[rest, i].any()]
        out.append(own)
        left -= set(own)
    return out


def crowding(points: np.ndarray) -> np.ndarray:
    """Sum over objectives of the distance between a point's neighbours; infinite at the ends."""
    out = np.zeros(len(points))
    for k in range(points.shape[1]):
        order = np.argsort(points[:, k], kind="stable")
        v = points[order, k]
        out[order[[0, -1]]] = np.inf
        if v[-1] > v[0]:
            out[order[1:-1]] += (v[2:] - v[:-2]) / (v[-1] - v[0])
    return out


def select(trees: list[Node], fitness: list[Fitness], k: int) -> list[int]:
    """Indices of `k` survivors: feasible ones by front and crowding, then infeasible ones as they come."""
    good = [i for i, f in enumerate(fitness) if f.feasible]
    bad = [i for i, f in enumerate(fitness) if not f.feasible]
    if len(good) <= k:
        return good + bad[: k - len(good)]
    points = normalised(np.array([[fitness[i].rank_ic, fitness[i].stability, fitness[i].diversity] for i in good]))
    chosen: list[int] = []
    for front in fronts(points):
        if len(chosen) + len(front) > k:
            far = crowding(points[front])
            front = [front[j] for j in np.argsort(-far, kind="stable")][: k - len(chosen)]
        chosen += front
        if len(chosen) == k:
            break
    return [good[i] for i in chosen]


def double_tournament(rng: random.Random, trees: list[Node], fitness: list[Fitness], k: int, *, fit_size: int = 3, parsimony: float = 1.4) -> list[int]:
    """Indices of `k` winners: fitness tournaments, then, with probability parsimony / 2, the smaller of two winners."""
    def best() -> int:
        return max((rng.randrange(len(trees)) for _ in range(fit_size)), key=lambda i: fitness[i].rank_ic)

    out = []
    for _ in range(k):
        a, b = best(), best()
        small, large = sorted((a, b), key=lambda i: trees[i].size)
        out.append(small if trees[small].size == trees[large].size or rng.random() < parsimony / 2 else large)
    return out


def pareto(trees: list[Node], fitness: list[Fitness]) -> list[int]:
    """Indices of the feasible non-dominated formulas, each once."""
    seen: dict[str, int] = {}
    for i, (t, f) in enumerate(zip(trees, fitness, strict=True)):
        if f.feasible:
            seen.setdefault(str(t), i)
    own = list(seen.values())
    if not own:
        return []
    points = np.array([[fitness[i].rank_ic, fitness[i].stability, fitness[i].diversity] for i in own])
    return [own[i] for i in fronts(points)[0]]


#: Rows that are compared with all others at once, and broadcast for that.
FRONT_BLOCK = 20_000


def _local_front(rows: DataFrame, objectives: list[str]) -> DataFrame:
    """Without the rows that others of the same task dominate, a thousand at a time."""
    def own_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in (b.slice(k, 1_000) for b in batches for k in range(0, b.num_rows, 1_000)):
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            points = np.stack([both.column(o).to_numpy().astype(float) for o in objectives], axis=1)
            new = len(both) - batch.num_rows
            # rows held so far don't dominate each other
            beaten = np.zeros(len(both), bool)
            for a, b in ((points, points[new:]), (points[new:], points)):
                better = (a[:, None] >= b[None]).all(2) & (a[:, None] > b[None]).any(2)
                beaten[len(both) - len(b) :] |= better.any(0)
            held = both.filter(pa.array(~beaten)).combine_chunks()
        yield from held.to_batches() if held is not None else []

    return rows.mapInArrow(own_front, rows.schema)


def _not_dominated(rows: DataFrame, by: DataFrame, objectives: list[str]) -> DataFrame:
    """The rows that none of `by`, which is small, dominates."""
    other = by.select(*[F.col(o).alias(f"_{o}") for o in objectives]).distinct()
    worse = [F.col(f"_{o}") >= F.col(o) for o in objectives]
    strict = [F.col(f"_{o}") > F.col(o) for o in objectives]
    return rows.join(F.broadcast(other), reduce(and_, worse) & reduce(or_, strict), "left_anti")


def pareto_front(scores: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """The rows of `scores` that no other dominates; an unknown objective is dominated by none and dominates none.

    Each task first leaves out what rows of its own dominate. Of what stays, those of the largest sums of
    objectives come first, a block at a time, as only larger sums can dominate: the front among them
    is final, and what it dominates goes from the rest. A block is a broadcast of known size however
    large the front is, but for rows that share one sum.
    """
    scores = scores.select(key, *[F.col(o).cast("double").alias(o) for o in objectives])
    total, block = reduce(add, [F.col(o) for o in objectives]), FRONT_BLOCK
    rest = _local_front(scores, objectives)
    if rest.limit(block + 1).count() <= block:
        return _not_dominated(rest, rest, objectives)
    # what comes first, however long that takes, is written, as is what is left
    spark = scores.sparkSession
    rest, fronts_ = Rounds(spark).write(rest), []
    known = reduce(and_, [F.col(o).isNotNull() for o in objectives])
    unknown, left, rounds = rest.where(~known), rest.where(known), Rounds(spark)
    while not left.isEmpty():
        least = left.select(total.alias("t")).orderBy(F.desc("t")).limit(block).agg(F.min("t")).first()[0]
        top = left.where(total >= least)
        fronts_.append(Rounds(spark).write(_not_dominated(top, top, objectives)))
        left = rounds.write(_not_dominated(left.where(total < least), fronts_[-1], objectives))
    return reduce(DataFrame.unionByName, [unknown, *fronts_]).select(key, *objectives)


def ranked_fronts(scores: DataFrame, key: str, objectives: list[str], most: int | None = None) -> DataFrame:
    """key, objectives, front (from 1 on), crowding: the front that each row is on once all before it are taken away.

    `key` tells rows apart. Fronts are peeled off one a round, up to `most` of them, beyond which rows have none;
    the state is one table, written in the shared folder. Crowding is the sum over the objectives of
    the distance between a row's neighbours on its front by that objective, then key, as a share of the front's
    range; infinite at the ends. Rows with an unknown objective are on the first front.
    """
    spark, state = scores.sparkSession, scores.select(key, *[F.col(o).cast("double").alias(o) for o in objectives], F.lit(None).cast("int").alias("front"))
    rounds, front = Rounds(spark), 0
    state = rounds.write(state)
    while most is None or front < most:
        rest = state.where(F.col("front").isNull())
        if rest.isEmpty():
            break
        front += 1
        own = pareto_front(rest.drop("front"), key, objectives).select(F.col(key).alias("_own")).distinct()
        marked = state.join(own, F.col(key).eqNullSafe(F.col("_own")) & F.col("front").isNull(), "left")
        state = rounds.write(marked.withColumn("front", F.coalesce("front", F.when(F.col("_own").isNotNull(), front))).drop("_own"))
    of_front = Window.partitionBy("front")

    def apart(o: str) -> Column:
        by = of_front.orderBy(o, key)
        below, above, span = F.lag(o).over(by), F.lead(o).over(by), F.max(o).over(of_front) - F.min(o).over(of_front)
        return F.when(below.isNull() | above.isNull(), float("inf")).when(span > 0, (above - below) / span).otherwise(0.0)

    return state.withColumn("crowding", F.when(F.col("front").isNotNull(), reduce(add, [apart(o) for o in objectives])))


class SubtreeStore:
    """Columns of evaluated subtrees, by SHA-256 of the subtree, beside the keys and columns of a panel.

    `most` of them are kept from one batch of formulas to the next, those that were used last; only
    nodes that aren't there are computed, over the few columns that they need, and joined to the others
    by the panel's keys. Each batch's table is written in the shared folder, which cuts its lineage,
    and replaces the one before.
    """

    KEYS = ("date_utc", "ticker")

    def __init__(self, panel: DataFrame, ret: str, most: int = 1_000):
        self.panel, self.ret, self.most = panel, ret, most
        self.computed = 0  # nodes, over all batches
        self._kept: OrderedDict[str, Node] = OrderedDict()
        self._rounds: Rounds | None = None
        self._table: DataFrame | None = None

    @staticmethod
    def name(tree: Node) -> str:
        """The column of a subtree; a panel's own column keeps its name."""
        return f"n_{hashlib.sha256(str(tree).encode()).hexdigest()[:32]}" if tree.args else tree.op

    def _over_kept(self, tree: Node) -> Node:
        """The tree with columns in place of the subtrees that are kept."""
        if self.name(tree) in self._kept:
            return Node(self.name(tree))
        return replace(tree, args=tuple(map(self._over_kept, tree.args)))

    def _down_to_kept(self, tree: Node) -> Iterator[Node]:
        """Nodes that evaluating the tree takes, down to those that are kept."""
        if tree.args:
            yield tree
            if self.name(tree) not in self._kept:
                for a in tree.args:
                    yield from self._down_to_kept(a)

    def columns(self, trees: list[Node]) -> DataFrame:
        """The panel's keys and return, and the column name(t) of each tree, as a table that later calls may replace."""
        wanted = dict.fromkeys(n for t in trees for n in self._down_to_kept(t))
        new = {self.name(n): self._over_kept(n) for n in wanted if self.name(n) not in self._kept}
        if new:
            self._add(new, wanted, {self.name(t) for t in trees if t.args})
        for n in [*wanted, *(t for t in trees if t.args)]:
            if self.name(n) in self._kept:
                self._kept.move_to_end(self.name(n))
        leaves = list(dict.fromkeys(t.op for t in trees if not t.args))
        return self._with_panel(leaves).select(*self.KEYS, self.ret, *dict.fromkeys(map(self.name, trees)))

    def _with_panel(self, columns: list[str]) -> DataFrame:
        """The table with some columns of the panel's."""
        if self._table is None:
            return self.panel.select(*self.KEYS, self.ret, *[c for c in columns if c != self.ret])
        more = [c for c in columns if c not in self._table.columns]
        return self._table.join(self.panel.select(*self.KEYS, *more), [*self.KEYS]) if more else self._table

    def _add(self, new: dict[str, Node], wanted: dict[Node, None], roots: set[str]) -> None:
        """Computes nodes and writes the table anew; nothing is kept of nodes that fail."""
        needed = dict.fromkeys(c for t in new.values() for c in t.columns)
        source = self._with_panel([c for c in needed if c not in self._kept])
        found = evaluate(source.select(*self.KEYS, *needed), new).select(*self.KEYS, *new)
        kept = self._kept.copy()
        for n in wanted:
            kept[self.name(n)] = n
            kept.move_to_end(self.name(n))
        # the roots at hand stay, whatever `most` is
        for name in [k for k in kept if k not in roots][: max(0, len(kept) - self.most)]:
            del kept[name]
        old = self._with_panel([]).select(*self.KEYS, self.ret, *[k for k in kept if k not in new])
        self._rounds = self._rounds or Rounds(self.panel.sparkSession)
        self._table = self._rounds.write(old.join(found.select(*self.KEYS, *[k for k in kept if k in new]), [*self.KEYS]))
        self._kept, self.computed = kept, self.computed + len(new)

    def __len__(self) -> int:
        return len(self._kept)

    def clear(self) -> None:
        """Forgets all columns and deletes their table."""
        self._kept.clear()
        self._table = None
        if self._rounds is not None:
            self._rounds.clear()


@dataclass
class Search:
    """`panel` has the factors and the forward return `ret`, one row for each date and ticker; it is best persisted.

    A formula that is known on a date which `return_dates`, if given, lacks is infeasible, as is one
    that can't be evaluated.
    """

    panel: DataFrame
    ret: str
    population: int = 100
    generations: int = 50
    mate: float = 0.5
    change: float = 0.2
    seed: int = 42
    most: int = MAX_NODES
    return_dates: DataFrame | None = None
    names: list[str] = field(default_factory=lambda: list(FACTORS))
    batch: int = 100
    cache: FitnessCache = field(default_factory=FitnessCache)
    failed: set[Node] = field(default_factory=set)
    store: SubtreeStore | None = None

    def __post_init__(self):
        if self.store is None:
            self.store = SubtreeStore(self.panel, self.ret)

    def score(self, trees: list[Node], others: list[Node]) -> list[Fitness]:
        """Fitness of all trees; what has none yet is evaluated in batches, with all `others` for diversity but those that failed."""
        todo = [t for t in dict.fromkeys(trees) if self.cache.get(t) is None]
        against = [t for t in dict.fromkeys(others) if t not in self.failed]
        found: dict[Node, Fitness] = {}
        for a in range(0, len(todo), self.batch):
            found |= self._isolated(todo[a : a + self.batch], against)
        for tree, fitness in found.items():
            self.cache.put(tree, fitness)
        return [found.get(t) or self.cache.get(t) for t in trees]

    def _isolated(self, part: list[Node], against: list[Node]) -> dict[Node, Fitness]:
        """Fitness of each of a batch. One that fails is halved until the formula that it fails for stands alone, which is
        then infeasible: for one of n formulas that takes 2 log n further batches. If the panel itself can't be read, that is raised.
        """
        try:
            return self._batch(part, against)
        except Exception:
            if len(part) > 1:
                half = len(part) // 2
                return self._isolated(part[:half], against) | self._isolated(part[half:], against)
            self.panel.write.format("noop").mode("overwrite").save()
            self.failed.add(part[0])
            return {part[0]: Fitness(*INFEASIBLE)}

    def _batch(self, part: list[Node], against: list[Node]) -> dict[Node, Fitness]:
        own = {SubtreeStore.name(t): t for t in part}
        wide = self.store.columns([*part, *against])
        # a formula may be one of the others: columns of its own keep their names apart
        beside = {f"_other{k}": SubtreeStore.name(t) for k, t in enumerate(against)}
        wide = wide.select(*SubtreeStore.KEYS, self.ret, *own, *[F.col(c).alias(k) for k, c in beside.items()]).persist()
        try:
            rows = composite_fitness(wide, self.ret, list(own), list(beside), self.return_dates).collect()
        finally:
            wide.unpersist()
        found = {r["formula"]: Fitness(r["rank_ic"], r["stability"], r["diversity"]) for r in rows}
        return {t: found.get(name, Fitness(*INFEASIBLE)) for name, t in own.items()}

    def run(self) -> list[tuple[Node, Fitness]]:
        """The Pareto front after all generations; equal seeds give equal fronts."""
        try:
            return self._run()
        finally:
            self.store.clear()

    def _run(self) -> list[tuple[Node, Fitness]]:
        rng = random.Random(self.seed)
        trees = [random_tree(rng, names=self.names) for _ in range(self.population)]
        fitness = self.score(trees, [Node(n) for n in self.names])
        for _ in range(self.generations):
            children = list(trees)
            for i in range(0, len(children) - 1, 2):
                if rng.random() < self.mate:
                    children[i], children[i + 1] = crossover(rng, children[i], children[i + 1], self.most)
                for j in (i, i + 1):
                    if rng.random() < self.change:
                        children[j] = mutate(rng, children[j], self.names, self.most)
            both = trees + children
            scores = fitness + self.score(children, trees)
            kept = select(both, scores, self.population)
            trees, fitness = [both[i] for i in kept], [scores[i] for i in kept]
        return [(trees[i], fitness[i]) for i in pareto(trees, fitness)]
