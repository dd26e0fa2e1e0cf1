"""Second-order boosted trees on binned features: level by level, best leaf first, or symmetric with ordered gradients.

Rows are coded once (a byte a feature) and stay where they are. Each round, tasks add up gradients and Hessians by node,
feature and bin; the sums of a block of features meet in one task, which hands the driver its best split. So the driver sees a
row for each node and block, and no task sees more than the sums of its blocks. Sums are whole numbers of UNIT, so that models
don't depend on the order in which tasks meet.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tessera.sources.shared import written

#: Most bins of a feature; features whose sums meet in one task; numbers that are sampled to place the bins' edges.
BINS, BLOCK, SAMPLED = 64, 64, 4_000_000
#: Gradients are whole numbers of this. Some 10**10 rows of mean weight fit 64 bits.
UNIT = 2.0**-28
#: Trees that jobs add up again before margins are written.
KEPT_TREES = 10
#: Cells (rows times features) that are added up at once.
CELLS = 1 << 21


@dataclass
class Tree:
    """Nodes by number, 0 the root: rows whose code of feature is at most bin go left. Leaves have left = -1."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    #: A value for each model (one, but for ordered boosting).
    value: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))

    def split(self, node: int, feature: int, at: int) -> int:
        """Give the node two children; the left one's number (the right one follows)."""
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.left)
        for x, v in ((self.feature, 0), (self.bin, 0), (self.left, -1)):
            x += [v, v]
        return self.left[node]

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, at, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(rows := rows[left[node[rows]] >= 0]):
            n = node[rows]
            node[rows] = left[n] + (codes[rows, feature[n]] > at[n])
        return node


def mixed(ids: np.ndarray, salt: int) -> np.ndarray:
    """Draws in [0, 1) that depend on the row and the salt alone."""
    x = ids.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def edges(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of all bins but the last of each feature, from quantiles of a bounded sample (SAMPLED numbers)."""
    most = max(256, SAMPLED // max(width, 1))
    drawn = rows.select("x", F.xxhash64("x", F.monotonically_increasing_id()).alias("_h")).orderBy("_h").limit(most).toPandas()
    x = np.stack(drawn["x"].to_numpy()) if len(drawn) else np.zeros((0, width))
    out = []
    for j in range(width):
        known = np.unique(x[~np.isnan(x[:, j]), j])
        if len(known) > bins:
            known = np.unique(np.quantile(x[~np.isnan(x[:, j]), j], np.linspace(0, 1, bins + 1)[1:], method="lower"))
        out.append(known[:-1])
    return out


def coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each number; NaN is in the first."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(c, x[:, j], "left"))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of the log loss in UNITs (whole, as doubles)."""
    p = 1 / (1 + np.exp(-margin))
    return np.round(w * (p - y) / UNIT), np.round(w * np.maximum(p * (1 - p), 1e-16) / UNIT)


@dataclass
class Split:
    """The best split of a node: what it gains, where, and the sums on both sides."""

    gain: float
    feature: int
    at: int
    sums: np.ndarray  # (left, right) x (gradient, Hessian)


@dataclass(frozen=True)
class Rules:
    """How trees grow. ``growth``: level, leaf or symmetric."""

    growth: str = "level"
    trees: int = 800
    rate: float = 0.03
    depth: int = 6
    leaves: int = 64
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    least_hessian: float = 1.0
    bins: int = BINS
    seed: int = 42
    #: Prefix models of ordered boosting; 0 for none.
    prefixes: int = 0

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + self.l2)

    def value(self, sums: np.ndarray) -> np.ndarray:
        """Leaf values of sums (..., 2)."""
        return -self.rate * sums[..., 0] / (sums[..., 1] + self.l2)


def prefix_of(ids: np.ndarray, rules: Rules) -> np.ndarray:
    """The prefix model that a row is scored by: rows are laid out by a fixed draw u, and a row with u in [2**-(j+1), 2**-j) by
    the model of the rows before 2**-(j+1). Model 0 has learned from all rows, model j + 1 from u < 2**-(j+1); the last from none."""
    return 1 + np.minimum(np.floor(-np.log2(np.maximum(mixed(ids, rules.seed), 2.0**-50))).astype(np.int64), rules.prefixes)


class Rows:
    """The coded rows and the trees whose sums aren't in their margins yet."""

    def __init__(self, table: DataFrame, width: int, rules: Rules, base: float):
        self.table, self.width, self.rules, self.base, self.fresh = table, width, rules, base, []
        self.models = rules.prefixes + 2 if rules.prefixes else 1

    def batches(self) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
        """Of a batch: ids, codes, labels, weights and margins (rows x models) with the fresh trees added."""
        width, models, fresh = self.width, self.models, list(self.fresh)

        def each(batch: pa.RecordBatch) -> Iterator[tuple]:
            step = max(1, CELLS // max(width, 1))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, width)
                margins = _matrix(part.column("margins"), models)
                for tree in fresh:
                    margins = margins + tree.value[tree.leaf(codes)]
                yield tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "w")) + (codes, margins)

        return each

    def add(self, tree: Tree) -> None:
        self.fresh.append(tree)
        if len(self.fresh) >= KEPT_TREES:
            each, schema = self.batches(), self.table.schema

            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for ids, y, w, codes, margins in each(batch):
                        yield pa.RecordBatch.from_pydict({"id": ids, "y": y, "w": w, "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "margins": pa.array(list(margins), pa.list_(pa.float64()))})

            self.table, self.fresh = written(self.table.mapInArrow(task, schema)), []

    def sums(self, tree: Tree, nodes: list[int], columns: np.ndarray, number: int) -> DataFrame:
        """node, block, sums: for each of these leaves of a tree and each block of columns, the sums by feature and bin."""
        each, rules, bins = self.batches(), self.rules, self.rules.bins
        place = {n: i for i, n in enumerate(nodes)}
        blocks = [columns[i : i + BLOCK] for i in range(0, len(columns), BLOCK)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, len(nodes), len(columns), bins), np.int64)
            at = np.full(len(tree.left), -1)
            at[list(place)] = list(place.values())
            for batch in batches:
                for ids, y, w, codes, margins in each(batch):
                    node = at[tree.leaf(codes)]
                    drawn = node >= 0
                    if rules.row_share < 1:
                        drawn &= mixed(ids, rules.seed + 1 + number) < rules.row_share
                    # An ordered model's structure is chosen by what the rows' own prefixes say of them.
                    own = margins[np.arange(len(ids)), prefix_of(ids, rules)] if rules.prefixes else margins[:, 0]
                    g, h = _gradients(own[drawn], y[drawn], w[drawn])
                    cells = ((node[drawn][:, None] * len(columns) + np.arange(len(columns))) * bins + codes[drawn][:, columns]).ravel()
                    for k, v in enumerate((g, h)):
                        total[k] += np.bincount(cells, np.repeat(v, len(columns)), total[k].size).astype(np.int64).reshape(total[k].shape)
            rows = [(n, b, np.ascontiguousarray(total[:, i, b * BLOCK : b * BLOCK + len(c)]).tobytes()) for i, n in enumerate(nodes) for b, c in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["node", "block", "sums"])

        return self.table.mapInArrow(task, "node int, block int, sums binary")

    def splits(self, tree: Tree, nodes: list[int], columns: np.ndarray, number: int) -> dict[int, Split]:
        """The best split of each leaf that has one; together, for all of them one feature and bin (symmetric)."""
        rules, bins, together = self.rules, self.rules.bins, self.rules.growth == "symmetric"
        partial = self.sums(tree, nodes, columns, number)
        keys = ["block"] if together else ["node", "block"]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:  # one by one: only the sums of this task's nodes and blocks are held
                for n, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    own = np.frombuffer(raw, np.int64)
                    total[n, b] = total[n, b] + own if (n, b) in total else own
            groups: dict[int | tuple[int, int], list] = {}
            for (n, b), s in sorted(total.items()):
                groups.setdefault(b if together else (n, b), []).append((n, b, s.reshape(2, -1, bins) * UNIT))
            out = []
            for own in groups.values():
                left = [np.cumsum(s, axis=2)[:, :, :-1] for _, _, s in own]
                whole = [s.sum(axis=2, keepdims=True) for _, _, s in own]
                gains: np.ndarray | float = 0.0
                for lo, all_ in zip(left, whole):
                    hi = all_ - lo
                    each = rules.score(lo[0], lo[1]) + rules.score(hi[0], hi[1]) - rules.score(all_[0], all_[1])
                    fits = (lo[1] >= rules.least_hessian) & (hi[1] >= rules.least_hessian)
                    gains = gains + np.where(fits, each, 0.0 if together else -np.inf)
                i = int(np.argmax(gains))
                gain, where = float(gains.flat[i]), np.unravel_index(i, gains.shape)
                if gain <= 1e-9:
                    continue
                for (n, b, _), lo, all_ in zip(own, left, whole):
                    sides = np.stack([lo[:, where[0], where[1]], (all_[:, where[0], 0] - lo[:, where[0], where[1]])])
                    out.append((n, int(columns[b * BLOCK + where[0]]), int(where[1]), gain, sides.ravel().tolist()))
            names = ["node", "feature", "at", "gain", "sums"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        met = partial.repartition(*keys).mapInArrow(task, "node int, feature int, at int, gain double, sums array<double>").collect()
        best: dict[int, Split] = {}
        for r in sorted(met, key=lambda r: (-r["gain"], r["feature"], r["at"])):
            best.setdefault(r["node"], Split(r["gain"], r["feature"], r["at"], np.array(r["sums"]).reshape(2, 2)))
        if together and best:
            top = min(best.values(), key=lambda s: (-s.gain, s.feature, s.at))
            best = {n: s for n, s in best.items() if (s.feature, s.at) == (top.feature, top.at)}
        return best

    def leaf_sums(self, tree: Tree) -> np.ndarray:
        """For each node and model, the sums of the rows that the model learns from (all rows, drawn or not)."""
        each, rules, models = self.batches(), self.rules, self.models

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, len(tree.left) * models))
            for batch in batches:
                for ids, y, w, codes, margins in each(batch):
                    leaf, last = tree.leaf(codes), prefix_of(ids, rules) if models > 1 else np.ones(len(ids), np.int64)
                    for m in range(models):
                        learns = m < last  # a row is scored by the first model that hasn't learned from it
                        for k, v in enumerate(_gradients(margins[learns, m], y[learns], w[learns])):
                            total[k] += np.bincount(leaf[learns] * models + m, v, total.shape[1])
            at = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[k, at].astype(np.int64)) for k in range(2))], ["at", "g", "h"])

        out = np.zeros((len(tree.left) * models, 2))
        for at, g, h in self.table.mapInArrow(task, "at int, g bigint, h bigint").groupBy("at").agg(F.sum("g"), F.sum("h")).collect():
            out[at] = g * UNIT, h * UNIT
        return out.reshape(len(tree.left), models, 2)


def grown(rows: Rows, number: int) -> Tree | None:
    """The next tree; None where no split gains."""
    rules = rows.rules
    share = max(1, round(rules.column_share * rows.width))
    columns = np.sort(np.random.default_rng([rules.seed, number]).permutation(rows.width)[:share])
    tree, known = Tree(), {}
    if rules.growth == "leaf":
        tree, known = best_first(rows, columns, number)
    else:
        open_ = [0]
        for _ in range(rules.depth):
            found = rows.splits(tree, open_, columns, number)
            open_ = []
            for n, s in sorted(found.items()):
                left = tree.split(n, s.feature, s.at)
                known |= {left: s.sums[0], left + 1: s.sums[1]}
                open_ += [left, left + 1]
            if not open_:
                break
    if len(tree.left) == 1:
        return None
    if rows.models > 1:
        tree.value = rules.value(rows.leaf_sums(tree))
    else:
        tree.value = np.zeros((len(tree.left), 1))
        for n, s in known.items():
            tree.value[n, 0] = rules.value(s)
    return tree


def best_first(rows: Rows, columns: np.ndarray, number: int) -> tuple[Tree, dict[int, np.ndarray]]:
    """A tree that always splits the leaf that gains most, until it has rules.leaves.

    Splits of a leaf don't depend on other leaves, so each job looks at the children of every leaf that may yet be split; then
    leaves are taken in order of gain as far as all that matters is known. What was looked at in vain is cut off.
    """
    rules = rows.rules
    ahead, splits, looked, sums = Tree(), {}, set(), {}
    todo = [0]
    while True:
        splits |= rows.splits(ahead, todo, columns, number)
        looked |= set(todo)
        # The order in which leaves are split, as far as it is known.
        heap, chosen, stopped = [(-splits[0].gain, 0)] if 0 in splits else [], [], False
        while heap and len(chosen) + 1 < rules.leaves:
            _, n = heapq.heappop(heap)
            chosen.append(n)
            if ahead.left[n] < 0 or ahead.left[n] not in looked:
                stopped = len(chosen) + 1 < rules.leaves
                break
            for child in (ahead.left[n], ahead.left[n] + 1):
                if child in splits:
                    heapq.heappush(heap, (-splits[child].gain, child))
        if not stopped:
            break
        waiting = [n for _, n in heap] + [chosen[-1]]
        todo = []
        for n in sorted(waiting, key=lambda n: -splits[n].gain)[: rules.leaves - len(chosen) + 1]:
            if ahead.left[n] < 0:
                left = ahead.split(n, splits[n].feature, splits[n].at)
                todo += [left, left + 1]
        todo = todo or [ahead.left[chosen[-1]], ahead.left[chosen[-1]] + 1]
    tree, number_of = Tree(), {0: 0}
    for n in chosen:
        s = splits[n]
        left = tree.split(number_of[n], s.feature, s.at)
        sums |= {left: s.sums[0], left + 1: s.sums[1]}
        if ahead.left[n] >= 0:
            number_of |= {ahead.left[n]: left, ahead.left[n] + 1: left + 1}
    return tree, sums


class BoostedTrees(Transformer):
    """Trees over coded features; margins are base plus the trees' values."""

    def __init__(self, cuts: list[np.ndarray], base: float, trees: list[Tree]):
        super().__init__()
        self.cuts, self.base, self.trees = cuts, base, trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        codes = coded(x, self.cuts)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaf(codes), 0]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        width, margins = len(self.cuts), BoostedTrees(self.cuts, self.base, self.trees).margins

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in parts:
                x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, width))
                yield pd.Series(1 / (1 + np.exp(-margins(x))))

        df = df.withColumn("_p", score(vector_to_array("features")))
        return df.withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")


class HistogramBooster(Estimator):
    """Boosting by the given rules. Weights are taken from a column weight, if there is one, and scaled to a mean of 1."""

    def __init__(self, rules: Rules = Rules()):
        super().__init__()
        self.rules, self.label = rules, "label"

    def setLabelCol(self, name: str) -> HistogramBooster:  # noqa: N802
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> BoostedTrees:
        rules = self.rules
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        rows = df.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"), weight.alias("w"))
        width, n, mean, share = rows.agg(F.max(F.size("x")), F.count("y"), F.avg("w"), F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()
        if not n or share is None or share <= 0 or share >= 1:  # one class only, or none
            return BoostedTrees([np.zeros(0)] * (width or 0), 0.0 if share is None else (30.0 if share >= 1 else -30.0), [])
        cuts, base = edges(rows, width, rules.bins), float(np.log(share / (1 - share)))
        models = rules.prefixes + 2 if rules.prefixes else 1

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = coded(_matrix(b.column("x"), width), cuts)
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "y": b.column("y"), "w": b.column("w"), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "margins": pa.array([[base] * models] * b.num_rows, pa.list_(pa.float64()))})

        ready = rows.filter(F.col("y").isNotNull()).select(F.monotonically_increasing_id().alias("id"), "x", "y", (F.col("w") / mean).alias("w"))
        state = Rows(written(ready.mapInArrow(code, "id bigint, y double, w double, codes binary, margins array<double>")), width, rules, base)
        trees: list[Tree] = []
        for number in range(rules.trees):
            tree = grown(state, number)
            if tree is None and rules.row_share >= 1 and rules.column_share >= 1:
                break  # nothing gains any more, and the next round would look at the same
            if tree is not None:
                trees.append(tree)
                state.add(tree)
        return BoostedTrees(cuts, base, trees)


def level_wise(trees: int = 800, **more) -> HistogramBooster:
    return HistogramBooster(Rules("level", trees, **more))


def leaf_wise(trees: int = 1200, **more) -> HistogramBooster:
    return HistogramBooster(Rules("leaf", trees, **{"l2": 1e-9, "least_hessian": 1e-3, **more}))


def ordered(trees: int = 1500, **more) -> HistogramBooster:
    return HistogramBooster(Rules("symmetric", trees, **{"l2": 3.0, "least_hessian": 0.0, "row_share": 1.0, "column_share": 1.0, "prefixes": 10, **more}))
