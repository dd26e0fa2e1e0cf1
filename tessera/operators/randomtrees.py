"""Extremely randomised trees: thresholds are drawn between the least and largest value that a node has of a feature.

Nodes of many rows grow together, a level a round, over the whole table. A round has two passes: the first finds the ranges of
the features that were drawn for each open node, the second counts what the drawn thresholds would send left. Tasks hand on sums
by node; a node's sums meet in one task, and the driver gets a row for each open node. Rows of a node of at most ``LOCAL_ROWS``
rows meet in one task, which grows all that is below it. So the driver holds the tops of trees alone, a few nodes for each
``LOCAL_ROWS`` rows; what is below them is a table, and rows that are asked meet their part of it by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tessera.sources.shared import written

#: Weights are whole numbers of this, so that sums don't depend on their order.
UNIT = 2.0**-28
#: Cells (rows times features) that a task looks at at once.
CELLS = 1 << 21
#: Rows of a node, at most, whose tree below it one task grows (fewer, where they have many features).
LOCAL_ROWS = 8192
#: Groups that trees grow in, and are asked in, where each of them has all rows in one task: rows are dealt out once a group, not once a tree.
GROUPS = 64
#: Asked rows of one node that meet in a task.
ASKED_ROWS = 65_536
#: Shares of classes are added up as whole numbers of this, so that sums don't depend on their order.
SHARE = 2.0**-40


@dataclass
class Tree:
    """Nodes by number, 0 the root: rows with feature <= threshold go left. Leaves have left = -1."""

    feature: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    #: Class weights of the rows of each node.
    classes: list[np.ndarray] = field(default_factory=list)

    def split(self, node: int, feature: int, threshold: float, left: np.ndarray, right: np.ndarray) -> int:
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, len(self.left)
        self.feature += [0, 0]
        self.threshold += [0.0, 0.0]
        self.left += [-1, -1]
        self.classes += [left, right]
        return self.left[node]

    def stored(self) -> tuple[bytes, ...]:
        return tuple(np.asarray(v, kind).tobytes() for v, kind in ((self.feature, np.int32), (self.threshold, np.float64), (self.left, np.int32), (np.concatenate(self.classes), np.float64)))

    @classmethod
    def read(cls, feature: bytes, threshold: bytes, left: bytes, classes: bytes) -> Tree:
        left = np.frombuffer(left, np.int32)
        return cls(np.frombuffer(feature, np.int32), np.frombuffer(threshold), left, np.frombuffer(classes).reshape(len(left), -1))

    def shares(self) -> np.ndarray:
        leaves = np.stack(self.classes)
        return leaves / np.maximum(leaves.sum(1, keepdims=True), 1)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[left[node[rows]] >= 0]):
            n = node[rows]
            node[rows] = left[n] + (x[rows, feature[n]] > threshold[n])
        return node


@dataclass
class Open:
    """A node that may be split: rows it has, its depth, and how often features were drawn for it in vain."""

    tree: int
    node: int
    rows: int
    depth: int
    tried: int = 0


def features_of(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def _numbers(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    flat = pa.chunked_array([batch.column("x")]) if isinstance(batch, pa.RecordBatch) else batch.column("x")
    return features_of(flat.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width))


def best_of(left: np.ndarray, rows: np.ndarray, whole: np.ndarray, varied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best candidate, whether there is one) of each node; left: node x candidate x (rows, weight of each class) on the left side."""
    useful = varied & (left[:, :, 0] > 0) & (left[:, :, 0] < rows[:, None])
    l_ = left[:, :, 1:].astype(np.float64)
    r_ = whole[:, None, :] - l_
    score = (l_**2).sum(2) / np.maximum(l_.sum(2), 1) + (r_**2).sum(2) / np.maximum(r_.sum(2), 1)
    score = np.where(useful, score, -1.0)
    best = np.argmax(score >= score.max(1, keepdims=True) * (1 - 1e-12), axis=1)  # the first of those that rounding alone tells apart
    return best, useful.any(1)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of x as bytes."""
    step = x.shape[1] * 8
    ends = pa.py_buffer((np.arange(len(x) + 1) * step).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(np.ascontiguousarray(x, np.float64).tobytes())])


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def grown_below(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, make: ExtraTrees, tree: int, top: int, depth: int) -> Tree:
    """The tree below node top of a tree, from all of its rows; nodes get numbers of their own, from 0, round by round."""
    width, k = x.shape[1], make.tried_features(x.shape[1])
    key = [make.seed, tree] if top == 0 else [make.seed, tree, top]
    # The whole tree, if its root is so small, has the draws that it has when it grows over the table.
    features = lambda o: np.random.default_rng([*key, o.node, *([0] if top else [])]).permutation(width)[o.tried * k : (o.tried + 1) * k]
    weights = lambda rows: np.bincount(y[rows], w[rows], classes)
    grown, waiting = Tree(), [Open(tree, 0, len(x), depth)]
    rows, ends = np.arange(len(x)), np.array([0, len(x)])
    grown.classes.append(weights(rows))
    while True:
        stays = np.array([goes_on(o, grown, make, width) for o in waiting], bool)
        sizes = np.diff(ends)
        rows, sizes, waiting = rows[np.repeat(stays, sizes)], sizes[stays], [o for o, s in zip(waiting, stays) if s]
        if not waiting:
            return grown
        wanted = np.stack([np.resize(features(o), k) for o in waiting])
        lots = np.stack([np.random.default_rng([*key, o.node, o.tried + 1]).random(k) for o in waiting])
        slot, first = np.repeat(np.arange(len(waiting)), sizes), np.cumsum(sizes) - sizes
        values = x[rows[:, None], wanted[slot]]
        low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
        thresholds = low + lots * (high - low)
        thresholds = np.where(thresholds >= high, low, thresholds)
        lefts = values <= thresholds[slot]
        each = [lefts] + [lefts * (w[rows] * (y[rows] == c))[:, None] for c in range(classes)]
        left = np.stack([np.add.reduceat(e.astype(np.int64), first) for e in each], axis=2)
        whole = np.stack([grown.classes[o.node] for o in waiting])
        best, found = best_of(left, sizes, whole, high > low)
        now, waiting, place = waiting, [], np.zeros((len(waiting), 2), np.int64)
        for s, o in enumerate(now):
            place[s] = len(waiting)
            if not found[s]:
                waiting.append(Open(tree, o.node, o.rows, o.depth, o.tried + 1))
                continue
            b = best[s]
            l_ = left[s, b, 1:].astype(np.float64)
            child, n = grown.split(o.node, int(wanted[s, b]), float(thresholds[s, b]), l_, whole[s] - l_), int(left[s, b, 0])
            place[s, 1] += 1
            waiting += [Open(tree, child, n, o.depth + 1), Open(tree, child + 1, o.rows - n, o.depth + 1)]
        to = place[slot, (~lefts[np.arange(len(rows)), best[slot]]).astype(np.int64)]
        rows = rows[np.argsort(to, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(waiting)))])


def goes_on(o: Open, tree: Tree, make: ExtraTrees, width: int) -> bool:
    mixed = (tree.classes[o.node] > 0).sum() > 1
    return mixed and o.rows >= make.min_split and o.depth < make.depth and o.tried * make.tried_features(width) < width


def routed(df: DataFrame, trees: list[Tree], wanted: dict[int, list[int]], names: dict[str, str], width: int) -> DataFrame:
    """tree, node, x (as bytes) and the named columns of df (x and these): each row at those of the wanted nodes that it comes to."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, max(1, CELLS // max(width, 1))):
                part = batch.slice(i, max(1, CELLS // max(width, 1)))
                x = _numbers(part, width)
                for t, nodes in wanted.items():
                    node = trees[t].leaf(x)
                    at = np.flatnonzero(np.isin(node, nodes))
                    if len(at):
                        kept = [part.column(n).take(pa.array(at)) for n in names]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(node[at], pa.int32()), _binary(x[at]), *kept], ["tree", "node", "x", *names])

    return df.select("x", *names).mapInArrow(task, "tree int, node int, x binary" + "".join(f", {n} {kind}" for n, kind in names.items()))


def in_groups(df: DataFrame, groups: int) -> DataFrame:
    """df once for each group, in tasks that aren't put together: the rows are few, and growing takes the time."""
    met = df.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return met.repartition(max(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "group")


def _merged(partial: DataFrame, how: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type) -> dict[int, np.ndarray]:
    """The values of each slot, merged where they meet; slots are open nodes, so their number is the driver's own."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, kind)
                met[slot] = how(met[slot], own) if slot in met else own
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.array([v.tobytes() for v in met.values()], pa.binary())], ["slot", "found"])

    return {r[0]: np.frombuffer(r[1], kind) for r in partial.repartition("slot").mapInArrow(task, "slot int, found binary").collect()}


class Growth:
    """One forest while it grows."""

    def __init__(self, table: DataFrame, width: int, classes: int, make: ExtraTrees):
        self.table, self.width, self.classes, self.make = table, width, classes, make
        self.trees = [Tree() for _ in range(make.trees)]

    def drawn(self, o: Open) -> np.ndarray:
        """The features that an open node looks at: further ones where the first were all constant."""
        k = self.make.tried_features(self.width)
        return np.random.default_rng([self.make.seed, o.tree, o.node]).permutation(self.width)[o.tried * k : (o.tried + 1) * k]

    def over_nodes(self, open_: list[Open], look: Callable) -> DataFrame:
        """slot, found: what look(values, y, w, first row of each node) finds of the candidates of each open node in a task's rows.

        look gives an array with a row for each node, from rows sorted by node; several batches' arrays are merged by the caller's
        merge at once, since they are handed on batch by batch."""
        width, trees = self.width, self.trees
        by_tree: dict[int, list[tuple[int, int]]] = {}
        for slot, o in enumerate(open_):
            by_tree.setdefault(o.tree, []).append((slot, o.node))
        k = self.make.tried_features(width)
        wanted = np.zeros((len(open_), k), np.int64)
        for slot, o in enumerate(open_):
            d = self.drawn(o)
            wanted[slot] = np.resize(d, k)  # fewer than k at the end: some twice

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, max(1, CELLS // max(width, 1))):
                    part = batch.slice(i, max(1, CELLS // max(width, 1)))
                    x, y, w = _numbers(part, width), part.column("y").to_numpy(), part.column("w").to_numpy()
                    slots, found = [], []
                    for t, nodes in by_tree.items():
                        at = np.full(len(trees[t].left), -1)
                        at[[n for _, n in nodes]] = [s for s, _ in nodes]
                        slot = at[trees[t].leaf(x)]
                        rows = np.flatnonzero(slot >= 0)
                        if not len(rows):
                            continue
                        rows = rows[np.argsort(slot[rows], kind="stable")]
                        met, first = np.unique(slot[rows], return_index=True)
                        values = x[rows[:, None], wanted[slot[rows]]]
                        found += list(look(values, y[rows], w[rows], slot[rows], first))
                        slots += met.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([f.tobytes() for f in found], pa.binary())], ["slot", "found"])

        return self.table.mapInArrow(task, "slot int, found binary")

    def ranges(self, open_: list[Open]) -> dict[int, np.ndarray]:
        """For each open node (least, largest) x candidate."""
        def look(values, y, w, slot, first):
            return np.stack([np.minimum.reduceat(values, first), -np.maximum.reduceat(values, first)], axis=1)

        found = _merged(self.over_nodes(open_, look), np.minimum, np.float64)
        return {s: v.reshape(2, -1) * [[1], [-1]] for s, v in found.items()}

    def sides(self, open_: list[Open], thresholds: np.ndarray) -> dict[int, np.ndarray]:
        """For each open node candidate x (rows, weight of each class) on the left side."""
        classes = self.classes

        def look(values, y, w, slot, first):
            left = values <= thresholds[slot]
            each = [left] + [left * (w * (y == c))[:, None] for c in range(classes)]
            return np.stack([np.add.reduceat(e.astype(np.int64), first) for e in each], axis=2)

        found = _merged(self.over_nodes(open_, look), np.add, np.int64)
        return {s: v.reshape(-1, 1 + classes) for s, v in found.items()}

    def two_valued(self) -> np.ndarray | None:
        """(least, largest) of each feature if none has a third value, as with bits: the first pass of every round isn't needed then."""
        width = self.width

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, third = np.full(width, np.inf), np.full(width, -np.inf), False
            for batch in batches:
                x = _numbers(batch, width)
                if third or not len(x):
                    continue
                known_low, known_high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                third = bool(((x > known_low) & (x < known_high)).any() or ((low > known_low) & (low < known_high)).any() or ((high > known_low) & (high < known_high)).any())
                low, high = known_low, known_high
            yield pa.RecordBatch.from_arrays([pa.array([low.tobytes()], pa.binary()), pa.array([high.tobytes()], pa.binary()), pa.array([third])], ["low", "high", "third"])

        parts = self.table.mapInArrow(seen, "low binary, high binary, third boolean").distinct().limit(3).collect()
        parts = [(np.frombuffer(r[0]), np.frombuffer(r[1])) for r in parts if not r[2]] if not any(r[2] for r in parts) else []
        parts = [p for p in parts if np.isfinite(p[0]).all()]
        # Tasks that saw the same two values of every feature, whatever their number; else the first pass is made.
        return np.stack(parts[0]) if len(parts) == 1 else None

    def grow(self, rows: int, weights: np.ndarray) -> tuple[list[Tree], DataFrame | None]:
        """(Tops of the trees, what is below them: tree, node and a Tree's four arrays as bytes; none if all leaves are in the tops)."""
        for t in self.trees:
            t.classes.append(weights)
        small, below = max(1, min(LOCAL_ROWS, 4 * CELLS // max(self.width, 1))), []
        waiting = [Open(i, 0, rows, 0) for i in range(len(self.trees))]
        k, bounds = self.make.tried_features(self.width), self.two_valued() if rows > small else None
        while waiting := [o for o in waiting if self.goes_on(o)]:
            below += [o for o in waiting if o.rows <= small]
            open_ = [o for o in waiting if o.rows > small]
            if not open_:
                break
            waiting, lots = [], np.array([np.random.default_rng([self.make.seed, o.tree, o.node, o.tried + 1]).random(k) for o in open_])
            if bounds is None:
                spans = self.ranges(open_)
                low, high = (np.stack([spans[s][i] for s in range(len(open_))]) for i in range(2))
            else:  # a node that has both values of a feature has the table's range of it
                low, high = (np.stack([b[np.resize(self.drawn(o), k)] for o in open_]) for b in bounds)
            thresholds = low + lots * (high - low)
            thresholds = np.where(thresholds >= high, low, thresholds)
            found = self.sides(open_, thresholds)
            left = np.stack([found[s] for s in range(len(open_))])
            whole = np.stack([self.trees[o.tree].classes[o.node] for o in open_])
            best, useful = best_of(left, np.array([o.rows for o in open_]), whole, high > low)
            for s, o in enumerate(open_):
                if not useful[s]:
                    o.tried += 1
                    waiting.append(o)
                    continue
                b, l_ = best[s], left[s, best[s], 1:].astype(np.float64)
                child = self.trees[o.tree].split(o.node, int(np.resize(self.drawn(o), k)[b]), float(thresholds[s, b]), l_, whole[s] - l_)
                n = int(left[s, b, 0])
                waiting += [Open(o.tree, child, n, o.depth + 1), Open(o.tree, child + 1, o.rows - n, o.depth + 1)]
        return self.trees, self.below(below) if below else None

    def below(self, open_: list[Open]) -> DataFrame:
        classes, make, width, depths, wanted = self.classes, self.make, self.width, {(o.tree, o.node): o.depth for o in open_}, {}
        for o in open_:
            wanted.setdefault(o.tree, []).append(o.node)
        fields = "tree int, node int, " + ", ".join(f"{n} binary" for n in BELOW)

        def stored(tops: list[tuple[int, int]], x: np.ndarray, part: pa.Table) -> pa.Table:
            y, w = part["y"].to_numpy(), part["w"].to_numpy()
            rows = [(tree, node, *grown_below(x, y, w, classes, make, tree, node, depths[tree, node]).stored()) for tree, node in tops]
            return pa.table([pa.array(v, kind) for v, kind in zip(zip(*rows), (pa.int32(),) * 2 + (pa.binary(),) * 4)], ["tree", "node", *BELOW])

        if not any(o.node for o in open_):
            groups = min(GROUPS, len(open_))

            def whole(key: tuple, part: pa.Table) -> pa.Table:
                return stored([(tree, 0) for tree in wanted if tree % groups == key[0].as_py()], _numbers(part, width), part)

            return written(in_groups(self.table, groups).groupBy("group").applyInArrow(whole, fields))

        def grow(key: tuple, part: pa.Table) -> pa.Table:
            return stored([tuple(v.as_py() for v in key)], _rows(part["x"]), part)

        met = routed(self.table, self.trees, wanted, {"y": "int", "w": "bigint"}, width)
        return written(met.groupBy("tree", "node").applyInArrow(grow, fields))

    def goes_on(self, o: Open) -> bool:
        return goes_on(o, self.trees[o.tree], self.make, self.width)


#: Arrays of a Tree in a table.
BELOW = ("feature", "threshold", "left", "classes")


class RandomisedTrees(Transformer):
    """The mean of the trees' shares of each class. trees are the tops; below is the table of what is below their open leaves."""

    def __init__(self, trees: list[Tree], classes: int, below: DataFrame | None = None, width: int = 0):
        super().__init__()
        self.trees, self.classes, self.below, self.width = trees, classes, below, width
        self.wanted: dict[int, list[int]] = {}
        for r in below.select("tree", "node").collect() if below is not None else ():  # the tops' leaves
            self.wanted.setdefault(r[0], []).append(r[1])

    def summed(self, asked: DataFrame) -> DataFrame:
        """_asked, _c0, _c1, ...: sums of the shares of each class in units of SHARE, of asked (_asked, x)."""
        trees, classes, wanted, width = self.trees, self.classes, self.wanted, self.width
        fields = "_asked bigint" + "".join(f", _c{c} bigint" for c in range(classes))

        def table(ids: pa.Array, shares: np.ndarray) -> pa.Table:
            return pa.table([ids, *(pa.array(np.round(shares[:, c] / SHARE).astype(np.int64)) for c in range(classes))], ["_asked", *(f"_c{c}" for c in range(classes))])

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows whose leaf is in the top."""
            closed = [t.shares() for t in trees]
            for t, nodes in wanted.items():
                closed[t][nodes] = 0.0
            for batch in batches:
                x, sums = _numbers(batch, width) if trees else np.zeros((batch.num_rows, 0)), np.zeros((batch.num_rows, classes))
                for t, shares in zip(trees, closed):
                    sums += np.round(shares[t.leaf(x)] / SHARE) * SHARE
                yield from table(batch.column("_asked"), sums).to_batches()

        said = asked.mapInArrow(tops, fields)
        if self.below is None:
            return said

        def low(key: tuple, rows: pa.Table, below: pa.Table) -> pa.Table:
            if not rows.num_rows or not below.num_rows:
                return table(pa.array([], pa.int64()), np.zeros((0, classes)))
            tree = Tree.read(*(below[n][0].as_py() for n in BELOW))
            return table(rows["_asked"].combine_chunks(), tree.shares()[tree.leaf(_rows(rows["x"]))])

        def whole(key: tuple, rows: pa.Table, below: pa.Table) -> pa.Table:
            sums = np.zeros((rows.num_rows, classes))
            x = _numbers(rows, width) if rows.num_rows else np.zeros((0, width))
            for arrays in zip(*(below[n].to_pylist() for n in BELOW)) if rows.num_rows else ():
                tree = Tree.read(*arrays)
                sums += np.round(tree.shares()[tree.leaf(x)] / SHARE) * SHARE
            return table(rows["_asked"].combine_chunks(), sums)

        if all(nodes == [0] for nodes in wanted.values()) and len(wanted) == len(trees):
            groups, parts = min(GROUPS, len(trees)), max(1, -(-asked.count() // ASKED_ROWS))
            each = in_groups(asked.withColumn("part", F.pmod(F.xxhash64("_asked"), F.lit(parts)).cast("int")), groups)
            low_ = self.below.select(F.pmod("tree", F.lit(groups)).alias("group"), *BELOW, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
            found = each.groupBy("group", "part").cogroup(low_.groupBy("group", "part")).applyInArrow(whole, fields)
            return found.groupBy("_asked").agg(*(F.sum(f"_c{c}").alias(f"_c{c}") for c in range(classes)))

        met = routed(asked, trees, wanted, {"_asked": "bigint"}, width)
        parts = met.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / ASKED_ROWS).cast("int").alias("parts"))
        parts = F.broadcast(written(parts))  # a row for each open leaf of the tops
        dealt = met.join(parts, ["tree", "node"]).withColumn("part", F.pmod(F.xxhash64("_asked"), F.col("parts")).cast("int")).drop("parts")
        below = self.below.join(parts, ["tree", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        keys = ["tree", "node", "part"]
        found = dealt.groupBy(*keys).cogroup(below.groupBy(*keys)).applyInArrow(low, fields)
        return said.unionAll(found).groupBy("_asked").agg(*(F.sum(f"_c{c}").alias(f"_c{c}") for c in range(classes)))

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = written(df.withColumn("_asked", F.monotonically_increasing_id()))
        sums = written(self.summed(asked.select("_asked", vector_to_array("features").alias("x"))))
        unit = SHARE / max(1, len(self.trees))
        p = F.array(*(F.col(f"_c{c}") * F.lit(unit) for c in range(self.classes)))
        df = asked.join(sums.select("_asked", p.alias("_p")), "_asked").drop("_asked")
        most = F.array_position("_p", F.array_max("_p")) - 1
        return df.withColumns({"probability": array_to_vector("_p"), "prediction": most.cast("double")}).drop("_p")


class ExtraTrees(Estimator):
    """Forests of such trees on all rows (no resampling). Labels are 0, 1, ...; weights come from a column weight, if there is one.

    Trees grow until their leaves are pure, have fewer than min_split rows, or lie at the given depth; a node whose drawn features
    are all constant draws further ones. The root of the number of features is tried at a node. NaN counts as 0.
    """

    def __init__(self, trees: int = 100, min_split: int = 2, depth: int = 30, seed: int = 42):
        super().__init__()
        self.trees, self.min_split, self.depth, self.seed, self.label = trees, min_split, depth, seed, "label"

    def setLabelCol(self, name: str) -> ExtraTrees:  # noqa: N802
        self.label = name
        return self

    @staticmethod
    def tried_features(width: int) -> int:
        return max(1, int(np.sqrt(width)))

    def _fit(self, df: DataFrame) -> RandomisedTrees:
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        rows = df.filter(F.col(self.label).isNotNull()).select(vector_to_array("features").alias("x"), F.col(self.label).cast("int").alias("y"), F.round(weight / UNIT).cast("bigint").alias("w"))
        table = written(rows)
        counts = {r[0]: (r[1], r[2], r[3]) for r in table.groupBy("y").agg(F.count(F.lit(1)), F.sum("w"), F.max(F.size("x"))).collect()}  # a row for each class
        if not counts:
            return RandomisedTrees([], 1)
        classes, width = max(counts) + 1, max(c[2] for c in counts.values())
        weights = np.array([counts.get(c, (0, 0, 0))[1] for c in range(classes)], np.float64)
        trees, below = Growth(table, width, classes, self).grow(sum(c[0] for c in counts.values()), weights)
        return RandomisedTrees(trees, classes, below, width)
