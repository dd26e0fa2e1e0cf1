"""Networks with rectified units, trained by Adam in synchronous mini-batches: a perceptron on features, and a graph network on
molecules' graphs (sums over neighbours, sums over atoms).

Tasks of one barrier stage hold the rows. Up to LEARNER_ROWS rows have one learner: each step the tasks add up the gradients of the rows that
the step's batch has with each of them, and all take the same step. More rows have a learner for each LEARNER_ROWS: learners take the steps
of their own rows, and after ROUND steps at most, and after each epoch, all go on from the mean of their parameters and moments (local steps with averaging). So the steps
that follow one another don't grow in number with the rows, as long as there are tasks for the learners. A row's learner and batch follow from its
number and the epoch, so a model doesn't depend on the number of tasks (but for the last bits of sums). A lost task starts the stage
again. What goes from task to task has the network's size, whatever the number of rows. Each task holds its rows in memory, so a training
set is bounded by the memory of MOST_TASKS tasks. Equal graphs are one row that weighs as much as they do.
"""

from __future__ import annotations

import json
import math
import secrets
import socket
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tessera.sources.shared import written

#: Rows for which another task is worth the exchange of gradients, and the most tasks.
ROWS_A_TASK, MOST_TASKS = 2_000, 32
#: Rows of a learner, and its steps before learners meet.
LEARNER_ROWS, ROUND = 8_192, 64
#: Adam's usual constants.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor) + np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def drawn(shapes: Sequence[tuple[int, int]], seed: int) -> list[np.ndarray]:
    """Weights and zero intercepts of layers (inputs, outputs)."""
    rng, out = np.random.default_rng(seed), []
    for a, b in shapes:
        limit = math.sqrt(6 / (a + b))
        out += [rng.uniform(-limit, limit, (a, b)), np.zeros(b)]
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def surprise(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log loss of logits, summed, and its slopes."""
    return float((w * (np.logaddexp(0, z) - y * z)).sum()), w * (logistic(z) - y)


class Dense:
    """Layers of rectified units and one output over a matrix of features."""

    columns = ("x",)

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)

    def start(self, seed: int) -> list[np.ndarray]:
        return drawn(list(zip(self.sizes, [*self.sizes[1:], 1])), seed)

    def load(self, table: pa.Table) -> np.ndarray:
        flat = table.column("x").combine_chunks().flatten() if table.num_rows else pa.array([], pa.float64())
        return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(table.num_rows, self.sizes[0])

    def pick(self, x: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return x[rows]

    def forward(self, params: list[np.ndarray], x: np.ndarray, learn: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Logits, and what each layer was given."""
        given = []
        for i in range(0, len(params), 2):
            given.append(x)
            x = x @ params[i] + params[i + 1]
            x = np.maximum(x, 0) if i + 2 < len(params) else x
        return x[:, 0], given

    def backward(self, params: list[np.ndarray], given: list[np.ndarray], slope: np.ndarray) -> list[np.ndarray]:
        out, back = [], slope[:, None]
        for i in range(len(params) - 2, -1, -2):
            x = given[i // 2]
            out = [x.T @ back, back.sum(axis=0), *out]
            back = (back @ params[i].T) * (x > 0) if i else back
        return out


class Graphs:
    """Rounds of neighbour sums: each atom's numbers and its neighbours' go through two layers of rectified units; atoms are summed.

    Atom 0 (an unreadable text, a wildcard) starts as zeros. Dropout follows from row, atom, unit and epoch.
    """

    columns = ("atoms", "heads", "tails")

    def __init__(self, kinds: int, hidden: int, rounds: int, dropout: float):
        self.kinds, self.hidden, self.rounds, self.dropout = kinds, hidden, rounds, dropout

    def start(self, seed: int) -> list[np.ndarray]:
        sizes = [self.kinds] + [self.hidden] * self.rounds
        return drawn([s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b, b))] + [(self.hidden, 1)], seed)

    def load(self, table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """name: (all values, ends by row); edges by head, so that sums over neighbours are runs."""
        out = {}
        for name in self.columns:
            lists = table.column(name).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
            out[name] = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        heads, ends = out["heads"]
        order = np.lexsort((heads, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
        return out | {"heads": (heads[order], ends), "tails": (out["tails"][0][order], ends)}

    def pick(self, part: dict, rows: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The graphs of some rows as one: atoms, edges, where each graph begins; keys are the rows' random numbers of an epoch."""
        def runs(name: str) -> tuple[np.ndarray, np.ndarray]:
            values, ends = part[name]
            sizes = ends[rows + 1] - ends[rows]
            at = np.arange(sizes.sum()) + np.repeat(ends[rows] - (np.cumsum(sizes) - sizes), sizes)
            return values[at], sizes

        atoms, sizes = runs("atoms")
        first = np.cumsum(sizes) - sizes
        heads, many = runs("heads")
        heads, tails = heads + np.repeat(first, many), runs("tails")[0] + np.repeat(first, many)
        starts = np.flatnonzero(np.diff(heads, prepend=-1)) if len(heads) else np.zeros(0, np.int64)
        places = np.arange(len(atoms)) - np.repeat(first, sizes)
        return {"atoms": atoms, "tails": tails, "starts": starts, "sums": heads[starts], "first": first, "sizes": sizes, "keys": mixed(np.repeat(keys, sizes) + places.astype(np.uint64))}

    @staticmethod
    def around(g: dict, x: np.ndarray) -> np.ndarray:
        """x of each atom and its neighbours, summed. Edges run both ways, so this is its own transpose."""
        out = x.copy()
        if len(g["starts"]):
            out[g["sums"]] += np.add.reduceat(x[g["tails"]], g["starts"], axis=0)
        return out

    def kept(self, g: dict, layer: int) -> np.ndarray:
        units = mixed(np.arange(self.hidden, dtype=np.uint64) + np.uint64(self.hidden * (layer + 1))) | np.uint64(1)
        return (g["keys"][:, None] * units[None, :] >= np.uint64(self.dropout * 2.0**64)) / (1 - self.dropout)

    def forward(self, params: list[np.ndarray], g: dict, learn: bool = False) -> tuple[np.ndarray, tuple]:
        x = np.zeros((len(g["atoms"]), self.kinds))
        real = np.flatnonzero((g["atoms"] > 0) & (g["atoms"] < self.kinds))
        x[real, g["atoms"][real]] = 1.0
        given = []
        for r in range(self.rounds):
            w1, b1, w2, b2 = params[4 * r : 4 * r + 4]
            met = self.around(g, x)
            inner = np.maximum(met @ w1 + b1, 0)
            outer = inner @ w2 + b2
            gate = (outer > 0) * (self.kept(g, r) if learn and self.dropout else 1.0)
            given.append((met, inner, gate))
            x = outer * gate
        whole = np.add.reduceat(x, g["first"], axis=0) if len(g["first"]) else np.zeros((0, self.hidden))
        return (whole @ params[-2] + params[-1])[:, 0], (g, given, whole)

    def backward(self, params: list[np.ndarray], seen: tuple, slope: np.ndarray) -> list[np.ndarray]:
        g, given, whole = seen
        out = [whole.T @ slope[:, None], slope.sum(keepdims=True)]
        back = np.repeat(slope[:, None] @ params[-2].T, g["sizes"], axis=0)
        for r in range(self.rounds - 1, -1, -1):
            w1, _, w2, _ = params[4 * r : 4 * r + 4]
            met, inner, gate = given[r]
            back = back * gate
            deep = (back @ w2.T) * (inner > 0)
            out = [met.T @ deep, deep.sum(axis=0), inner.T @ back, back.sum(axis=0), *out]
            back = self.around(g, deep @ w1.T) if r else back
        return out


def slopes(net, params: list[np.ndarray], picked, y: np.ndarray, w: np.ndarray, learn: bool = True) -> tuple[float, list[np.ndarray]]:
    """The summed loss of some rows, and its slope by each parameter."""
    z, seen = net.forward(params, picked, learn)
    loss, slope = surprise(z, y, w)
    return loss, net.backward(params, seen, slope)


class Ring:
    """The tasks of a barrier stage, joined by sockets to the first: its address and a word that callers must say go round once by the
    stage's own gathering, which takes up to a second a call. A broken connection fails the task, and so the stage starts again.
    """

    def __init__(self, task: BarrierTaskContext | None, wait: float = 600.0):
        self.first, self.peers = task is None or task.partitionId() == 0, []
        if task is None:
            return
        infos, door, word = task.getTaskInfos(), None, ""
        if self.first:
            door = socket.create_server((infos[0].address.rsplit(":", 1)[0], 0))
            door.settimeout(wait)
            word = secrets.token_hex(16)
        host, port, word = json.loads(task.allGather(json.dumps([*door.getsockname()[:2], word] if door else None))[0])
        if not door:
            up = socket.create_connection((host, port), wait)
            up.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            up.sendall(word.encode() + task.partitionId().to_bytes(4, "big"))
            self.peers = [up]
            return
        met: dict[int, socket.socket] = {}
        with door:
            while len(met) < len(infos) - 1:
                peer, _ = door.accept()
                peer.settimeout(wait)
                peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                said = self.read(peer, len(word) + 4)
                if secrets.compare_digest(bytes(said[: len(word)]), word.encode()):
                    met[int.from_bytes(said[len(word) :], "big")] = peer
                else:
                    peer.close()
        self.peers = [met[i] for i in sorted(met)]

    @staticmethod
    def read(peer: socket.socket, size: int) -> bytearray:
        out = bytearray(size)
        view = memoryview(out)
        while len(view):
            got = peer.recv_into(view)
            if not got:
                raise ConnectionError("a task of the stage has gone")
            view = view[got:]
        return out

    def sum(self, numbers: np.ndarray) -> np.ndarray:
        """The sum of all tasks' numbers, in the order of tasks."""
        if not self.peers:
            return numbers
        if not self.first:
            self.peers[0].sendall(numbers.tobytes())
            return np.frombuffer(self.read(self.peers[0], numbers.nbytes))
        numbers = numbers + sum(np.frombuffer(self.read(p, numbers.nbytes)) for p in self.peers)
        for p in self.peers:
            p.sendall(numbers.tobytes())
        return numbers

    def close(self) -> None:
        for p in self.peers:
            p.close()


class Adam:
    """Parameters, and the moments of their slopes."""

    def __init__(self, params: list[np.ndarray], rate: float, penalty: float):
        self.shapes, self.flat, self.rate, self.penalty, self.t = [p.shape for p in params], np.concatenate([p.ravel() for p in params]), rate, penalty, 0
        self.ends = np.cumsum([p.size for p in params])[:-1]
        self.weights = np.concatenate([np.full(p.size, float(p.ndim > 1)) for p in params])  # intercepts bear no penalty
        self.moved, self.spread = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def params(self) -> list[np.ndarray]:
        return [p.reshape(s) for p, s in zip(np.split(self.flat, self.ends), self.shapes)]

    def step(self, slope: np.ndarray, n: float) -> float:
        """A step along the summed slopes of n rows; what the penalty adds to their loss."""
        held = self.flat * self.weights
        slope, self.t = (slope + self.penalty * held) / n, self.t + 1
        self.moved, self.spread = FIRST * self.moved + (1 - FIRST) * slope, SECOND * self.spread + (1 - SECOND) * slope**2
        self.flat = self.flat - self.rate * (self.moved / (1 - FIRST**self.t)) / (np.sqrt(self.spread / (1 - SECOND**self.t)) + TINY)
        return self.penalty * float(held @ held) / 2

    def state(self) -> np.ndarray:
        return np.concatenate([self.flat, self.moved, self.spread])

    def take(self, state: np.ndarray, t: int) -> None:
        (self.flat, self.moved, self.spread), self.t = np.split(state, 3), t


def trained(rows: DataFrame, net, epochs: int, batch: int, rate: float, penalty: float = 0.0, patience: int | None = None, tolerance: float = 1e-4, seed: int = 42, tasks: int | None = None) -> tuple[list[np.ndarray], list[float]]:
    """(parameters, mean loss of each epoch). rows: _row, _y, _w, _n (how many rows it stands for) and the net's columns; each task holds its
    share of them.

    patience: stop once so many epochs in a row haven't lowered the loss by tolerance. No rows: the starting parameters.
    """
    count, whole = rows.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not count:
        return net.start(seed), []
    slots = rows.sparkSession.conf.get("spark.default.parallelism", None) or rows.sparkSession.sparkContext.defaultParallelism
    learners = -(-count // LEARNER_ROWS)
    most = min(MOST_TASKS, int(slots))
    tasks = tasks or max(1, min(most, -(-count // ROWS_A_TASK) if learners == 1 else learners))
    batch = min(batch, count)
    steps = -(-count // (batch * learners))
    local = ROUND if learners > 1 else 1

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(BarrierTaskContext.get() if tasks > 1 else None)
        have = list(batches)
        table = pa.Table.from_batches(have) if have else pa.table({c: [] for c in ("_row", "_y", "_w", "_n", *net.columns)})
        part, number = net.load(table), table.column("_row").to_numpy().astype(np.uint64)
        y, w, copies = (np.asarray(table.column(c).to_numpy(), np.float64) for c in ("_y", "_w", "_n"))
        where = (mixed(number) % np.uint64(learners)).astype(np.int64)
        own = np.unique(where) if learners > 1 else np.zeros(1, np.int64)
        ours, losses, t, best, idle = Adam(net.start(seed), rate, penalty), [], 0, math.inf, 0
        each = Adam(net.start(seed), rate, penalty)

        def found(at: np.ndarray, keys: np.ndarray, params: list[np.ndarray]) -> np.ndarray:
            loss, slope = slopes(net, params, net.pick(part, at, keys[at]), y[at], w[at])
            return np.concatenate([*(f.ravel() for f in slope), [loss, copies[at].sum()]])

        for epoch in range(epochs):
            keys = mixed(number ^ mixed(np.array([seed * 1_000_003 + epoch]))[0])
            lot = where * steps + (keys % np.uint64(steps)).astype(np.int64)
            order = np.lexsort((number, lot))
            cuts, lost = np.searchsorted(lot[order], np.arange(learners * steps + 1)), 0.0
            for first in range(0, steps, local):
                if learners == 1:
                    summed = ring.sum(found(order[cuts[first] : cuts[first + 1]], keys, ours.params()))
                    if summed[-1]:
                        lost += summed[-2] + ours.step(summed[:-2], summed[-1])
                    continue
                met, begun = np.zeros(3 * len(ours.flat) + 2), ours.state()
                for k in own:
                    each.take(begun, t)
                    for at in range(k * steps + first, k * steps + min(first + local, steps)):
                        if cuts[at] < cuts[at + 1]:
                            given = found(order[cuts[at] : cuts[at + 1]], keys, each.params())
                            met[-2] += given[-2] + each.step(given[:-2], given[-1])
                    met += np.concatenate([each.state(), [0.0, 1.0]])
                met = ring.sum(met)
                lost, t = lost + met[-2], t + min(local, steps - first)
                ours.take(met[:-2] / met[-1], t)
            losses.append(lost / whole)
            idle = idle + 1 if losses[-1] > best - tolerance else 0
            best = min(best, losses[-1])
            if patience is not None and idle > patience:
                break
        ring.close()
        if ring.first:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ours.shapes) + 1), pa.int32()), pa.array([np.array(p).tobytes() for p in (*ours.params(), losses)], pa.binary())], ["at", "numbers"])

    held = rows.select("_row", "_y", "_w", "_n", *net.columns)
    held = held.repartition(tasks) if learners == 1 else dealt(held, learners, tasks)
    found = dict(held.mapInArrow(learn, "at int, numbers binary", barrier=tasks > 1).collect())  # the network
    shapes = [p.shape for p in net.start(seed)]
    return [np.frombuffer(found[i]).reshape(s) for i, s in enumerate(shapes)], list(np.frombuffer(found[len(shapes)]))


def dealt(rows: DataFrame, learners: int, tasks: int) -> DataFrame:
    """A learner's rows in one task, as many learners in each as in any other."""
    @F.pandas_udf("int")
    def task(number: pd.Series) -> pd.Series:
        return pd.Series((mixed(number.to_numpy()) % np.uint64(learners) % np.uint64(tasks)).astype(np.int32))

    columns = rows.columns
    return rows.withColumn("_task", task("_row")).repartitionById(tasks, "_task").select(*columns)


class Trainable(Estimator):
    """What both estimators share: the label's name and a ``weight`` column, if there is one."""

    label = "label"

    def setLabelCol(self, name: str):  # noqa: N802
        self.label = name
        return self

    def rows(self, df: DataFrame, **columns) -> DataFrame:
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        return written(df.select(F.monotonically_increasing_id().alias("_row"), F.col(self.label).cast("double").alias("_y"), weight.alias("_w"), F.lit(1.0).alias("_n"), *(c.alias(n) for n, c in columns.items())))


class Perceptron(Trainable):
    """One or more hidden layers on the features column."""

    def __init__(self, hidden: Sequence[int] = (200,), epochs: int = 1000, batch: int = 200, rate: float = 1e-3, penalty: float = 1e-4, patience: int = 10, seed: int = 42, tasks: int | None = None):
        super().__init__()
        self.hidden, self.seed = tuple(hidden), seed
        self.how = {"epochs": epochs, "batch": batch, "rate": rate, "penalty": penalty, "patience": patience, "tasks": tasks}

    def _fit(self, df: DataFrame) -> NetworkModel:
        rows = self.rows(df, x=vector_to_array("features"))
        net = Dense([rows.agg(F.max(F.size("x"))).first()[0] or 0, *self.hidden])
        return NetworkModel(net, *trained(rows, net, seed=self.seed, **self.how))


class GraphNetwork(Trainable):
    """Message passing on the graph column (``structures.graphs``); null is one atom 0."""

    def __init__(self, kinds: int = 100, hidden: int = 128, rounds: int = 3, dropout: float = 0.1, epochs: int = 30, batch: int = 128, rate: float = 1e-3, seed: int = 42, tasks: int | None = None):
        super().__init__()
        self.net, self.seed = Graphs(kinds, hidden, rounds, dropout), seed
        self.how = {"epochs": epochs, "batch": batch, "rate": rate, "tasks": tasks}

    def _fit(self, df: DataFrame) -> NetworkModel:
        given, named = self.rows(df, **graph_columns()), self.net.columns
        once = given.groupBy("_y", *named).agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))
        rows = written(once.withColumn("_row", F.xxhash64("_y", *named)))
        return NetworkModel(self.net, *trained(rows, self.net, seed=self.seed, **self.how))


def distinct(lists: Sequence[pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
    """(which distinct row each row is, where each of these is first) of several columns of lists together."""
    cut = [(x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])) for x in lists]
    keys = [tuple(v[e[i] : e[i + 1]].tobytes() for v, e in cut) for i in range(len(lists[0]))]
    first = {}
    back = np.array([first.setdefault(k, (len(first), i))[0] for i, k in enumerate(keys)], np.int64)
    return back, np.array([i for _, i in first.values()], np.int64)


def graph_columns() -> dict:
    none = {"atoms": F.array(F.lit(0))}
    return {c: F.coalesce(F.col(f"graph.{c}"), none.get(c, F.array().cast("array<int>"))) for c in Graphs.columns}


class NetworkModel(Transformer):
    """Adds probability and prediction."""

    def __init__(self, net: Dense | Graphs, params: list[np.ndarray], losses: list[float]):
        super().__init__()
        self.net, self.numbers, self.losses = net, params, losses

    def _transform(self, df: DataFrame) -> DataFrame:
        net, params = self.net, self.numbers

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                table = pa.table({c: pa.array(part[c], pa.list_(pa.int32() if isinstance(net, Graphs) else pa.float64())) for c in net.columns})
                at, back = np.arange(len(part)), slice(None)
                if isinstance(net, Graphs):  # equal graphs are asked once
                    back, at = distinct([table.column(c).combine_chunks() for c in net.columns])
                yield pd.Series(logistic(net.forward(params, net.pick(net.load(table), at, at.astype(np.uint64)))[0])[back])

        given = graph_columns() if isinstance(net, Graphs) else {"x": vector_to_array("features")}
        df = df.withColumn("_p", score(F.struct(*(c.alias(n) for n, c in given.items()))))
        return df.withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")
