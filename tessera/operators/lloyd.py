"""K-means from several starts at once: each round is one scan that updates the centres of all starts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

#: Rows that starting centres are chosen from: a bounded sample by hash. All rows take part in every round.
SAMPLED = 10_000
#: Rows whose distances are held at once.
ROWS = 4096


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn by its squared distance to those already chosen."""
    chosen = [int(rng.integers(len(x)))]
    far = gaps(x, x[chosen])[:, 0]
    while len(chosen) < k:
        total = far.sum()
        chosen.append(int(rng.choice(len(x), p=far / total)) if total > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, gaps(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


class Starts(Estimator):
    """The best of several starts by the sum of squared distances; of equal ones the first.

    Sums are whole numbers of a 2**30th of the largest component, so that the number of tasks changes nothing. A centre without
    rows stays where it is. With fewer rows than k some centres coincide. Null vectors take no part; an empty table gives no centres.
    """

    def __init__(self, k: int, starts: int = 10, rounds: int = 100, tolerance: float = 1e-4, seed: int = 42, column: str = "features", out: str = "cluster"):
        super().__init__()
        self.k, self.starts, self.rounds, self.tolerance, self.seed, self.column, self.out = k, starts, rounds, tolerance, seed, column, out

    def first_centres(self, rows: DataFrame) -> np.ndarray:
        drawn = rows.select("x", F.xxhash64("x", F.monotonically_increasing_id()).alias("_h")).orderBy("_h").limit(SAMPLED).toPandas()
        x = np.stack(drawn["x"].to_numpy())
        return np.stack([spread_out(x, self.k, np.random.default_rng([self.seed, s])) for s in range(self.starts)])

    def scan(self, rows: DataFrame, centres: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, sums and cost of each start's centres, from one pass."""
        starts, k, width = centres.shape

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, cost = np.zeros((starts, k, width + 1), np.int64), np.zeros((starts, k))
            for batch in batches:
                every = matrix(batch, width)
                for i in range(0, len(every), ROWS):
                    x = every[i : i + ROWS]
                    whole = np.hstack([np.ones((len(x), 1), np.int64), np.round(x / unit).astype(np.int64)])
                    for s in range(starts):
                        far = gaps(x, centres[s])
                        own = far.argmin(1)
                        np.add.at(sums[s], own, whole)
                        np.add.at(cost[s], own, far.min(1))
            at = [(s, c) for s in range(starts) for c in range(k) if sums[s, c, 0]]
            yield pa.RecordBatch.from_arrays([pa.array([s * k + c for s, c in at], pa.int32()), pa.array([sums[s, c].tobytes() for s, c in at], pa.binary()), pa.array([cost[s, c] for s, c in at], pa.float64())], ["at", "sums", "cost"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[int, tuple[np.ndarray, float]] = {}
            for batch in batches:
                for at, raw, cost in zip(*(c.to_pylist() for c in batch.columns)):
                    old = met.get(at, (0, 0.0))
                    met[at] = (old[0] + np.frombuffer(raw, np.int64), old[1] + cost)
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.array([v[0].tobytes() for v in met.values()], pa.binary()), pa.array([v[1] for v in met.values()], pa.float64())], ["at", "sums", "cost"])

        schema, sums, cost = "at int, sums binary, cost double", np.zeros((starts * k, width + 1), np.int64), np.zeros(starts * k)
        for r in rows.mapInArrow(task, schema).repartition("at").mapInArrow(merge, schema).collect():  # a row for each centre
            sums[r["at"]], cost[r["at"]] = np.frombuffer(r["sums"], np.int64), r["cost"]
        sums = sums.reshape(starts, k, width + 1)
        return sums[:, :, 0], sums[:, :, 1:] * unit, cost.reshape(starts, k).sum(1)

    def _fit(self, df: DataFrame) -> Centres:
        rows = df.filter(F.col(self.column).isNotNull()).select(vector_to_array(self.column).alias("x"))
        most = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
        if most is None:
            return Centres(np.zeros((0, 0)), 0.0, self.column, self.out)
        centres, unit, scans = self.first_centres(rows), max(most, 1e-300) / 2.0**30, 0
        for scans in range(1, self.rounds + 1):
            counts, sums, cost = self.scan(rows, centres, unit)
            moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres)
            far = ((moved - centres) ** 2).sum(2).max()
            centres = moved
            if far <= self.tolerance**2:
                break
        cost = self.scan(rows, centres, unit)[2]
        best = int(np.argmin(cost))
        model = Centres(centres[best], float(cost[best]), self.column, self.out)
        model.scans, model.costs = scans + 1, cost
        return model


class Centres(Transformer):
    def __init__(self, centres: np.ndarray, cost: float, column: str, out: str):
        super().__init__()
        self.centres, self.cost, self.column, self.out = centres, cost, column, out

    def _transform(self, df: DataFrame) -> DataFrame:
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            known = v.notna().to_numpy()
            out = pd.Series([None] * len(v), dtype="Int32")
            if known.any() and len(centres):
                out[known] = gaps(np.stack(v[known].to_numpy()), centres).argmin(1)
            return out

        return df.withColumn(self.out, nearest(vector_to_array(self.column)))
