"""A kernel machine with radial basis functions: a Nystroem map to landmarks, a linear machine in its space, and a calibration on
held-out folds. With as many landmarks as different rows it is the exact machine; with fewer, an approximation of rank ``landmarks``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tessera.operators.lloyd import Starts, gaps


#: The hinge is rounded over this width below 1, from wide to narrow, so that Newton's steps meet a curve.
WIDTHS = (3.0, 1.0, 0.3, 0.1, 0.03, 0.01)
#: Shares of a step that are tried in one scan.
SHARES = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001)


def rounded(z: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rounded hinge of z = y * margin: loss, slope and curvature."""
    inside, below = (z < 1) & (z > 1 - width), z <= 1 - width
    loss = np.where(inside, (1 - z) ** 2 / (2 * width), np.where(below, 1 - z - width / 2, 0.0))
    return loss, np.where(inside, (z - 1) / width, np.where(below, -1.0, 0.0)), inside / width


def hinge_lines(rows: DataFrame, size: int, folds: int, cost: float) -> np.ndarray:
    """Weights and intercept of a linear machine for each fold, learned from the other folds, and last of one for all rows.

    rows has x (size numbers), _y, _w and _fold. Newton steps on the rounded hinge: a scan adds up slopes and curvatures of all machines,
    another finds how far each may step. A machine whose rows are of one class is the one of all rows.
    """
    def scan(look) -> np.ndarray:
        """The sums, over all rows, of look(x with a 1, signs, weights) for each machine."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[int, np.ndarray] = {}
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                f, y, w, fold = np.hstack([x, np.ones((len(x), 1))]), *(batch.column(c).to_numpy() for c in ("_y", "_w", "_fold"))
                for j in range(folds + 1):
                    own = fold != j
                    found = look(j, f[own], np.where(y[own] > 0, 1.0, -1.0), w[own])
                    met[j] = met[j] + found if j in met else found
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.array([v.tobytes() for v in met.values()], pa.binary())], ["at", "sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[int, np.ndarray] = {}
            for batch in batches:
                for j, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    own = np.frombuffer(raw)
                    met[j] = met[j] + own if j in met else own
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.array([v.tobytes() for v in met.values()], pa.binary())], ["at", "sums"])

        found = rows.mapInArrow(task, "at int, sums binary").repartition("at").mapInArrow(merge, "at int, sums binary").collect()
        return np.stack([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["at"])])

    weights = scan(lambda j, f, s, w: np.array([w[s > 0].sum(), w[s < 0].sum()]))
    total = weights.sum(1)
    line, penalty = np.zeros((folds + 1, size + 1)), 1 / (cost * total)
    for width in WIDTHS:
        for _ in range(8):
            def slopes(j, f, s, w, line=line, width=width):
                _, g, h = rounded(s * (f @ line[j]), width)
                return np.concatenate([((w * s * g) @ f), (f.T @ (f * (w * h)[:, None])).ravel()])

            found, steps = scan(slopes) / total[:, None], np.zeros_like(line)
            for j in range(folds + 1):
                ridge = np.full(size + 1, penalty[j])
                ridge[-1] = 1e-9  # the intercept bears no penalty
                slope = found[j, : size + 1] + ridge * line[j]
                steps[j] = -np.linalg.solve(found[j, size + 1 :].reshape(size + 1, size + 1) + np.diag(ridge), slope)

            def tried(j, f, s, w, line=line, steps=steps, width=width):
                return np.array([(w * rounded(s * (f @ (line[j] + a * steps[j])), width)[0]).sum() for a in (0.0, *SHARES)])

            lost = scan(tried) / total[:, None]
            for j in range(folds + 1):
                lost[j] += [penalty[j] / 2 * ((line[j] + a * steps[j])[:-1] ** 2).sum() for a in (0.0, *SHARES)]
            best = lost.argmin(1)
            line = line + np.array([0.0, *SHARES])[best][:, None] * steps
            if (lost[:, 0] - lost.min(1) <= 1e-6 * np.maximum(lost[:, 0], 1e-12)).all():
                break
    alone = weights.min(1) <= 0
    line[alone] = line[-1]
    return line


class NystroemMap(Transformer):
    """features to mapped: inner products of mapped rows are the kernel's, as far as the landmarks span them."""

    def __init__(self, landmarks: np.ndarray, gamma: float):
        super().__init__()
        self.landmarks, self.gamma = landmarks, gamma
        values, vectors = np.linalg.eigh(np.exp(-gamma * gaps(landmarks, landmarks)))
        kept = values > 1e-10 * max(values.max(initial=0), 1e-300)
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def _transform(self, df: DataFrame) -> DataFrame:
        landmarks, gamma, root = self.landmarks, self.gamma, self.root

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, landmarks.shape[1]))
            return pd.Series(list(np.exp(-gamma * gaps(x, landmarks)) @ root))

        return df.withColumn("_mapped", array_to_vector(project(vector_to_array("features"))))


class KernelMachine(Estimator):
    """Hinge loss with penalty ``cost`` (each row's by its weight), gamma 1 / (features * variance), probabilities by a logistic fit of
    the margins that models of the other folds give.

    Landmarks are the centres of k-means, so they follow the rows; ``landmarks`` bounds what is broadcast. Weights come from a column
    weight, if there is one. With a single class the share of label 1 is the probability of every row.
    """

    def __init__(self, landmarks: int = 256, cost: float = 1.0, folds: int = 5, seed: int = 42):
        super().__init__()
        self.landmarks, self.cost, self.folds, self.seed, self.label = landmarks, cost, folds, seed, "label"

    def setLabelCol(self, name: str) -> KernelMachine:  # noqa: N802
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> Machine:
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        rows = df.select("features", F.col(self.label).cast("double").alias("_y"), weight.alias("_w"))
        n, share, moments = rows.agg(F.count("_y"), F.avg("_y"), Summarizer.metrics("mean", "variance").summary(F.col("features"))).first()
        if not n or share in (0.0, 1.0):
            return Machine(None, None, (0.0, 0.0), share or 0.0)
        mean, d = moments["mean"].toArray(), moments["mean"].size
        variance = float(moments["variance"].toArray().mean() * (n - 1) / n + ((mean - mean.mean()) ** 2).mean())  # over all numbers
        distinct = rows.select("features").distinct().limit(self.landmarks + 1).collect()
        if len(distinct) <= self.landmarks:  # all rows fit: the exact machine
            found = np.array(sorted(r[0].toArray().tolist() for r in distinct))
        else:
            found = Starts(self.landmarks, 1, rounds=10, seed=self.seed).fit(rows).centres
        mapping = NystroemMap(found, 1 / (d * variance) if variance > 0 else 1.0)
        # A draw for each row that says which fold it is in; labels are dealt evenly on average.
        mapped = mapping.transform(rows).withColumn("_fold", F.pmod(F.xxhash64("features", "_y", F.monotonically_increasing_id(), F.lit(self.seed)), F.lit(self.folds))).select("_mapped", "_y", "_w", "_fold").cache()
        try:
            lines = hinge_lines(mapped.select(vector_to_array("_mapped").alias("x"), "_y", "_w", "_fold"), mapping.root.shape[1], self.folds, self.cost)
            # Each row's margin by the model that hasn't learned from its fold; where that had one class only, by the model of all rows.
            @F.pandas_udf("double")
            def held_out(v: pd.Series, fold: pd.Series) -> pd.Series:
                x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, lines.shape[1] - 1))
                return pd.Series((x * lines[fold.to_numpy(), :-1]).sum(1) + lines[fold.to_numpy(), -1])

            held = mapped.select("_y", array_to_vector(F.array(held_out(vector_to_array("_mapped"), F.col("_fold")))).alias("_m"))
            said = C.LogisticRegression(featuresCol="_m", labelCol="_y", maxIter=50, regParam=1e-6, standardization=False).fit(held)
            return Machine(mapping, (lines[-1, :-1], lines[-1, -1]), (float(said.coefficients[0]), float(said.intercept)), share)
        finally:
            mapped.unpersist()


class Machine(Transformer):
    """Margins of the linear machine over the map, and probabilities of them."""

    def __init__(self, mapping: NystroemMap | None, linear: tuple | None, line: tuple[float, float], share: float):
        super().__init__()
        self.mapping, self.linear, self.line, self.share = mapping, linear, line, share

    def margins(self, x: np.ndarray) -> np.ndarray:
        m = self.mapping
        return np.exp(-m.gamma * gaps(x, m.landmarks)) @ (m.root @ self.linear[0]) + self.linear[1]

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.mapping is None:
            p, raw = F.lit(float(self.share)), F.lit(0.0)
        else:
            margins, (slope, shift) = Machine(self.mapping, self.linear, self.line, self.share).margins, self.line

            @F.pandas_udf("double")
            def margin(v: pd.Series) -> pd.Series:
                return pd.Series(margins(np.stack(v.to_numpy())) if len(v) else [], dtype=float)

            df = df.withColumn("_margin", margin(vector_to_array("features")))
            raw = F.col("_margin")
            p = 1 / (1 + F.exp(-(raw * slope + shift)))
        df = df.withColumn("_p", p)
        return df.withColumns({"rawPrediction": array_to_vector(F.array(-raw, raw)), "probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p", "_margin")
