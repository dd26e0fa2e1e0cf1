"""Models for fingerprint views: a registry of pyspark.ml estimators, folds, ensembles, and the few that need a loop.

Features are a vector column; a view is a set of positions in it. Optional libraries are probed, never pretended: an entry
whose library is missing is left out of the registry with a reason.
"""

from __future__ import annotations

import importlib.util
import logging
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml import classification as C
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.columns import sigmoid
from tessera.operators import boosting, kernel, networks, randomtrees
from tessera.operators.lloyd import Starts
from tessera.operators.similarity import nearest_share
from tessera.operators.split import stratified_folds
from tessera.sources.shared import shared_dir, written

log = logging.getLogger(__name__)
SEED = 42


@dataclass(frozen=True)
class Entry:
    """How to build an estimator (of feature count and row count) and which rows weigh how much: '', 'balanced' or 'positive'."""

    make: Callable[[int, int], Estimator]
    weights: str = ""
    needs: str = ""


def _trees(n: int, **more) -> Callable[[int, int], Estimator]:
    return lambda d, rows: C.RandomForestClassifier(numTrees=n, maxDepth=30, seed=SEED, **more)


def registry(num_trees: int | None = None) -> dict[str, Entry]:
    """Name to entry. num_trees replaces every forest's size, for quick runs.

    Penalties: C = 1 of n weighted rows is regParam 1 / n.
    """
    t = lambda n: num_trees or n
    linear = lambda net: lambda d, rows: C.LogisticRegression(regParam=1 / max(1, rows), elasticNetParam=net, maxIter=2000, standardization=False)
    return {
        "LogReg_L2": Entry(linear(0.0), "balanced"),
        "LogReg_ElasticNet": Entry(linear(0.5), "balanced"),
        "SVM_RBF": Entry(lambda d, rows: kernel.KernelMachine(), "balanced"),
        "GaussianNB": Entry(lambda d, rows: C.NaiveBayes(modelType="gaussian")),
        "DecisionTree": Entry(lambda d, rows: C.DecisionTreeClassifier(maxDepth=30, seed=SEED), "balanced"),
        "RandomForest": Entry(_trees(t(400)), "balanced"),
        "ExtraTrees": Entry(lambda d, rows: randomtrees.ExtraTrees(t(100), min_split=7), "balanced"),
        "SourceTrees": Entry(lambda d, rows: randomtrees.ExtraTrees(t(600))),
        "GradientBoosting": Entry(lambda d, rows: C.GBTClassifier(maxIter=t(100), maxDepth=3, stepSize=0.1, seed=SEED), "positive"),
        "AdaBoost": Entry(lambda d, rows: AdaBoost(rounds=t(50)), "positive"),
        "Bagging": Entry(_trees(t(300), featureSubsetStrategy="all")),
        "Voting": Entry(lambda d, rows: Voting(voters(num_trees))),
        "KNN": Entry(lambda d, rows: Neighbours()),
        "Stacking": Entry(lambda d, rows: Stacking(voters(num_trees))),
        "MLP": Entry(lambda d, rows: networks.Perceptron()),
        "LevelBoosting": Entry(lambda d, rows: boosting.level_wise(t(800)), "positive"),
        "LeafBoosting": Entry(lambda d, rows: boosting.leaf_wise(t(1200)), "positive"),
        "OrderedBoosting": Entry(lambda d, rows: boosting.ordered(t(1500)), "positive"),
        "XGBoost": Entry(lambda d, rows: importlib.import_module("xgboost.spark").SparkXGBClassifier(n_estimators=800, max_depth=6, learning_rate=0.03, subsample=0.8), "positive", "xgboost"),
        "LightGBM": Entry(lambda d, rows: importlib.import_module("synapse.ml.lightgbm").LightGBMClassifier(numIterations=1200, numLeaves=64), "positive", "synapse"),
        "CatBoost": Entry(lambda d, rows: importlib.import_module("catboost_spark").CatBoostClassifier(iterations=1500, depth=6), "positive", "catboost_spark"),
    }


def structure_registry(epochs: int = 30) -> dict[str, Entry]:
    """Models of a graph column (``structures.graphs``) in place of features."""
    return {"GraphNetwork": Entry(lambda d, rows: networks.GraphNetwork(epochs=epochs), "positive")}


def voters(num_trees: int | None = None) -> dict[str, Entry]:
    """The members of voting and stacking."""
    return {"RandomForest": Entry(_trees(num_trees or 300), "balanced"), **{n: registry(num_trees)[n] for n in ("SVM_RBF", "LogReg_ElasticNet")}}


def available(entries: dict[str, Entry]) -> dict[str, Entry]:
    """Entries whose libraries are installed; the others are named in a warning."""
    found = {n: e for n, e in entries.items() if not e.needs or importlib.util.find_spec(e.needs)}
    for n in entries.keys() - found.keys():
        log.warning("%s left out: %s is not installed", n, entries[n].needs)
    return found


def weigh(df: DataFrame, how: str, label: str = "label", out: str = "weight") -> DataFrame:
    """balanced: n / (classes * class size). positive: negatives / positives for label 1, else 1."""
    if not how:
        return df.withColumn(out, F.lit(1.0))
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # a row for each class
    n, w = sum(counts.values()), F.lit(1.0)
    for value, c in counts.items():
        x = n / (len(counts) * c) if how == "balanced" else (counts.get(0, 0) / max(c, 1) if value == 1 else 1.0)
        w = F.when(F.col(label) == value, float(x)).otherwise(w)
    return df.withColumn(out, w)


def score_column(df: DataFrame) -> DataFrame:
    """score: the probability of class 1, else the decision value, else the prediction."""
    if "probability" in df.columns:
        return df.withColumn("score", vector_to_array("probability")[1])
    if "rawPrediction" in df.columns:
        raw = vector_to_array("rawPrediction")
        return df.withColumn("score", raw[F.size(raw) - 1])
    return df.withColumn("score", F.col("prediction").cast("double"))


class FeatureScaler(Estimator):
    """Median imputation of NaN, then scaling of each feature: minmax to [0, 1], or standard to mean 0 and deviation 1. A constant
    feature becomes 0, as does one that is NaN throughout.

    Medians are exact: their state holds a feature's distinct values. With ``exact=False`` they are Spark's approximate ones, whose
    state is bounded.
    """

    def __init__(self, how: str = "minmax", exact: bool = True):
        super().__init__()
        self.how, self.exact = how, exact

    def _fit(self, df: DataFrame) -> ScaledFeatures:
        x = F.when(~F.isnan("x"), F.col("x"))
        half = F.percentile(x, F.lit(0.5)) if self.exact else F.percentile_approx(x, 0.5, 100_000)
        each = df.select(F.posexplode(vector_to_array("features")).alias("i", "x")).groupBy("i")
        found = each.agg(half.alias("median"), F.min(x).alias("least"), F.max(x).alias("most"), F.count(x).alias("n"), F.count(F.lit(1)).alias("all"), F.avg(x).alias("mean"), F.var_pop(x).alias("spread")).collect()
        rows = sorted(found, key=lambda r: r["i"])  # a row for each feature
        column = lambda name: np.array([r[name] if r[name] is not None else 0.0 for r in rows], np.float64)
        median, least, most, n, every, mean, spread = map(column, ("median", "least", "most", "n", "all", "mean", "spread"))
        if self.how == "minmax":
            return ScaledFeatures(median, least, most - least)
        share = n / np.maximum(every, 1)  # the others are the median after imputation
        whole = share * mean + (1 - share) * median
        variance = share * (spread + (mean - whole) ** 2) + (1 - share) * (median - whole) ** 2
        return ScaledFeatures(median, whole, np.sqrt(np.maximum(variance, 0)))


class ScaledFeatures(Transformer):
    def __init__(self, median: np.ndarray, shift: np.ndarray, width: np.ndarray):
        super().__init__()
        self.median, self.shift, self.width = median, shift, width

    def _transform(self, df: DataFrame) -> DataFrame:
        median, shift, width = self.median, self.shift, np.where(self.width > 0, self.width, np.inf)

        @F.pandas_udf("array<double>")
        def scale(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, len(median)))
            return pd.Series(list((np.where(np.isnan(x), median, x) - shift) / width))

        return df.withColumn("features", array_to_vector(scale(vector_to_array("features"))))


def view(df: DataFrame, positions: Sequence[int] | None, column: str = "features") -> DataFrame:
    if positions is None:
        return df
    return VectorSlicer(inputCol=column, outputCol="_view", indices=list(positions)).transform(df).drop(column).withColumnRenamed("_view", column)


def fit(entry: Entry, train: DataFrame, label: str = "label", scale: str | None = None) -> Model:
    """The entry's model on features and label; rows weighed as it says, if it can. With scale (minmax, standard) features are imputed
    and scaled by what these rows say, and the model does the same to what it is asked."""
    if scale:
        scaler = FeatureScaler(scale).fit(train)
        return Chain([scaler, fit(entry, scaler.transform(train), label)])
    weighed = weigh(train, entry.weights, label).cache()
    try:
        width = F.max(F.size(vector_to_array("features"))) if "features" in train.columns else F.lit(0)
        size = weighed.agg(F.count(F.lit(1)), width).first()
        est = entry.make(size[1] or 0, size[0])
        est.setLabelCol(label) if hasattr(est, "setLabelCol") else None
        if entry.weights and est.hasParam("weightCol"):
            est.set(est.getParam("weightCol"), "weight")
        return without_summary(est.fit(weighed))
    finally:
        weighed.unpersist()


def without_summary(model: Model) -> Model:
    """The model, written and read again if it has a training summary. A summary holds the session, and once a session has observed a
    query it can't be sent to tasks: scoring would fail, depending on what else ran before."""
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{shared_dir(SparkSession.getActiveSession())}/tessera-model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


def out_of_fold(entry: Entry, df: DataFrame, row_id: str, label: str = "label", fold: str = "fold", folds: int = 5, classes: int = 2) -> DataFrame:
    """row_id, label, fold, probabilities, score, prediction of each row by the model that hasn't seen its fold."""
    out = None
    for k in range(folds):
        model = fit(entry, df.filter(F.col(fold) != k), label)
        part = score_column(model.transform(df.filter(F.col(fold) == k)))
        p = vector_to_array("probability") if "probability" in part.columns else F.array(F.lit(1.0) - F.col("score"), F.col("score"))
        part = part.select(row_id, label, fold, F.slice(p, 1, classes).alias("probabilities"), "score", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def soft_vote(parts: Sequence[DataFrame], row_id: str) -> DataFrame:
    """row_id, score: the mean of the members' scores."""
    rows = parts[0].select(row_id, "score")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(row_id, "score"))
    return rows.groupBy(row_id).agg(F.avg("score").alias("score"))


def stack(members: dict[str, Entry], train: DataFrame, test: DataFrame, row_id: str, label: str = "label") -> DataFrame:
    """row_id, score of test: a logistic regression over the members' out-of-fold scores and the features themselves."""
    train = train if "fold" in train.columns else stratified_folds(train, label, row_id)
    met, asked = train, test
    for name, entry in members.items():
        met = met.join(out_of_fold(entry, train, row_id, label).select(row_id, F.col("score").alias(f"_{name}")), row_id)
        asked = asked.join(score_column(fit(entry, train, label).transform(test)).select(row_id, F.col("score").alias(f"_{name}")), row_id)
    join = VectorAssembler(inputCols=[*(f"_{n}" for n in members), "features"], outputCol="_all")
    wide = lambda df: join.transform(df).drop("features").withColumnRenamed("_all", "features")
    last = fit(Entry(lambda d, rows: C.LogisticRegression(regParam=1 / max(1, rows), maxIter=2000, standardization=False), "balanced"), wide(met), label)
    return score_column(last.transform(wide(asked))).select(row_id, "score")


def knn(train: DataFrame, test: DataFrame, row_id: str, label: str = "label", k: int = 5) -> DataFrame:
    """row_id, score: the share of label 1 among the k nearest training rows."""
    rows = lambda df: df.withColumn("_v", vector_to_array("features"))
    return nearest_share(rows(test), rows(train), row_id, "_v", label, k)


class Boosted(Transformer):
    """Stumps with votes."""

    def __init__(self, parts: list[tuple[float, Model]]):
        super().__init__()
        self.parts = parts

    def _transform(self, df: DataFrame) -> DataFrame:
        vote, all_votes = F.lit(0.0), math.fsum(a for a, _ in self.parts) or 1.0
        for i, (a, m) in enumerate(self.parts):
            df = m.transform(df).drop("rawPrediction", "probability").withColumnRenamed("prediction", f"_p{i}")
            vote = vote + F.lit(a) * (F.lit(2.0) * F.col(f"_p{i}") - 1)
        p = sigmoid(F.lit(2.0) * vote / F.lit(all_votes))
        df = df.withColumn("_p", p).withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")})
        return df.drop("_p", *(f"_p{i}" for i in range(len(self.parts))))


class Voted(Transformer):
    """The mean of the members' probabilities of class 1."""

    def __init__(self, parts: Sequence[Model]):
        super().__init__()
        self.parts = list(parts)

    def _transform(self, df: DataFrame) -> DataFrame:
        for i, part in enumerate(self.parts):
            df = score_column(part.transform(df)).withColumnRenamed("score", f"_s{i}").drop("probability", "rawPrediction", "prediction")
        p = sum((F.col(f"_s{i}") for i in range(len(self.parts))), F.lit(0.0)) / len(self.parts)
        df = df.withColumn("_p", p).withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")})
        return df.drop("_p", *(f"_s{i}" for i in range(len(self.parts))))


class Voting(Estimator):
    """Soft voting: each member is fitted with its own weights."""

    def __init__(self, members: dict[str, Entry]):
        super().__init__()
        self.members, self.label = members, "label"

    def setLabelCol(self, name: str) -> Voting:  # noqa: N802
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> Voted:
        rows = df.drop("weight")
        return Voted([fit(entry, rows, self.label) for entry in self.members.values()])


class Neighbours(Estimator):
    """Nearest neighbours: the share of label 1 among the k nearest training rows."""

    def __init__(self, k: int = 5):
        super().__init__()
        self.k, self.label = k, "label"

    def setLabelCol(self, name: str) -> Neighbours:  # noqa: N802
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> NearestRows:
        rows = df.select((-1 - F.monotonically_increasing_id()).alias("_asked"), vector_to_array("features").alias("_v"), F.col(self.label).alias("_y"))
        return NearestRows(written(rows), self.k)


class NearestRows(Transformer):
    def __init__(self, rows: DataFrame, k: int):
        super().__init__()
        self.rows, self.k = rows, k

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = written(df.withColumn("_asked", F.monotonically_increasing_id()))
        near = nearest_share(asked.select("_asked", vector_to_array("features").alias("_v")), self.rows, "_asked", "_v", "_y", self.k).withColumnRenamed("score", "_p")
        p = F.coalesce("_p", F.lit(0.0))
        return asked.join(near, "_asked", "left").withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")}).drop("_asked", "_p")


class Stacking(Estimator):
    """A logistic regression over the members' out-of-fold scores and the features themselves; the members are fitted on all rows."""

    def __init__(self, members: dict[str, Entry], folds: int = 5):
        super().__init__()
        self.members, self.folds, self.label = members, folds, "label"

    def setLabelCol(self, name: str) -> Stacking:  # noqa: N802
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> Stacked:
        rows = written(df.select(F.monotonically_increasing_id().alias("_row"), "features", self.label))
        met = stratified_folds(rows, self.label, "_row", self.folds)
        train = written(met)
        for i, entry in enumerate(self.members.values()):
            met = met.join(out_of_fold(entry, train, "_row", self.label, folds=self.folds).select("_row", F.col("score").alias(f"_s{i}")), "_row")
        last = fit(Entry(lambda d, n: C.LogisticRegression(regParam=1 / max(1, n), maxIter=2000, standardization=False), "balanced"), joined_scores(met, len(self.members)), self.label)
        return Stacked([fit(entry, rows, self.label) for entry in self.members.values()], last)


def joined_scores(df: DataFrame, n: int) -> DataFrame:
    """features: the scores _s0, _s1, ... before the features."""
    scores = F.array(*(F.col(f"_s{i}") for i in range(n)))
    return df.withColumn("features", array_to_vector(F.concat(scores, vector_to_array("features")))).drop(*(f"_s{i}" for i in range(n)))


class Stacked(Transformer):
    def __init__(self, parts: Sequence[Model], last: Model):
        super().__init__()
        self.parts, self.last = list(parts), last

    def _transform(self, df: DataFrame) -> DataFrame:
        for i, part in enumerate(self.parts):
            df = score_column(part.transform(df)).withColumnRenamed("score", f"_s{i}").drop("probability", "rawPrediction", "prediction")
        kept = df.withColumn("_features", F.col("features"))
        return self.last.transform(joined_scores(kept, len(self.parts))).drop("features").withColumnRenamed("_features", "features")


class AdaBoost(Estimator):
    """Discrete boosting of stumps: rows that a stump gets wrong weigh more for the next."""

    def __init__(self, rounds: int = 50):
        super().__init__()
        self.rounds, self.label = rounds, "label"

    def setLabelCol(self, name: str) -> AdaBoost:  # noqa: N802
        self.label = name
        return self

    def _fit(self, df: DataFrame) -> Boosted:
        rows = df.withColumn("_w", F.col("weight") if "weight" in df.columns else F.lit(1.0)).select("features", self.label, "_w").cache()
        parts: list[tuple[float, Model]] = []
        for _ in range(self.rounds):
            stump = C.DecisionTreeClassifier(maxDepth=1, labelCol=self.label, weightCol="_w", seed=SEED).fit(rows)
            said = stump.transform(rows).withColumn("_bad", (F.col("prediction") != F.col(self.label)).cast("double"))
            bad, total = said.agg(F.sum(F.col("_w") * F.col("_bad")), F.sum("_w")).first()
            error = bad / total if total else 1.0
            if error >= 0.5:
                break
            parts.append((math.log((1 - error) / max(error, 1e-10)), stump))
            if error <= 1e-10:
                break
            new = said.select("features", self.label, (F.col("_w") * F.exp(F.lit(parts[-1][0]) * F.col("_bad"))).alias("_w")).cache()
            new.count()
            rows.unpersist()
            rows = new
        rows.unpersist()
        return Boosted(parts)


class Chain(Transformer):
    def __init__(self, stages: list[Transformer]):
        super().__init__()
        self.stages = stages

    def _transform(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.transform(df)
        return df


def clusters(df: DataFrame, k: int = 16, starts: int = 10, most_axes: int = 50, out: str = "_cluster") -> DataFrame:
    """Principal axes, then the best of several k-means starts, which move together."""
    size = df.select(F.max(F.size(vector_to_array("features")))).first()[0]
    low = PCA(k=min(most_axes, size), inputCol="features", outputCol="_axes").fit(df).transform(df)
    low = written(low)
    return Starts(k, starts, seed=SEED, column="_axes", out=out).fit(low).transform(low).drop("_axes")
