import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import chem, models
from tessera.plans import pipelines
from tessera.sources.files import MissingDependency, read_csv, union_sheets, write_csv


@pytest.fixture(scope="module")
def rows(spark):
    bits = F.array(*(((F.col("row_id") * (k + 3) % 7 > 2) | ((F.col("label") == 1) & (F.col("row_id") % 5 > 0) & F.lit(k < 2))).cast("double") for k in range(4)))
    df = spark.range(90).select(F.col("id").cast("int").alias("row_id"), (F.col("id") % 3 == 0).cast("double").alias("label")).withColumn("b", bits)
    return df.select("row_id", "label", array_to_vector("b").alias("features")).cache()


@pytest.mark.parametrize("name", ["LogReg_L2", "AdaBoost", "SVM_RBF", "ExtraTrees"])
def test_models_learn(spark, rows, name):
    model = models.fit(models.registry(3)[name], rows)
    scored = models.score_column(model.transform(rows))
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1.0] > means[0.0]


def test_missing_libraries_are_left_out():
    names = models.available(models.registry())
    assert "LogReg_L2" in names and "XGBoost" not in names


def test_multiview_shapes(spark, rows):
    entries = {"nb": models.registry()["LogReg_L2"]}
    scores = pipelines.multiview_scores(entries, rows.filter("row_id < 60"), rows.filter("row_id >= 60"), {"a": [0, 1], "b": [2, 3]}, [2, 1], folds=2)
    scores = scores.cache()
    by_fold, summary, ci, early = pipelines.evaluate(scores, times=10)
    assert by_fold.count() == 2 * 2 * 3 and summary.count() == 2 * 3
    assert ci.count() == 2 * 3 and early.count() == 2 * 2 * 3 + 2 * 3


def test_structure_models_have_a_regime_of_their_own(spark, rows):
    atoms = F.when(F.col("label") == 1, F.array(F.lit(8), F.lit(6))).otherwise(F.array(F.lit(6), F.lit(6)))
    df = rows.withColumn("graph", F.struct(atoms.alias("atoms"), F.array(F.lit(0), F.lit(1)).alias("heads"), F.array(F.lit(1), F.lit(0)).alias("tails")))
    entries, structure = {"nb": models.registry()["GaussianNB"]}, {"net": models.structure_registry(4)["GraphNetwork"]}
    scores = pipelines.multiview_scores(entries, df.filter("row_id < 60"), df.filter("row_id >= 60"), {"a": [0, 1]}, None, folds=2, structure_entries=structure)
    found = {(r["model"], r["feature_regime"], r["dataset"]): r["count"] for r in scores.groupBy("model", "feature_regime", "dataset").count().collect()}
    sizes = {"cv_holdout": 60, "test": 60, "OOF": 60, "TEST_full_train": 30}
    assert found == {(m, f, d): n for m, f in (("nb", "view:a"), ("nb", "ensemble[a]"), ("net", "smiles")) for d, n in sizes.items()}


def test_stacking_and_voting(spark, rows):
    train, test = rows.filter("row_id < 60"), rows.filter("row_id >= 60")
    entry = models.Entry(lambda d, n: models.C.NaiveBayes(modelType="gaussian"))
    assert models.stack({"nb": entry}, train, test, "row_id").count() == 30
    assert models.knn(train, test, "row_id").filter("score between 0 and 1").count() == 30


def test_fingerprints_go_through_a_provider(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "bad"), (3, None)], "id int, smiles string")

    def factory():
        sizes = dict(chem.FINGERPRINTS)
        return lambda texts: [None if t in ("", "bad") else {n: [1] + [0] * (size - 1) for n, size in sizes.items()} for t in texts]

    made = chem.add_fingerprints(df, "smiles", factory)
    assert [(r["fp_valid"], r["maccs"]) for r in made.orderBy("id").collect()] == [(True, [1, 0, 0]), (False, [0, 0, 0]), (False, [0, 0, 0])]
    assert len(chem.wide(made, ["maccs"]).columns) == 2 + 3 + 167
    with pytest.raises(MissingDependency):
        chem.add_fingerprints(df, "smiles")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "x int, y string")
    assert write_csv(df, f"{tmp_path}/deep/out", single=True) == 2
    assert sorted(tuple(r) for r in read_csv(spark, f"{tmp_path}/deep/out", "x int, y string").collect()) == [(1, "a,b"), (2, None)]
    assert union_sheets([df, df.select("x")]).filter("y is null").count() == 3


@pytest.mark.parametrize("how", ["minmax", "standard"])
def test_features_are_imputed_and_scaled(spark, how):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(41, 4))
    x[:, 2], x[::5, 0], x[:, 3] = 7.0, np.nan, np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>").select("id", array_to_vector("x").alias("features"))
    got = np.array([r["features"].toArray() for r in models.FeatureScaler(how).fit(df).transform(df).orderBy("id").collect()])
    full = np.where(np.isnan(x), [np.nanmedian(x[:, 0]), 0, 0, 0], x)
    want = (full - full.min(0)) / np.where(np.ptp(full, axis=0) > 0, np.ptp(full, axis=0), 1) if how == "minmax" else (full - full.mean(0)) / np.where(full.std(0) > 0, full.std(0), 1)
    assert np.allclose(got, want)


def test_folds_are_scaled_by_their_own_rows(spark, rows):
    model = models.fit(models.registry()["LogReg_L2"], rows, scale="minmax")
    assert models.score_column(model.transform(rows)).filter("score between 0 and 1").count() == 90


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x, y = np.round(r.normal(size=(60, 3)), 1), r.integers(0, 2, 60)
    df = spark.createDataFrame([(i, v.tolist(), float(y[i])) for i, v in enumerate(x)], "id int, x array<double>, label double").select("id", array_to_vector("x").alias("features"), "label").coalesce(1)
    train, test = df.filter("id < 40"), df.filter("id >= 40")
    got = {r["id"]: r["score"] for r in models.score_column(models.fit(models.registry()["KNN"], train).transform(test)).collect()}
    far = ((x[40:, None] - x[None, :40]) ** 2).sum(2)
    for i in range(20):
        order = sorted(range(40), key=lambda j: (far[i, j], -j))[:5]  # ids are given downwards
        assert abs(got[40 + i] - y[order].mean()) < 1e-9
    own = {r["id"]: r["score"] for r in models.knn(df, df, "id").collect()}
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5]
        assert abs(own[i] - y[order].mean()) < 1e-9


def test_stacking_entry(spark, rows):
    model = models.fit(models.Entry(lambda d, n: models.Stacking({"a": models.registry()["LogReg_L2"], "b": models.registry()["GaussianNB"]}, 3)), rows)
    scored = models.score_column(model.transform(rows))
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert scored.count() == 90 and means[1.0] > means[0.0] and {"KNN", "Stacking"} <= models.registry().keys()


def test_models_are_sent_to_tasks_after_an_observed_query(spark, rows):
    from pyspark.sql import Observation

    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    for name in ("LogReg_L2", "RandomForest", "MLP"):
        model = models.fit(models.registry(2)[name], rows)
        assert models.score_column(model.transform(rows)).filter("score between 0 and 1").count() == 90
