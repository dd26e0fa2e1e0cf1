"""Whole stages and registry entries on small tables: shapes, names and what must hold whatever the models say."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import ingest, models
from tessera.plans import pipelines, queries

SHEET = "row_id int, Entry string, Prodrugid string, Prodrug string, SMILES string, PubChem string, `CAS No.` string, inchi string, inchi_k string, other string"


def test_best_row_counts_the_six_identifiers(spark):
    rows = [
        (1, "e", None, None, " CC ", None, None, "i", None, "x"),
        (2, None, None, "name", "CC", None, None, "i", None, "x"),  # Entry doesn't count, Prodrug does
        (3, "e", None, None, "nan", None, None, None, None, "x"),
        (4, "f", None, None, "", None, None, None, None, "x"),
    ]
    sheets = spark.createDataFrame(rows, SHEET)
    prepared, repeated, report = pipelines.prepare_positives(sheets)
    got = {(r["SMILES"], r["Entry"], r["Prodrug"]) for r in prepared.collect()}
    assert got == {("CC", None, "name"), (None, "e", None), (None, "f", None)} and "other" not in prepared.columns
    assert [(r["SMILES"], r["count"]) for r in repeated.collect()] == [("CC", 2)]
    assert report.first().asDict() == {"n_raw": 4, "n_distinct": 4, "n_prepared": 3, "n_with_key": 1, "n_without_key": 2}


def test_positives_without_keys(spark):
    sheets = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "Entry string, inchi string")
    prepared, repeated, report = pipelines.prepare_positives(sheets)
    assert prepared.count() == 2 and repeated is None and report.first()["n_with_key"] == 0
    assert ingest.prepare_positives(sheets).columns == ["Entry", "inchi", "prodrug_label"]


@pytest.fixture(scope="module")
def rows(spark):
    bits = F.array(*((F.hash("id", F.lit(k)) % 2 != 0).cast("double") for k in range(8)))
    source = F.element_at(F.array(*map(F.lit, ["prodrug", "dude", "chembl_random", "chembl_high_conf"])), (F.col("id") % 4 + 1).cast("int"))
    df = spark.range(120).select(F.col("id").alias("row_id"), source.alias("source_dataset"), bits.alias("b"))
    return df.select("row_id", "source_dataset", (F.col("source_dataset") == "prodrug").cast("double").alias("label"), array_to_vector("b").alias("features")).cache()


def test_domain_check(rows):
    by_fold, summary, confusion = pipelines.domain_check(rows, num_trees=3)
    assert by_fold.count() == 5
    said = {r["stat"]: r["alarm"] for r in summary.collect()}
    assert set(said) == {"mean", "std"} and said["std"] is None and said["mean"] is not None
    names = sorted(pipelines.DECOYS)
    assert confusion.columns == ["true_label", *(f"pred_{n}" for n in names)]
    assert {r["true_label"]: sum(r[f"pred_{n}"] for n in names) for r in confusion.collect()} == {f"true_{n}": 30 for n in names}


@pytest.mark.parametrize("name", ["Voting", "DecisionTree", "GaussianNB", "MLP", "Bagging"])
def test_registry_entries_fit_and_score(rows, name):
    entry = models.registry(2)[name]
    scored = models.score_column(models.fit(entry, rows).transform(rows))
    assert scored.filter("score >= 0 AND score <= 1").count() == 120


@pytest.mark.parametrize("name", ["cross_source_stage", "domain_classifier_oof"])
def test_stages_fit_forests_of_all_trees(spark, monkeypatch, name):
    """Before, 20 trees of the 600 that the stages have."""
    asked, entries = [], models.registry

    def few(trees):  # what was asked for is noted, and two trees show that the query ends
        asked.append(models_of(trees))
        return entries(2)

    models_of = lambda t: entries(t)["SourceTrees"].make(64, 100).trees
    monkeypatch.setattr(models, "registry", few)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and asked == [600]
