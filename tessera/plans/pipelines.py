"""Composite stages: from raw positives to evaluation tables. Each takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tessera.functions.columns import clean_key, require, require_rows
from tessera.operators import chem, hardness, ingest, metrics, models, similarity, split, structures
from tessera.sources.shared import written

#: Default names of the positive source and of the negatives' sources.
POSITIVE = "prodrug"
DECOYS = ("dude", "chembl_random", "chembl_high_conf")
SCORE_KEYS = ("model", "feature_regime", "dataset", "split")


def prepare_positives(sheets: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(positives, repeated keys before any de-duplication if there are keys, counts)."""
    repeated = ingest.value_counts(sheets.withColumn("SMILES", clean_key(F.col("SMILES"))), "SMILES") if "SMILES" in sheets.columns else None
    return ingest.prepare_positives(sheets), repeated, ingest.positives_report(sheets)


def overlap(df: DataFrame, key: str = "inchikey", source: str = "source_dataset", positive: str = POSITIVE, row_id: str = "row_id") -> DataFrame:
    return ingest.overlap_control(df.withColumn("_block", ingest.connectivity(F.col(key))), "_block", source, positive, row_id).drop("_block")


def fingerprints(df: DataFrame, structure: str = "smiles", factory=None) -> DataFrame:
    """Adds fp_valid, circular and keys by this library's own parser, or a provider's bits where a factory is given."""
    return chem.add_fingerprints(df, structure, factory) if factory else structures.add_fingerprints(df, structure)


def isolate_test(df: DataFrame, label: str = "label", domain: str = "source_dataset", decoys: Sequence[str] = DECOYS, row_id: str = "row_id", **more) -> tuple[DataFrame, DataFrame, dict]:
    return split.quota_split(df, label, domain, decoys, row_id, **more)


def hard_negatives(df: DataFrame, row_id: str = "row_id", words: str = "avalon", source: str = "source_dataset", positive: str = POSITIVE, decoys: Sequence[str] = DECOYS, num_trees: int = 600, ratio: float = 6.0, k: int = 16, **limits) -> DataFrame:
    """All positives and the selected negatives; df has packed words and a features vector."""
    require(df, [row_id, words, source, "features"], 8)
    pos, neg = require_rows(df.filter(F.col(source) == positive), "positives"), require_rows(df.filter(F.col(source).isin(*decoys)), "negatives")
    neg = similarity.max_tanimoto(neg, pos, row_id, words, "_max_tani_pos")
    neg = source_confidence(neg, row_id, source, decoys, num_trees).join(neg, row_id)
    neg = models.clusters(neg, k)
    chosen = hardness.select_hard(neg, pos.count(), decoys, row_id, "_cluster", source, "_max_tani_pos", "_domain_conf", ratio, **limits)
    return pos.unionByName(chosen.select(*pos.columns))


def source_confidence(neg: DataFrame, row_id: str, source: str, decoys: Sequence[str], num_trees: int) -> DataFrame:
    """row_id, _domain_conf: the largest out-of-fold probability of a source. The classes are given, so that a fold may lack one."""
    return domain_scores(neg, row_id, source, decoys, num_trees).select(row_id, F.array_max("probabilities").alias("_domain_conf"))


def domain_scores(neg: DataFrame, row_id: str, source: str, decoys: Sequence[str], num_trees: int) -> DataFrame:
    number = F.array_position(F.array(*(F.lit(d) for d in sorted(decoys))), F.col(source)) - 1
    rows = split.stratified_folds(neg.withColumn("_class", number.cast("double")).select(row_id, "features", "_class"), "_class", row_id)
    return models.out_of_fold(models.registry(num_trees)["SourceTrees"], rows, row_id, "_class", classes=len(decoys))


def domain_check(df: DataFrame, row_id: str = "row_id", source: str = "source_dataset", decoys: Sequence[str] = DECOYS, num_trees: int = 600) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics by fold, mean and standard deviation with alarm, confusion matrix) of telling negative sources apart."""
    classes = [float(i) for i in range(len(decoys))]
    scored = domain_scores(require_rows(df.filter(F.col(source).isin(*decoys)), "negatives"), row_id, source, decoys, num_trees).withColumnRenamed("prediction", "predicted").withColumnRenamed("_class", "y")
    by_fold = metrics.multiclass_metrics(scored, ["fold"]).join(metrics.macro_auc(scored, classes, "probabilities", ["fold"]), "fold")
    summary = metrics.mean_and_std_rows(by_fold, ["fold", "accuracy", "balanced_accuracy", "macro_f1", "macro_auc_ovr"])
    alarmed = metrics.bias_alarm(summary).withColumn("alarm", F.when(F.col("stat") == "mean", F.col("alarm")))
    named = F.element_at(F.array(*map(F.lit, sorted(decoys))), (F.col("predicted") + 1).cast("int"))
    counts = metrics.confusion(scored.join(df.select(row_id, F.col(source).alias("_source")), row_id).select(F.col("_source").alias("y"), named.alias("predicted")), sorted(decoys))
    return by_fold, alarmed, counts.withColumn("true_label", F.concat(F.lit("true_"), "true_label"))


def cross_source(df: DataFrame, row_id: str = "row_id", label: str = "label", source: str = "source_dataset", positive: str = POSITIVE, decoys: Sequence[str] = DECOYS, test_share: float = 0.2, num_trees: int = 600) -> tuple[DataFrame, DataFrame]:
    """(metrics, means) of models trained with the negatives of one source: on its own folds, and on each other source's negatives."""
    entry = models.Entry(models.registry(num_trees)["SourceTrees"].make, "balanced")
    pos_train, pos_test = split.hold_out(require_rows(df.filter(F.col(source) == positive), "positives"), test_share, row_id)
    neg = {d: require_rows(df.filter(F.col(source) == d), d) for d in decoys}
    scores = None
    for trained in decoys:
        train = split.stratified_folds(pos_train.unionByName(neg[trained]), label, row_id)
        own = models.out_of_fold(entry, train, row_id, label).select(F.lit(trained).alias("test_neg_source"), F.lit("cv_holdout").alias("dataset"), F.col("fold").alias("split"), F.col(label).alias("y"), F.col("score").alias("s"))
        full = models.fit(entry, train, label)
        for d in decoys:
            if d != trained:
                said = models.score_column(full.transform(pos_test.unionByName(neg[d])))
                own = own.unionByName(said.select(F.lit(d).alias("test_neg_source"), F.lit("external_test").alias("dataset"), F.lit(-1).alias("split"), F.col(label).alias("y"), F.col("score").alias("s")))
        own = own.withColumn("train_neg_source", F.lit(trained))
        scores = own if scores is None else scores.unionByName(own)
    keys = ["train_neg_source", "test_neg_source", "dataset", "split"]
    found = metrics.roc_auc(scores, keys).join(metrics.average_precision(scores, keys), keys)
    return found, found.groupBy(*keys[:3]).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("ap").alias("ap"))


def multiview_scores(entries: dict[str, models.Entry], train: DataFrame, test: DataFrame, views: dict[str, Sequence[int] | None], weights: Sequence[float] | None, row_id: str = "row_id", label: str = "label", folds: int = 5, scale: str | None = "minmax", structure_entries: dict[str, models.Entry] | None = None) -> DataFrame:
    """model, feature_regime, dataset, split, row_id, y, s of every model on every view and of the views' weighted mean.

    Datasets: cv_holdout and test for each fold, OOF, and TEST_full_train by a model of all training rows (split -1).
    Features are imputed and scaled by each model's own training rows. structure_entries are models of the graph column, of regime
    smiles; they take no part in views. The scores are written, so that what reads them fits nothing anew.
    """
    w = dict(zip(views, metrics.normal_weights(len(views), weights), strict=True))
    train, out = written(split.stratified_folds(train, label, row_id, folds)), None
    fits = [(name, entry, v, positions, scale) for name, entry in entries.items() for v, positions in views.items()]
    fits += [(name, entry, None, None, None) for name, entry in (structure_entries or {}).items()]
    for name, entry, v, positions, scaling in fits:
        fit_rows, ask_rows = models.view(train, positions), models.view(test, positions)
        for k in [*range(folds), -1]:
            model = models.fit(entry, fit_rows.filter(F.col("fold") != k), label, scaling)
            asked = {"test" if k >= 0 else "TEST_full_train": ask_rows} | ({"cv_holdout": fit_rows.filter(F.col("fold") == k)} if k >= 0 else {})
            for dataset, rows in asked.items():
                said = models.score_column(model.transform(rows))
                part = said.select(F.lit(name).alias("model"), F.lit(v).cast("string").alias("view"), F.lit(dataset).alias("dataset"), F.lit(k).alias("split"), F.col(row_id).alias("row_id"), F.col(label).alias("y"), F.col("score").alias("s"))
                out = part if out is None else out.unionByName(part)
    out = written(out)
    held = out.filter("dataset = 'cv_holdout'")
    out = out.unionByName(held.withColumns({"dataset": F.lit("OOF"), "split": F.lit(-1)}))
    keys = ["model", "dataset", "split", "row_id", "y"]
    together = metrics.view_ensemble(out, w, keys).withColumn("feature_regime", F.lit("ensemble[" + "+".join(views) + "]"))
    return out.withColumn("feature_regime", F.coalesce(F.concat(F.lit("view:"), "view"), F.lit("smiles"))).drop("view").unionByName(together)


def evaluate(scores: DataFrame, times: int = 2000, level: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(metrics by fold, summary, confidence intervals, early enrichment) of multiview_scores(), each one plan over all models."""
    by_fold = metrics.binary_metrics(scores.filter(F.col("dataset").isin("cv_holdout", "test")), SCORE_KEYS)
    values = [c for c in by_fold.columns if c not in SCORE_KEYS]
    summary = metrics.fold_summary(by_fold, SCORE_KEYS[:3], values)
    whole = scores.filter(F.col("dataset").isin("OOF", "TEST_full_train"))
    ci = metrics.bootstrap_blocks(whole, SCORE_KEYS[:3], times=times, level=level)
    return by_fold, summary, ci, metrics.early_enrichment(scores, SCORE_KEYS, "row_id")


def feature_vector(df: DataFrame, bits: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(bits, lambda b: b.cast("double"))))
