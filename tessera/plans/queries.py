"""Queries over the driver's tables for every operator of the library, and the same in SQL for another engine.

Stand-ins: documents are molecules (text is the structure, source the data set), labels give label, sign bits of embeddings
are fingerprints (label 0 is the positive source, all others are dealt to three decoys), and (n_chars mod 97) / 97 is a score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.bits import common, ones, sign_bits
from tessera.functions.columns import numeric_features, sigmoid, to_bit, to_number, with_prefix, without_internal
from tessera.operators import hardness, ingest, metrics, models, similarity, split
from tessera.plans import molecules
from tessera.sources.files import read_table

RATIO = 6
#: Trees of the forests in source_confusion and hard_negatives_stage (the stages' own default, which the other stages have, is 600; README).
STAGE_TREES = 20
#: Trees of the boosters' queries (the entries' own default is 800 to 1500; README).
BOOSTED_TREES = 8


def scores(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "source", "lang", F.col("quality").alias("y"), ((F.col("n_chars") % 97) / F.lit(97.0).cast("double")).alias("s"))


def decoy(label) -> Column:
    """0, the positive source, for label 0; all other labels are dealt to sources 1 to 3."""
    return F.when(label == 0, 0).otherwise((label - 1) % 3 + 1)


def prints(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", decoy(F.col("label")).alias("source"), sign_bits(F.col("embedding")).alias("w"), "embedding")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("toxic").alias("label"))


def ef_bedroc_by_source(spark, d):
    return metrics.early_enrichment(scores(spark, d), ["source"])


def roc_auc(spark, d):
    return metrics.roc_auc(scores(spark, d), ["lang"])


def average_precision(spark, d):
    return metrics.average_precision(scores(spark, d), ["lang"])


def threshold_metrics(spark, d):
    return metrics.threshold_metrics(scores(spark, d), ["lang"])


def binary_metrics(spark, d):
    return metrics.binary_metrics(scores(spark, d))


def early_enrichment(spark, d):
    return metrics.early_enrichment(scores(spark, d))


def best_row_dedup(spark, d):
    docs = read_table(spark, d, "documents")
    return ingest.best_row(docs, "text", ["lang", "source", "n_chars"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


def dup_value_counts(spark, d):
    return ingest.value_counts(read_table(spark, d, "documents"), "text").select(F.md5("text").alias("text_md5"), "count")


def _sheets(spark, d):
    """All columns of the positives' table; some identifiers are missing in some rows."""
    given = lambda c, n: F.when(F.col("doc_id") % n > 0, c)
    docs = read_table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("row_id"), F.concat(F.lit("E"), "doc_id").alias("Entry"), given(F.col("n_chars").cast("string"), 3).alias("Prodrugid"), given(F.col("lang"), 4).alias("Prodrug"), F.col("text").alias("SMILES"),
        given(F.col("source"), 5).alias("PubChem"), given(F.col("lang"), 6).alias("CAS No."), F.col("source").alias("inchi"), given(F.md5("text"), 7).alias("inchi_k"), F.lit("x").alias("note"),
    )


def prepare_positives(spark, d):
    return ingest.prepare_positives(_sheets(spark, d)).drop("SMILES", "CAS No.").withColumnRenamed("Entry", "entry")


def positives_report(spark, d):
    return ingest.positives_report(_sheets(spark, d))


def overlap_control(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return ingest.overlap_control(docs, "key", "source", "src0", "doc_id").select("doc_id", "source")


def numeric_coerce(spark, d):
    events = read_table(spark, d, "events")
    raw = F.regexp_replace("props", r'[{}":k]', "")
    return events.select("event_id", to_number(raw).alias("number"), to_bit(raw).alias("bit"), to_number(F.col("props")).alias("not_a_number"))


def class_weights(spark, d):
    rows = read_table(spark, d, "labels").select(F.col("toxic").alias("label"))
    both = models.weigh(rows, "balanced", out="balanced").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("balanced").alias("balanced"))
    return both.join(models.weigh(rows, "positive", out="positive").groupBy("label").agg(F.max("positive").alias("positive")), "label")


def threshold_metrics_raw(spark, d):
    """Scores outside [0, 1]: the threshold is 0, and the Brier score is of the scaled scores."""
    return metrics.threshold_metrics(scores(spark, d).withColumn("s", F.col("s") * 4 - 1), ["lang"])


def sigmoid_scores(spark, d):
    return read_table(spark, d, "events").select("event_id", F.round(sigmoid(F.col("value") / 100), 9).alias("score"))


def view_weights_text(spark, d):
    """Weights of three views for each customer: negative ones and nulls count as 0, and all are equal where none is left."""
    c = read_table(spark, d, "customer")
    w = [F.col("c_acctbal"), (F.col("c_nationkey") - 12) * F.lit(250.0), F.when(F.col("c_nationkey") % 5 > 0, F.col("c_custkey") % 7 * F.lit(100.0))]
    return c.select("c_custkey", metrics.weights_text(metrics.normal_columns(w)).alias("weights"))


def fold_mean_std_rows(spark, d):
    t = split.stratified_folds(scores(spark, d), "y", "id")
    by_fold = metrics.roc_auc(t, ["fold"]).join(metrics.average_precision(t, ["fold"]), "fold")
    return metrics.mean_and_std_rows(by_fold, ["fold", "roc_auc", "ap"])


def kept_columns(spark, d):
    """Columns by prefix, numeric ones but for a list, and none with a leading underscore."""
    li = read_table(spark, d, "lineitem").withColumn("_hidden", F.lit(1))
    names = [*with_prefix(li, "l_q"), *numeric_features(without_internal(li), exclude=["l_discount"])]
    return li.select(*dict.fromkeys(names)).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"))


def quota_allocation(spark, d):
    rows = labelled(spark, d)
    decoys = [f"src{i}" for i in range(1, 6)]
    counts = {r["source"]: r["count"] for r in rows.filter("label = 0").groupBy("source").count().collect()}
    n_pos = rows.filter("label = 1").count()
    got = split.allocate(RATIO * split.test_positives(n_pos, 0.2), {s: counts.get(s, 0) for s in decoys})
    return spark.createDataFrame([(k, v) for k, v in got.items()], "source string, take bigint")


def _quota(spark, d):
    return split.quota_split(labelled(spark, d), "label", "source", ["src1", "src2", "src3"], "doc_id", ratio=RATIO)


def quota_test_split(spark, d):
    return _quota(spark, d)[0].select("doc_id", "source", "label")


def quota_train(spark, d):
    return _quota(spark, d)[1].select("doc_id", "source", "label")


def stratified_folds(spark, d):
    return split.stratified_folds(read_table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label")), "label", "doc_id").select("doc_id", "label", "fold")


def hold_out(spark, d):
    return split.hold_out(labelled(spark, d).filter("label = 1"), 0.2, "doc_id")[1].select("doc_id")


def _near(spark, d):
    p = prints(spark, d)
    return similarity.max_tanimoto(p.filter("source between 1 and 3"), p.filter("source = 0"), "vec_id", "w")


def tanimoto_max_to_pos(spark, d):
    return _near(spark, d).select("vec_id", "max_tanimoto")


def popcounts(spark, d):
    p = prints(spark, d)
    return p.select("vec_id", ones(F.col("w")).alias("bits"), common(F.col("w"), F.col("w")).alias("common_with_self"))


def source_entropy(spark, d):
    return hardness.source_entropy(read_table(spark, d, "documents"), "lang", "source")


def knn5_score(spark, d):
    e = read_table(spark, d, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    e = e.withColumn("q", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint")))
    return similarity.nearest_share(e, e, "vec_id", "q", "y")


def hard_negative_select(spark, d):
    p = prints(spark, d)
    near = similarity.max_tanimoto(p.filter("source > 0"), p.filter("source = 0"), "vec_id", "w")
    rows = near.withColumns({"cluster": F.col("vec_id") % 16, "conf": (F.col("vec_id") % 13) / F.lit(13.0).cast("double")})
    return hardness.select_hard(rows, p.filter("source = 0").count(), [1, 2, 3], "vec_id", "cluster", "source", "max_tanimoto", "conf", ratio=RATIO).select("vec_id", "source", "max_tanimoto")


def view_ensemble(spark, d):
    t = scores(spark, d)
    views = t.select("id", "y", F.lit("a").alias("view"), "s").unionByName(t.select("id", "y", F.lit("b").alias("view"), ((F.col("id") % 31) / F.lit(31.0).cast("double")).alias("s")))
    w = metrics.normal_weights(2, [3, 1])
    return metrics.view_ensemble(views, dict(zip("ab", w, strict=True)), ["id", "y"])


def min_max_scores(spark, d):
    from tessera.functions.columns import min_max

    docs = read_table(spark, d, "documents").withColumn("n", F.col("n_chars").cast("double"))
    return min_max(docs, "n", ["source"], "scaled").select("doc_id", "scaled")


def confusion_matrix(spark, d):
    e = read_table(spark, d, "embeddings").select((F.col("label") % 3).alias("y"), (F.col("vec_id") % 3).cast("int").alias("predicted"))
    return metrics.confusion(e, [0, 1, 2])


def multiclass_metrics(spark, d):
    e = read_table(spark, d, "embeddings").select((F.col("label") % 3).alias("y"), (F.col("vec_id") % 4).cast("int").alias("predicted"))
    return metrics.multiclass_metrics(e)


def macro_auc(spark, d):
    e = read_table(spark, d, "embeddings").select((F.col("label") % 3).alias("y"), F.array(*((F.col("vec_id") * (c + 3) % 17 / F.lit(17.0).cast("double")) for c in range(3))).alias("p"))
    return metrics.bias_alarm(metrics.macro_auc(e, [0, 1, 2], "p").withColumn("accuracy", F.lit(0.5)))


def fold_summary(spark, d):
    t = split.stratified_folds(scores(spark, d), "y", "id")
    by_fold = metrics.roc_auc(t, ["fold"]).join(metrics.average_precision(t, ["fold"]), "fold").withColumn("model", F.lit("m"))
    return metrics.fold_summary(by_fold, ["model"], ["roc_auc", "ap"])


def cross_source_matrix(spark, d):
    """Similarity to source a as a score that tells label 0 from source b."""
    p = prints(spark, d)
    pos, out = p.filter("source = 0"), None
    for a in (1, 2, 3):
        near = similarity.max_tanimoto(p, p.filter(F.col("source") == a), "vec_id", "w", "s")
        for b in (1, 2, 3):
            if a != b:
                part = near.filter(F.col("source").isin(0, b)).select(F.lit(a).alias("train_source"), F.lit(b).alias("test_source"), (F.col("source") == 0).cast("int").alias("y"), "s")
                out = part if out is None else out.unionByName(part)
    return metrics.roc_auc(out, ["train_source", "test_source"])


def bootstrap_blocks_ci(spark, d):
    """Bounds by language, from counts drawn in blocks of scores."""
    return metrics.bootstrap_blocks(scores(spark, d), ["lang"], times=2000)


def bootstrap_ci(spark, d):
    return metrics.bootstrap(scores(spark, d), times=2000)


def rank_rows(spark, d):
    from tessera.functions.running import ranked

    return ranked(scores(spark, d), ["lang"], "s", "id").select("id", "lang", F.col("rank").cast("bigint").alias("rank"))


def lineitem_ranking(spark, d):
    """Volume: areas and enrichment by supplier over all line items, discount as score."""
    li = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("id"), (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_partkey") % 1009 / F.lit(1009.0).cast("double")).alias("s"))
    return metrics.roc_auc(li, ["flag"]).join(metrics.early_enrichment(li, ["flag"]), "flag")


def _features(spark, d):
    e = read_table(spark, d, "embeddings").withColumn("bits", F.transform("embedding", lambda x: (x > 0).cast("double")))
    return e.select("vec_id", decoy(F.col("label")).alias("source"), (F.col("label") == 0).cast("double").alias("label"), array_to_vector("bits").alias("features"))


def logreg_oof(spark, d):
    return _oof(spark, d, "LogReg_L2")


def _oof(spark, d, name):
    rows = split.stratified_folds(_features(spark, d), "label", "vec_id")
    return models.out_of_fold(models.registry()[name], rows, "vec_id").select("vec_id", "label", "fold", "score")


def elastic_net_oof(spark, d):
    return _oof(spark, d, "LogReg_ElasticNet")


def gaussian_nb_oof(spark, d):
    return _oof(spark, d, "GaussianNB")


def decision_tree_oof(spark, d):
    return _oof(spark, d, "DecisionTree")


def _boosted(spark, d, name):
    """Scores of all rows by BOOSTED_TREES trees that haven't seen fold 0."""
    rows = split.stratified_folds(_features(spark, d), "label", "vec_id")
    model = models.fit(models.registry(BOOSTED_TREES)[name], rows.filter("fold > 0"))
    return models.score_column(model.transform(rows)).select("vec_id", "label", "fold", "score")


def level_boosting(spark, d):
    return _boosted(spark, d, "LevelBoosting")


def leaf_boosting(spark, d):
    return _boosted(spark, d, "LeafBoosting")


def ordered_boosting(spark, d):
    return _boosted(spark, d, "OrderedBoosting")


def perceptron_oof(spark, d):
    return _oof(spark, d, "MLP")


def soft_voting(spark, d):
    """The mean of three members' out-of-fold scores."""
    rows = split.stratified_folds(_features(spark, d), "label", "vec_id")
    members = [models.out_of_fold(models.registry()[n], rows, "vec_id") for n in ("LogReg_ElasticNet", "GaussianNB", "DecisionTree")]
    return models.soft_vote(members, "vec_id")


def source_confusion(spark, d):
    from tessera.plans.pipelines import domain_check

    return domain_check(_features(spark, d).withColumn("source", F.concat(F.lit("d"), F.col("source"))), "vec_id", "source", ["d1", "d2", "d3"], num_trees=STAGE_TREES)[2]


def hard_negatives_stage(spark, d):
    """The whole stage: similarity, out-of-fold source confidence, clusters, entropy and hardness of clusters, caps."""
    from tessera.plans.pipelines import hard_negatives

    rows = _features(spark, d).join(prints(spark, d).select("vec_id", "w"), "vec_id").withColumn("source", F.concat(F.lit("d"), F.col("source")))
    return hard_negatives(rows, "vec_id", "w", "source", "d0", ["d1", "d2", "d3"], num_trees=STAGE_TREES).select("vec_id", "source")


def cross_source_stage(spark, d):
    """The whole stage: trees trained against one source's negatives, tested on the others'."""
    from tessera.plans.pipelines import cross_source

    rows = _features(spark, d).withColumn("source", F.concat(F.lit("d"), F.col("source")))
    return cross_source(rows, "vec_id", "label", "source", "d0", ["d1", "d2", "d3"])[1]


def domain_classifier_oof(spark, d):
    from tessera.plans.pipelines import domain_check

    return domain_check(_features(spark, d).withColumn("source", F.concat(F.lit("d"), F.col("source"))), "vec_id", "source", ["d1", "d2", "d3"])[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ef_bedroc_by_source, roc_auc, average_precision, threshold_metrics, binary_metrics, early_enrichment, best_row_dedup, dup_value_counts, prepare_positives, overlap_control, numeric_coerce,
        quota_allocation, quota_test_split, quota_train, stratified_folds, hold_out, tanimoto_max_to_pos, popcounts, source_entropy, knn5_score, hard_negative_select, view_ensemble, min_max_scores,
        confusion_matrix, multiclass_metrics, macro_auc, fold_summary, cross_source_matrix, bootstrap_ci, bootstrap_blocks_ci, rank_rows, lineitem_ranking, logreg_oof, domain_classifier_oof,
        positives_report, class_weights, threshold_metrics_raw, sigmoid_scores, view_weights_text, fold_mean_std_rows, kept_columns, elastic_net_oof, gaussian_nb_oof, decision_tree_oof,
        perceptron_oof, soft_voting, source_confusion, hard_negatives_stage, cross_source_stage, level_boosting, leaf_boosting, ordered_boosting,
    )
}

T = "t AS (SELECT doc_id AS id, source, lang, quality AS y, (n_chars % 97) / CAST(97 AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id))"


def _auc(table: str, key: str) -> str:
    return f"""SELECT {key}, sum(p * (nb + n / CAST(2 AS DOUBLE))) / nullif(CAST(sum(p) * sum(n) AS DOUBLE), 0) AS roc_auc FROM (
      SELECT {key}, p, n, sum(n) OVER (PARTITION BY {key} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS nb FROM (
        SELECT {key}, s, sum(y) AS p, count(*) - sum(y) AS n FROM {table} GROUP BY {key}, s)) GROUP BY {key}"""


def _ap(table: str, key: str) -> str:
    return f"""SELECT {key}, sum(p * (tp / CAST(k AS DOUBLE))) / nullif(CAST(sum(p) AS DOUBLE), 0) AS ap FROM (
      SELECT {key}, p, sum(p) OVER w AS tp, sum(c) OVER w AS k FROM (SELECT {key}, s, sum(y) AS p, count(*) AS c FROM {table} GROUP BY {key}, s)
      WINDOW w AS (PARTITION BY {key} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY {key}"""


def _early(table: str, key: str) -> str:
    parts = [f"""(sum(CASE WHEN rk <= greatest(1, CAST(ceil(n * {f} / CAST(100 AS DOUBLE)) AS BIGINT)) THEN y ELSE 0 END)
      / CAST(max(greatest(1, CAST(ceil(n * {f} / CAST(100 AS DOUBLE)) AS BIGINT))) AS DOUBLE)) / nullif(max(np) / CAST(max(n) AS DOUBLE), 0) AS ef_{f}pct""" for f in (1, 5)]
    for a in (20, 50, 80):
        e = f"exp(-rk * CAST({a} AS DOUBLE) / CAST(n AS DOUBLE))"
        best, worst = f"sum(CASE WHEN rk <= np THEN {e} ELSE 0 END)", f"sum(CASE WHEN rk > n - np THEN {e} ELSE 0 END)"
        parts.append(f"CASE WHEN max(np) = max(n) THEN 1.0 WHEN max(np) > 0 THEN (sum(CASE WHEN y = 1 THEN {e} ELSE 0 END) - {worst}) / ({best} - {worst}) END AS bedroc_{a}")
    return f"""SELECT {key}, {', '.join(parts)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, id) AS rk,
      count(*) OVER (PARTITION BY {key}) AS n, sum(y) OVER (PARTITION BY {key}) AS np FROM {table}) GROUP BY {key}"""


def _threshold(table: str, key: str) -> str:
    return f"""SELECT {key}, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT) AS bal_acc, brier,
      coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) AS mcc FROM (
      SELECT {key}, CAST(count(*) FILTER (s >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (s >= 0.5 AND y = 0) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (s < 0.5 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (s < 0.5 AND y = 0) AS DOUBLE) AS tn, avg((s - y) * (s - y)) AS brier FROM {table} GROUP BY {key})"""


ONE = "u AS (SELECT 1 AS one, * FROM t)"
L = "l AS (SELECT doc_id, source, toxic AS label FROM documents JOIN labels USING (doc_id))"
BITS = "b AS (SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE (label - 1) % 3 + 1 END AS source, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)"
PAIR = "list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: z[1] * z[2]))"
DRAW = "md5(concat('42:', {id}))"


def _near_sql(queries: str, reference: str, extra: str = "") -> str:
    return f"""SELECT vec_id, source{extra}, max(i / CAST(greatest(a + c - i, 1) AS DOUBLE)) AS v FROM (
      SELECT q.vec_id, q.source{extra.replace(', ', ', r.')}, list_sum(q.bits) AS a, list_sum(r.bits) AS c, {PAIR} AS i FROM b q, b r WHERE q.source {queries} AND r.source {reference}) GROUP BY ALL"""


QUOTA = f"""WITH {L}, np AS (SELECT count(*) AS n FROM l WHERE label = 1), k AS (SELECT greatest(1, least(n - 1, CAST(round_even(n * 0.2, 0) AS BIGINT))) AS k FROM np),
  d AS (SELECT unnest([{{}}]) AS source, unnest(range(0, {{}})) AS pos), a AS (SELECT d.source, pos, (SELECT count(*) FROM l WHERE l.source = d.source AND label = 0) AS avail FROM d),
  e AS (SELECT *, least(avail, (6 * k) // {{}} + CASE WHEN pos < (6 * k) % {{}} THEN 1 ELSE 0 END) AS base, 6 * k AS need FROM a, k),
  f AS (SELECT *, need - sum(base) OVER () AS short, coalesce(sum(avail - base) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
  quota AS (SELECT source, base + greatest(0, least(avail - base, short - before)) AS take FROM f)"""


def _quota_sql(names: list[str]) -> str:
    return QUOTA.format(", ".join(f"'{n}'" for n in names), len(names), len(names), len(names))


TEST = f"""{_quota_sql(['src1', 'src2', 'src3'])}, r AS (SELECT *, row_number() OVER (PARTITION BY label, CASE WHEN label = 0 THEN source END ORDER BY {DRAW.format(id='doc_id')}, doc_id) AS rn FROM l),
  test AS (SELECT doc_id, r.source, label FROM r LEFT JOIN quota ON quota.source = r.source, k WHERE (label = 1 AND rn <= k) OR (label = 0 AND rn <= take))"""

BOOT = f"""WITH {T}, p AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS j, count(*) OVER (PARTITION BY y) AS nc FROM t),
  x AS (SELECT b, p.y, CAST(('0x' || substr(md5(b || ':' || p.y || ':' || p.j), 1, 8)) AS BIGINT) % nc AS j FROM p, range(2000) AS g(b)),
  z AS (SELECT b, x.y, p.s FROM x JOIN p ON p.y = x.y AND p.j = x.j), auc AS ({_auc('z', 'b')}), ap AS ({_ap('z', 'b')}), one AS (SELECT 1 AS one, * FROM t),
  pa AS ({_auc('one', 'one')}), pp AS ({_ap('one', 'one')})
  SELECT (SELECT roc_auc FROM pa) AS roc_auc, quantile_cont(roc_auc, 0.025) AS roc_auc_lo, quantile_cont(roc_auc, 0.975) AS roc_auc_hi, (SELECT ap FROM pp) AS ap,
    quantile_cont(ap, 0.025) AS ap_lo, quantile_cont(ap, 0.975) AS ap_hi, avg(roc_auc) AS auc_boot_mean FROM auc JOIN ap USING (b)"""

SHEETS = r"""WITH c AS (SELECT doc_id, CASE WHEN k NOT IN ('', 'nan', 'None') THEN k END AS k, CASE WHEN doc_id % 3 > 0 THEN CAST(n_chars AS VARCHAR) END AS prodrugid, CASE WHEN doc_id % 4 > 0 THEN lang END AS prodrug,
  CASE WHEN doc_id % 5 > 0 THEN source END AS pubchem, CASE WHEN doc_id % 6 > 0 THEN lang END AS cas, source AS inchi, CASE WHEN doc_id % 7 > 0 THEN md5(text) END AS inchi_k
  FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS k FROM documents))"""

ORACLES: dict[str, str] = {
    "ef_bedroc_by_source": f"WITH {T} {_early('t', 'source')}",
    "roc_auc": f"WITH {T} {_auc('t', 'lang')}",
    "average_precision": f"WITH {T} {_ap('t', 'lang')}",
    "threshold_metrics": f"WITH {T} {_threshold('t', 'lang')}",
    "binary_metrics": f"WITH {T}, {ONE}, a AS ({_auc('u', 'one')}), b AS ({_ap('u', 'one')}), c AS ({_threshold('u', 'one')}) SELECT a.* EXCLUDE (one), b.* EXCLUDE (one), c.* EXCLUDE (one) FROM a JOIN b USING (one) JOIN c USING (one)",
    "early_enrichment": f"WITH {T}, {ONE} SELECT * EXCLUDE (one) FROM ({_early('u', 'one')})",
    "best_row_dedup": """SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT DESC, doc_id) AS n
      FROM documents WHERE text IS NOT NULL) WHERE n = 1 UNION ALL SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NULL""",
    "dup_value_counts": "SELECT md5(text) AS text_md5, count FROM (SELECT text, count(*) AS count FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1 ORDER BY count DESC, text LIMIT 20)",
    "prepare_positives": rf"""{SHEETS}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (prodrugid IS NOT NULL)::INT + (prodrug IS NOT NULL)::INT + (pubchem IS NOT NULL)::INT + (cas IS NOT NULL)::INT
      + (inchi IS NOT NULL)::INT + (inchi_k IS NOT NULL)::INT DESC, doc_id) AS n FROM c)
      SELECT 'E' || doc_id AS entry, prodrugid AS "Prodrugid", prodrug AS "Prodrug", pubchem AS "PubChem", inchi, inchi_k, 1 AS prodrug_label FROM r WHERE n = 1 OR k IS NULL""",
    "positives_report": rf"""{SHEETS} SELECT (SELECT count(*) FROM documents) AS n_raw, (SELECT count(DISTINCT doc_id) FROM documents) AS n_distinct,
      count(DISTINCT k) + count(*) FILTER (k IS NULL) AS n_prepared, count(DISTINCT k) AS n_with_key, count(*) FILTER (k IS NULL) AS n_without_key FROM c""",
    "class_weights": """SELECT toxic AS label, count(*) AS n, (SELECT count(*) FROM labels WHERE toxic IS NOT NULL) / (CAST(2 AS DOUBLE) * count(*)) AS balanced,
      CASE WHEN toxic = 1 THEN (SELECT count(*) FROM labels WHERE toxic = 0) / CAST(count(*) AS DOUBLE) ELSE 1.0 END AS positive FROM labels GROUP BY toxic""",
    "threshold_metrics_raw": f"""WITH {T}, r AS (SELECT lang, y, s * 4 - 1 AS s FROM t), m AS (SELECT lang, min(s) AS lo, max(s) AS hi FROM r GROUP BY lang),
      h AS ({_threshold("(SELECT lang, y, s + CAST(0.5 AS DOUBLE) AS s FROM r)", "lang")}), b AS (SELECT lang, avg(((s - lo) / (hi - lo) - y) * ((s - lo) / (hi - lo) - y)) AS brier FROM r JOIN m USING (lang) GROUP BY lang)
      SELECT h.* EXCLUDE (brier), b.brier FROM h JOIN b USING (lang)""",
    "sigmoid_scores": "SELECT event_id, round(1 / (1 + exp(-(value / 100))), 9) AS score FROM events",
    "view_weights_text": """WITH w AS (SELECT c_custkey, greatest(c_acctbal, 0) AS a, greatest((c_nationkey - 12) * CAST(250 AS DOUBLE), 0) AS b, CASE WHEN c_nationkey % 5 > 0 THEN c_custkey % 7 * CAST(100 AS DOUBLE) ELSE 0 END AS c FROM customer)
      SELECT c_custkey, CASE WHEN a + b + c > 0 THEN printf('%.4f,%.4f,%.4f', a / (a + b + c), b / (a + b + c), c / (a + b + c)) ELSE '0.3333,0.3333,0.3333' END AS weights FROM w""",
    "fold_mean_std_rows": f"""WITH {T}, f AS (SELECT *, (row_number() OVER (ORDER BY y, {DRAW.format(id='id')}, id) - 1) % 5 AS fold FROM t), a AS ({_auc('f', 'fold')}), b AS ({_ap('f', 'fold')}), j AS (SELECT * FROM a JOIN b USING (fold))
      SELECT 'mean' AS stat, avg(fold) AS fold, avg(roc_auc) AS roc_auc, avg(ap) AS ap FROM j UNION ALL SELECT 'std', stddev_samp(fold), stddev_samp(roc_auc), stddev_samp(ap) FROM j""",
    "kept_columns": "SELECT l_linenumber, count(*) AS n, sum(l_quantity) AS quantity, max(l_extendedprice) AS price FROM lineitem GROUP BY l_linenumber",
    "overlap_control": """WITH d AS (SELECT doc_id, source, md5(text) AS key, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents)
      SELECT doc_id, source FROM d WHERE key IS NULL OR (n = 1 AND (source = 'src0' OR key NOT IN (SELECT key FROM d WHERE source = 'src0' AND key IS NOT NULL)))""",
    "numeric_coerce": r"""SELECT event_id, CAST(k AS DOUBLE) AS number, CASE WHEN k > 0.5 THEN 1 ELSE 0 END AS bit, CAST(NULL AS DOUBLE) AS not_a_number FROM (SELECT event_id, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k FROM events)""",
    "quota_allocation": f"{_quota_sql([f'src{i}' for i in range(1, 6)])} SELECT source, CAST(take AS BIGINT) AS take FROM quota",
    "quota_test_split": f"{TEST} SELECT doc_id, source, label FROM test",
    "quota_train": f"{TEST} SELECT doc_id, source, label FROM l WHERE doc_id NOT IN (SELECT doc_id FROM test)",
    "stratified_folds": f"SELECT doc_id, toxic AS label, CAST((row_number() OVER (ORDER BY toxic, {DRAW.format(id='doc_id')}, doc_id) - 1) % 5 AS INT) AS fold FROM labels",
    "hold_out": f"WITH {L} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {DRAW.format(id='doc_id')}, doc_id) AS n, count(*) OVER () AS c FROM l WHERE label = 1) WHERE n <= ceil(c * 0.2)",
    "tanimoto_max_to_pos": f"WITH {BITS} SELECT vec_id, v AS max_tanimoto FROM ({_near_sql('BETWEEN 1 AND 3', '= 0')})",
    "popcounts": f"WITH {BITS} SELECT vec_id, CAST(list_sum(bits) AS INT) AS bits, CAST(list_sum(bits) AS INT) AS common_with_self FROM b",
    "source_entropy": "SELECT lang, CAST(sum(c) AS BIGINT) AS n, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy FROM (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL) GROUP BY lang",
    "knn5_score": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings),
      n AS (SELECT q.vec_id, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), r.vec_id) AS k FROM e q, e r WHERE q.vec_id <> r.vec_id)
      SELECT vec_id, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS score FROM n WHERE k <= 5 GROUP BY vec_id""",
    "hard_negative_select": f"""WITH {BITS}, m AS (SELECT vec_id, source, v, vec_id % 16 AS cluster, (vec_id % 13) / CAST(13 AS DOUBLE) AS conf FROM ({_near_sql('BETWEEN 1 AND 3', '= 0')})),
      c AS (SELECT cluster, source, count(*) AS c FROM m GROUP BY ALL), e AS (SELECT cluster, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS ent FROM c GROUP BY cluster),
      g AS (SELECT cluster FROM e JOIN (SELECT cluster, avg(v) AS mean FROM m GROUP BY cluster) USING (cluster) WHERE ent >= 0.8 AND mean >= 0.3),
      r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (CAST(1 AS DOUBLE) - v) + conf, vec_id) AS n FROM m WHERE v BETWEEN CAST(0.25 AS DOUBLE) AND CAST(0.9 AS DOUBLE) AND conf <= CAST(0.8 AS DOUBLE) AND cluster IN (SELECT cluster FROM g))
      SELECT vec_id, source, v AS max_tanimoto FROM r WHERE n <= greatest(1, CAST(ceil(6 * (SELECT count(*) FROM b WHERE source = 0)) AS BIGINT) // 3)""",
    "view_ensemble": f"WITH {T} SELECT id, y, (CAST(0.75 AS DOUBLE) * s + CAST(0.25 AS DOUBLE) * ((id % 31) / CAST(31 AS DOUBLE))) / CAST(1 AS DOUBLE) AS s FROM t",
    "min_max_scores": "SELECT doc_id, CASE WHEN hi > lo THEN (n_chars - lo) / CAST(hi - lo AS DOUBLE) WHEN n_chars IS NOT NULL THEN 0.0 END AS scaled FROM documents JOIN (SELECT source, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY source) USING (source)",
    "confusion_matrix": "SELECT CAST(c AS VARCHAR) AS true_label, " + ", ".join(f"(SELECT count(*) FROM embeddings WHERE label % 3 = c AND vec_id % 3 = {p}) AS pred_{p}" for p in range(3)) + " FROM range(3) AS g(c)",
    "multiclass_metrics": """WITH e AS (SELECT label % 3 AS y, vec_id % 4 AS p FROM embeddings), k AS (SELECT DISTINCT y AS c FROM e UNION SELECT DISTINCT p FROM e),
      x AS (SELECT c, (SELECT count(*) FROM e WHERE y = c) AS t, (SELECT count(*) FROM e WHERE p = c) AS s, (SELECT count(*) FROM e WHERE y = c AND p = c) AS h FROM k)
      SELECT sum(h) / CAST(sum(t) AS DOUBLE) AS accuracy, avg(h / nullif(CAST(t AS DOUBLE), 0)) AS balanced_accuracy, avg(2 * h / nullif(CAST(t + s AS DOUBLE), 0)) AS macro_f1 FROM x""",
    "macro_auc": f"""WITH e AS (SELECT c, CASE WHEN label % 3 = c THEN 1 ELSE 0 END AS y, (vec_id * (c + 3) % 17) / CAST(17 AS DOUBLE) AS s FROM embeddings, range(3) AS g(c))
      SELECT avg(roc_auc) AS macro_auc_ovr, CAST(0.5 AS DOUBLE) AS accuracy, avg(roc_auc) >= 0.8 AS alarm FROM ({_auc('e', 'c')})""",
    "fold_summary": f"""WITH {T}, f AS (SELECT *, (row_number() OVER (ORDER BY y, {DRAW.format(id='id')}, id) - 1) % 5 AS fold FROM t), a AS ({_auc('f', 'fold')}), b AS ({_ap('f', 'fold')})
      SELECT 'm' AS model, avg(roc_auc) AS roc_auc_mean, stddev_samp(roc_auc) AS roc_auc_std, avg(ap) AS ap_mean, stddev_samp(ap) AS ap_std FROM a JOIN b USING (fold)""",
    "cross_source_matrix": f"""WITH {BITS}, m AS (SELECT q.vec_id, q.source, r.source AS train_source, max({PAIR} / CAST(greatest(list_sum(q.bits) + list_sum(r.bits) - {PAIR}, 1) AS DOUBLE)) AS s
      FROM b q, b r WHERE r.source BETWEEN 1 AND 3 GROUP BY ALL),
      x AS (SELECT train_source, t AS test_source, train_source * 10 + t AS key, CASE WHEN source = 0 THEN 1 ELSE 0 END AS y, s FROM m, range(1, 4) AS g(t) WHERE t <> train_source AND source IN (0, t))
      SELECT CAST(key // 10 AS INT) AS train_source, CAST(key % 10 AS INT) AS test_source, roc_auc FROM ({_auc('x', 'key')})""",
    "bootstrap_ci": BOOT,
    "rank_rows": f"WITH {T} SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, id) AS rank FROM t",
    "lineitem_ranking": f"""WITH t AS (SELECT l_returnflag AS flag, (l_orderkey * 8 + l_linenumber) * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS id, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, (l_partkey % 1009) / CAST(1009 AS DOUBLE) AS s FROM lineitem),
      a AS ({_auc('t', 'flag')}), b AS ({_early('t', 'flag')}) SELECT * FROM a JOIN b USING (flag)""",
}

QUERIES |= molecules.QUERIES
ORACLES |= molecules.ORACLES
