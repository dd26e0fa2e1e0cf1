"""Ranking, threshold and multi-class metrics over long tables of scores, each group on its own.

A score table has y (0 or 1), s (double) and a row id; groups name its key columns. Null scores are left out. Sums run in
two levels (``functions.running``). What is undefined (one class only, say) is null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.running import ranked, running_sums
from tessera.sources.shared import written

#: Source-bias alarm.
ALARM_ACCURACY, ALARM_AUC = 0.70, 0.80


def ratio(a, b) -> Column:
    """a / b in double precision; null where b is 0."""
    return F.try_divide(F.col(a).cast("double") if isinstance(a, str) else a.cast("double"), F.nullif(F.col(b).cast("double") if isinstance(b, str) else b.cast("double"), F.lit(0.0)))


def _by_score(scores: DataFrame, groups: Sequence[str], y: str, s: str) -> DataFrame:
    return scores.filter(F.col(s).isNotNull() & ~F.isnan(s)).groupBy(*groups, s).agg(F.sum(F.col(y).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("k"))


def roc_auc(scores: DataFrame, groups: Sequence[str] = (), y: str = "y", s: str = "s", out: str = "roc_auc") -> DataFrame:
    """Area under the ROC curve, ties count half: rank sums over distinct scores."""
    g = running_sums(_by_score(scores, groups, y, s).withColumn("n", F.col("k") - F.col("p")), groups, s, {"nb": "n"})
    won = F.sum(F.col("p") * (F.col("nb") - F.col("n") / F.lit(2).cast("double")))
    return g.groupBy(*groups).agg(ratio(won, F.sum("p") * F.sum("n")).alias(out))


def average_precision(scores: DataFrame, groups: Sequence[str] = (), y: str = "y", s: str = "s", out: str = "ap") -> DataFrame:
    """Sum of (recall step) * precision over distinct scores, highest first."""
    g = running_sums(_by_score(scores, groups, y, s), groups, s, {"tp": "p", "seen": "k"}, descending=True)
    return g.groupBy(*groups).agg(ratio(F.sum(F.col("p") * ratio("tp", "seen")), F.sum("p")).alias(out))


def threshold_metrics(scores: DataFrame, groups: Sequence[str] = (), y: str = "y", s: str = "s") -> DataFrame:
    """f1, precision, recall, bal_acc, brier, mcc. The threshold is 0.5 if all scores are in [0, 1], else 0; the Brier score is of
    the scores scaled to [0, 1] then. One aggregate of moments, no second pass."""
    rows = scores.filter(F.col(s).isNotNull() & ~F.isnan(s)).select(*groups, F.col(y).cast("double").alias("y"), F.col(s).cast("double").alias("s"))
    count = lambda c: F.sum(c.cast("int").cast("bigint"))
    parts = {}
    for name, at in (("half", 0.5), ("zero", 0.0)):
        hit = F.col("s") >= at
        parts |= {f"tp_{name}": count(hit & (F.col("y") == 1)), f"fp_{name}": count(hit & (F.col("y") == 0)), f"fn_{name}": count(~hit & (F.col("y") == 1)), f"tn_{name}": count(~hit & (F.col("y") == 0))}
    m = rows.groupBy(*groups).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.avg("s").alias("ms"), F.avg(F.col("s") * F.col("y")).alias("msy"), F.avg(F.col("s") * F.col("s")).alias("mss"), F.avg((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("raw"), *(c.alias(k) for k, c in parts.items()))
    inside = (F.col("lo") >= 0) & (F.col("hi") <= 1)
    m = m.withColumns({k: F.when(inside, F.col(f"{k}_half")).otherwise(F.col(f"{k}_zero")).cast("double") for k in ("tp", "fp", "fn", "tn")})
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    # Mean of ((s - lo) / width - y) squared from the moments; a constant score is scaled to 0.
    scaled = (F.col("mss") - 2 * F.col("lo") * F.col("ms") + F.col("lo") * F.col("lo")) / (width * width) - 2 * (F.col("msy") - F.col("lo") * F.col("my")) / width + F.col("my")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recalls = [ratio(tp, tp + fn), ratio(tn, tn + fp)]
    present = sum((r.isNotNull().cast("int") for r in recalls), F.lit(0))
    margin = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return m.select(
        *groups,
        zero(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        zero(ratio(tp, tp + fp)).alias("precision"),
        zero(ratio(tp, tp + fn)).alias("recall"),
        ratio(sum((zero(r) for r in recalls), F.lit(0.0)), present).alias("bal_acc"),
        F.when(inside, F.col("raw")).otherwise(F.coalesce(scaled, F.col("my"))).alias("brier"),
        zero(ratio(tp * tn - fp * fn, margin)).alias("mcc"),
    )


def _with_totals(scores: DataFrame, groups: Sequence[str], y: str, s: str, row_id: str) -> DataFrame:
    r = ranked(scores.filter(F.col(s).isNotNull()), groups, s, row_id, "rk")
    totals = scores.filter(F.col(s).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("np"))
    return r.join(F.broadcast(totals), list(groups)) if groups else r.join(F.broadcast(totals))  # a row for each group: a group isn't one task


def early_enrichment(scores: DataFrame, groups: Sequence[str] = (), row_id: str = "id", y: str = "y", s: str = "s", fractions: Sequence[int] = (1, 5), alphas: Sequence[int] = (20, 50, 80)) -> DataFrame:
    """ef_{f}pct and bedroc_{alpha}: hits among the first f percent against chance, and exponentially weighted early ranks."""
    r = _with_totals(scores, groups, y, s, row_id)
    sums: list[Column] = []
    for f in fractions:
        top = F.greatest(F.lit(1), F.ceil(F.col("n") * f / F.lit(100).cast("double")))
        sums += [F.sum(F.when(F.col("rk") <= top, F.col(y)).otherwise(0)).alias(f"hits_{f}"), F.max(top).alias(f"top_{f}")]
    for a in alphas:
        weight = F.exp(-F.col("rk") * float(a) / F.col("n").cast("double"))
        for name, chosen in (("got", F.col(y) == 1), ("best", F.col("rk") <= F.col("np")), ("worst", F.col("rk") > F.col("n") - F.col("np"))):
            sums.append(F.sum(F.when(chosen, weight).otherwise(0.0)).alias(f"{name}_{a}"))
    t = r.groupBy(*groups).agg(F.max("n").alias("n"), F.max("np").alias("np"), *sums)
    ef = {f"ef_{f}pct": ratio(ratio(f"hits_{f}", f"top_{f}"), ratio("np", "n")) for f in fractions}
    wide = {f"bedroc_{a}": F.when(F.col("np") == F.col("n"), 1.0).when((F.col("np") > 0) & (F.col(f"best_{a}") > F.col(f"worst_{a}")), (F.col(f"got_{a}") - F.col(f"worst_{a}")) / (F.col(f"best_{a}") - F.col(f"worst_{a}"))) for a in alphas}
    return t.select(*groups, *(c.alias(k) for k, c in (ef | wide).items()))


def binary_metrics(scores: DataFrame, groups: Sequence[str] = (), y: str = "y", s: str = "s") -> DataFrame:
    """All eight metrics in one row for each group."""
    parts = [roc_auc(scores, groups, y, s), average_precision(scores, groups, y, s), threshold_metrics(scores, groups, y, s)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(groups)) if groups else out.join(F.broadcast(p))  # one row each
    return out


def confusion(df: DataFrame, classes: Sequence, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """true_label and pred_{c} counts, a row and a column for each class even if it never occurs."""
    spark = df.sparkSession
    found = df.groupBy(F.col(y).cast("string").alias("true_label")).pivot(predicted, list(classes)).count()
    rows = spark.createDataFrame([(str(c),) for c in classes], "true_label string")
    joined = rows.join(found, "true_label", "left")
    return joined.select("true_label", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in classes))


def multiclass_metrics(df: DataFrame, groups: Sequence[str] = (), y: str = "y", predicted: str = "predicted") -> DataFrame:
    """accuracy, balanced_accuracy (mean recall of true classes), macro_f1 (over classes true or predicted)."""
    pairs = df.groupBy(*groups, y, predicted).agg(F.count(F.lit(1)).alias("c"))
    each = F.explode(F.array(F.struct(F.col(y).alias("cls"), F.col("c").alias("true"), F.lit(0).cast("bigint").alias("said")), F.struct(F.col(predicted).alias("cls"), F.lit(0).cast("bigint").alias("true"), F.col("c").alias("said"))))
    margins = pairs.select(*groups, each.alias("e")).select(*groups, "e.*").groupBy(*groups, "cls").agg(F.sum("true").alias("true"), F.sum("said").alias("said"))
    hits = pairs.filter(F.col(y) == F.col(predicted)).select(*groups, F.col(y).alias("cls"), F.col("c").alias("hit"))
    per = margins.join(hits, [*groups, "cls"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return per.groupBy(*groups).agg(ratio(F.sum("hit"), F.sum("true")).alias("accuracy"), F.avg(ratio("hit", "true")).alias("balanced_accuracy"), F.avg(ratio(2 * F.col("hit"), F.col("true") + F.col("said"))).alias("macro_f1"))


def macro_auc(df: DataFrame, classes: Sequence, probabilities: str, groups: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Mean of one-against-rest areas over classes; probabilities is an array in the order of classes."""
    rows = df.select(*groups, F.col(y).alias("_y"), F.posexplode(probabilities).alias("_c", "s"))
    names = F.array(*(F.lit(c) for c in classes))
    rows = rows.withColumn("y", (F.col("_y") == F.get(names, F.col("_c"))).cast("int"))
    return roc_auc(rows, [*groups, "_c"]).groupBy(*groups).agg(F.avg("roc_auc").alias("macro_auc_ovr"))


def bias_alarm(summary: DataFrame, accuracy: str = "accuracy", auc: str = "macro_auc_ovr") -> DataFrame:
    """Adds alarm: negative sources can be told apart too well."""
    return summary.withColumn("alarm", (F.col(accuracy) >= ALARM_ACCURACY) | F.coalesce(F.col(auc) >= ALARM_AUC, F.lit(False)))


def fold_summary(metrics: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """{value}_mean and {value}_std (of a sample) over folds; only numbers are summed up."""
    return metrics.groupBy(*keys).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def mean_and_std_rows(metrics: DataFrame, values: Sequence[str]) -> DataFrame:
    """stat (mean, std) and the values: two rows."""
    one = metrics.agg(*(F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).alias(v) for v in values))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), *(F.col(v)[k].alias(v) for v in values)) for k in ("mean", "std")))).alias("r")).select("r.*")


def bootstrap(scores: DataFrame, groups: Sequence[str] = (), row_id: str = "id", y: str = "y", s: str = "s", times: int = 2000, level: float = 0.95, batch: int = 50) -> DataFrame:
    """roc_auc and ap with bounds over times resamples, drawn with replacement from each class.

    Draw i of a class in resample b is row hash(b, class, i) modulo the class's size, so that draws need no state and each
    resample is a join. Resamples are numbered through and run as one plan; a group of one class has equal bounds.
    """
    rows = scores.filter(F.col(s).isNotNull()).select(*groups, F.col(row_id).alias("_id"), F.col(y).cast("int").alias("y"), F.col(s).alias("s"))
    keyed = rows.withColumn("_h", F.conv(F.substring(F.md5(F.col("_id").cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32).withColumn("_one", F.lit(1))
    placed = running_sums(keyed, [*groups, "y"], "_h", {"j": "_one"}, ties=["_id"]).withColumn("j", F.col("j") - 1).select(*groups, "y", "s", "j")
    sizes = rows.groupBy(*groups, "y").agg(F.count(F.lit(1)).alias("nc"))
    numbered = placed.join(sizes, [*groups, "y"]).select(*groups, "y", "nc", F.col("j").alias("i"))
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, since these rows are few and small before they are draws
    draws = numbered.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit((times - 1) // batch)))).repartition(parts, *groups, "y", "c", F.floor(F.col("i") / 1024))
    draws = draws.withColumn("b", F.explode(F.sequence(F.col("c") * batch, F.least(F.lit(times), (F.col("c") + 1) * batch) - 1)))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "b", "y", "i")), 1, 8), 16, 10).cast("bigint") % F.col("nc")
    sample = draws.select(*groups, "b", "y", drawn.alias("j")).join(placed, [*groups, "y", "j"])
    counts = sample.groupBy(*groups, "b", "y", "s").agg(F.count(F.lit(1)).alias("c"))
    table = counts.groupBy(*groups, "b", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("p"), F.sum("c").alias("k")).withColumn("n", F.col("k") - F.col("p"))
    table = written(table)  # both sums read it: all draws would be made again for each
    up = running_sums(table, [*groups, "b"], "s", {"nb": "n"}).groupBy(*groups, "b").agg(ratio(F.sum(F.col("p") * (F.col("nb") - F.col("n") / F.lit(2).cast("double"))), F.sum("p") * F.sum("n")).alias("auc"))
    down = running_sums(table, [*groups, "b"], "s", {"tp": "p", "seen": "k"}, descending=True).groupBy(*groups, "b").agg(ratio(F.sum(F.col("p") * ratio("tp", "seen")), F.sum("p")).alias("pr"))
    return _with_bounds(rows, groups, up.join(down, [*groups, "b"]), level)


def _with_bounds(rows: DataFrame, groups: Sequence[str], resampled: DataFrame, level: float) -> DataFrame:
    """Both areas of rows (y, s), and the bounds of resampled's auc and pr."""
    tail = (1 - level) / 2
    ends = F.array(F.lit(tail), F.lit(1 - tail))
    spread = resampled.groupBy(*groups).agg(F.avg("auc").alias("auc_boot_mean"), F.percentile("auc", ends).alias("a"), F.percentile("pr", ends).alias("p"))
    point = roc_auc(rows, groups).join(average_precision(rows, groups), list(groups)) if groups else roc_auc(rows).join(F.broadcast(average_precision(rows)))
    both = point.join(spread, list(groups)) if groups else point.join(F.broadcast(spread))
    return both.select(*groups, "roc_auc", F.col("a")[0].alias("roc_auc_lo"), F.col("a")[1].alias("roc_auc_hi"), "ap", F.col("p")[0].alias("ap_lo"), F.col("p")[1].alias("ap_hi"), "auc_boot_mean")


#: Least distinct scores of a block, most blocks of a group, and numbers that a task draws at once.
BLOCK_SCORES, MOST_BLOCKS, DRAWN = 20_000, 1024, 4_000_000


def drawn_before(sizes: np.ndarray, block: int, times: int, keys: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows drawn from earlier blocks, rows drawn from this block) for each resample of as many rows as there are.

    A multinomial draw, split down a tree of halves: each node's generator is keyed, so all blocks see the same draws.
    """
    lo, hi = 0, len(sizes)
    before, here = np.zeros(times, np.int64), np.full(times, sizes.sum(), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, whole = sizes[lo:mid].sum(), sizes[lo:hi].sum()
        went = np.random.default_rng([*keys, lo, hi]).binomial(here, left / whole if whole else 0.0)
        if block < mid:
            here, hi = went, mid
        else:
            before, here, lo = before + went, here - went, mid
    return before, here


def bootstrap_blocks(scores: DataFrame, groups: Sequence[str] = (), y: str = "y", s: str = "s", times: int = 2000, level: float = 0.95, seed: int = 42, block_scores: int = BLOCK_SCORES) -> DataFrame:
    """The same columns as bootstrap(), from resamples of the same law that are drawn as counts.

    Rows are counted once for each distinct score; these are dealt in order into blocks (MOST_BLOCKS a group, at most). How many rows
    of a class a resample takes from each block follows from the blocks' sizes alone, so a task draws its block's counts for all
    resamples and adds up its share of both areas. What is shuffled is the rows' counts, and a row for each block and resample.
    """
    rows = scores.filter(F.col(s).isNotNull() & ~F.isnan(s)).select(*groups, F.col(y).cast("int").alias("y"), F.col(s).cast("double").alias("s"))
    counted = _by_score(rows, groups, "y", "s").withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_sums(counted, groups, "s", {"_place": "_one"})
    sizes = placed.groupBy(*(F.col(g).alias(f"_in_{i}") for i, g in enumerate(groups))).agg(F.count(F.lit(1)).alias("_scores"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_in_{i}"))
    length = F.greatest(F.lit(block_scores), F.ceil(F.col("_scores") / MOST_BLOCKS))
    dealt = written(placed.join(F.broadcast(sizes), same).withColumn("_block", F.floor((F.col("_place") - 1) / length).cast("int")).select(*groups, "_block", "s", "p", "k"))
    blocks = dealt.groupBy(*groups, "_block").agg(F.sum("p").alias("p"), F.sum("k").alias("k"))
    shape = blocks.groupBy(*(F.col(g).alias(f"_in_{i}") for i, g in enumerate(groups))).agg(F.array_sort(F.collect_list(F.struct("_block", "p", "k"))).alias("_all"))
    shape = shape.select(*(f"_in_{i}" for i in range(len(groups))), F.col("_all.p").alias("_ps"), F.col("_all.k").alias("_ks"))
    # A block's first row alone carries the sizes of all blocks.
    heads = blocks.join(shape, same).select(*groups, "_block", "_ps", "_ks", F.lit(None).cast("double").alias("s"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("k"))
    none = F.lit(None).cast("array<bigint>")
    given = dealt.select(*groups, "_block", none.alias("_ps"), none.alias("_ks"), "s", "p", "k").unionByName(heads)

    def resample(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        head, part = part[part["_ps"].notna()].iloc[0], part[part["_ps"].isna()].sort_values("s")
        block, ps = int(key[-1]), np.asarray(head["_ps"], np.int64)
        ns = np.asarray(head["_ks"], np.int64) - ps
        p, n = part["p"].to_numpy(np.int64), part["k"].to_numpy(np.int64) - part["p"].to_numpy(np.int64)
        (p_before, p_here), (n_before, n_here) = (drawn_before(c, block, times, (seed, i)) for i, c in enumerate((ps, ns)))
        make = [np.random.default_rng([seed, 2 + i, block]) for i in range(2)]
        step, won, precise = max(1, DRAWN // len(part)), [], []
        for at in range(0, times, step):
            own = slice(at, at + step)
            cp, cn = (g.multinomial(h[own], c / c.sum()) if c.sum() else np.zeros((len(h[own]), len(c)), np.int64) for g, h, c in zip(make, (p_here, n_here), (p, n)))
            below_n, below_p = n_before[own, None] + np.cumsum(cn, axis=1) - cn, p_before[own, None] + np.cumsum(cp, axis=1) - cp
            won.append((cp * (below_n + cn / 2)).sum(axis=1))
            tp = ps.sum() - below_p
            precise.append((cp * (tp / np.maximum(tp + ns.sum() - below_n, 1))).sum(axis=1))
        return pd.DataFrame({**{g: [v] * times for g, v in zip(groups, key)}, "b": range(times), "won": np.concatenate(won), "precise": np.concatenate(precise), "pairs": float(ps.sum() * ns.sum()), "p": float(ps.sum())})

    fields = "".join(f"`{g}` {dealt.schema[g].dataType.simpleString()}, " for g in groups)
    shares = given.groupBy(*groups, "_block").applyInPandas(resample, fields + "b int, won double, precise double, pairs double, p double")
    resampled = shares.groupBy(*groups, "b").agg(ratio(F.sum("won"), F.first("pairs")).alias("auc"), ratio(F.sum("precise"), F.first("p")).alias("pr"))
    return _with_bounds(rows, groups, resampled, level)


def normal_weights(n: int, weights: Sequence[float] | None = None) -> list[float]:
    """Weights of n views: negative ones are 0, they sum to 1, and are equal if none is left or none is given."""
    if weights is not None and len(weights) != n:
        raise ValueError(f"{len(weights)} weights for {n} views")
    w = [max(0.0, float(x)) for x in weights] if weights else [1.0] * n
    total = math.fsum(w) or 0.0
    return [x / total for x in w] if total else [1.0 / n] * n


def view_ensemble(scores: DataFrame, weights: dict[str, float], keys: Sequence[str], view: str = "view", s: str = "s") -> DataFrame:
    """keys and s: the weighted mean of the views' scores of each row."""
    w = F.lit(None).cast("double")
    for name, x in weights.items():
        w = F.when(F.col(view) == name, x).otherwise(w)
    return scores.withColumn("_w", w).filter(F.col("_w").isNotNull()).groupBy(*keys).agg(ratio(F.sum(F.col("_w") * F.col(s)), F.sum("_w")).alias(s))


def normal_columns(weights: Sequence[Column]) -> list[Column]:
    """The same as normal_weights() for weights that stand in columns; null counts as 0."""
    kept = [F.greatest(F.coalesce(w.cast("double"), F.lit(0.0)), F.lit(0.0)) for w in weights]
    total = sum(kept[1:], kept[0])
    return [F.when(total > 0, w / total).otherwise(1.0 / len(kept)) for w in kept]


def four_places(x: Column) -> Column:
    """x with four decimals as C and SQL engines print it: the double's exact value is rounded, exact halves to even (0.03125 is 0.0312).
    Java rounds the digits that a double is written with instead, halves up."""
    scale = F.lit(2.0**26)
    size = F.abs(x)
    whole = F.floor(size * scale) / scale  # the leading bits; both parts' products are exact
    below = F.floor(size * 10000.0)
    over = whole * 20000.0 - (below * 2 + 1).cast("double")
    rest = (size - whole) * 20000.0
    up = (over > -rest) | ((over == -rest) & (below % 2 == 1))
    ten_thousandths = below + F.when(up, 1).otherwise(0)
    text = F.concat(F.when(F.signum(x) < 0, "-").otherwise(""), F.floor(ten_thousandths / 10000).cast("string"), F.lit("."), F.lpad((ten_thousandths % 10000).cast("string"), 4, "0"))
    return F.when(size < 4096.0, text).otherwise(F.format_string("%.4f", x))


def weights_text(weights: Sequence[float | Column]) -> Column:
    return F.concat_ws(",", *(four_places(w) if isinstance(w, Column) else F.lit(f"{float(w):.4f}") for w in weights))
