"""Test isolation by quotas, stratified folds, hold-outs. Choices follow md5 of seed and id: equal in each run and engine."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.columns import EmptyInput
from tessera.functions.running import running_sums

log = logging.getLogger(__name__)


def draw_key(seed: int, row_id: str):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def allocate(total: int, available: dict[str, int], cap: int | None = None, mode: str = "greedy") -> dict[str, int]:
    """Numbers that sum to total where possible, at most what is available (and cap) of each name.

    An even share each (the first names get the remainder), then what is missing from names with some left: in the order
    of names (greedy), or evenly again and again (waterfill).
    """
    room = {n: min(a, cap) if cap is not None else a for n, a in available.items()}
    share, extra = divmod(max(0, total), len(room)) if room else (0, 0)
    got = {n: min(share + (i < extra), r) for i, (n, r) in enumerate(room.items())}
    while (need := total - sum(got.values())) > 0 and (left := {n: r - got[n] for n, r in room.items() if r > got[n]}):
        if mode == "greedy":
            n = next(iter(left))
            got[n] += min(left[n], need)
        else:
            more = allocate(need, left) if need >= len(left) else dict.fromkeys(list(left)[:need], 1)
            got = {n: g + more.get(n, 0) for n, g in got.items()}
    return got


def test_positives(n: int, fraction: float) -> int:
    """round-half-even of the fraction, one at least, and one is left for training if there are two."""
    return max(1, min(n - 1, round(n * fraction))) if n > 1 else 1


def sample_per_group(df: DataFrame, group: str, quotas: dict[str, int], seed: int, row_id: str) -> DataFrame:
    """quotas[g] rows of each group g without replacement. The rank has two levels, so a large group is many tasks."""
    wanted = [n for n, q in quotas.items() if q > 0]
    pool = df.filter(F.col(group).isin(wanted)) if wanted else df.limit(0)
    keyed = pool.withColumn("_key", draw_key(seed, row_id)).withColumn("_at", F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32).withColumn("_one", F.lit(1))
    ranked = running_sums(keyed, [group], "_at", {"_n": "_one"}, ties=["_key", row_id])
    limit = F.lit(0)
    for n in wanted:
        limit = F.when(F.col(group) == n, quotas[n]).otherwise(limit)
    return ranked.filter(F.col("_n") <= limit).drop("_key", "_at", "_one", "_n")


def quota_split(df: DataFrame, label: str, domain: str, decoys: Sequence[str], row_id: str, fraction: float = 0.2, ratio: int = 6, seed: int = 42, per_domain: int | None = None, mode: str = "greedy") -> tuple[DataFrame, DataFrame, dict]:
    """(test, train, report): a share of the positives and ratio negatives for each, evenly from the decoys' domains.

    Train is everything else, negatives of unlisted domains too.
    """
    counts = df.filter(F.col(label).isin(0, 1)).groupBy(label, domain).count().collect()  # a row for each domain
    n_pos = sum(r["count"] for r in counts if r[label] == 1)
    have = {d: sum(r["count"] for r in counts if r[label] == 0 and r[domain] == d) for d in decoys}
    if not n_pos:
        raise EmptyInput("no positive row")
    if not sum(have.values()):
        raise EmptyInput("no negative row of the decoys")
    k = test_positives(n_pos, fraction)
    wanted, cap = ratio * k, per_domain if per_domain and per_domain > 0 else None
    if cap and sum(min(a, cap) for a in have.values()) < wanted:
        log.warning("at most %d rows a domain is not enough for %d negatives", cap, wanted)
    quotas = allocate(wanted, have, cap, mode)
    positives = sample_per_group(df.filter(F.col(label) == 1).withColumn("_all", F.lit("all")), "_all", {"all": k}, seed, row_id).drop("_all")
    negatives = sample_per_group(df.filter(F.col(label) == 0), domain, quotas, seed, row_id)
    test = positives.unionByName(negatives)
    train = df.join(test.select(row_id), row_id, "left_anti").select(*df.columns)
    n_neg = sum(quotas.values())
    return test, train, {"n_pos_total": n_pos, "n_test_pos": k, "n_test_neg": n_neg, "target_neg": wanted, "alloc": quotas, "avail_by_domain": have, "achieved_ratio": f"1:{n_neg // k}"}


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: positions in the order of label and draw, dealt out in turn. Per label folds differ by one row at most."""
    keyed = df.withColumn("_key", draw_key(seed, row_id)).withColumn("_at", F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32).withColumn("_one", F.lit(1))
    inside = running_sums(keyed, [label], "_at", {"_n": "_one"}, ties=["_key", row_id])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = inside.join(before.select(F.col(label).alias("_label"), "_before"), F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn("fold", ((F.col("_before") + F.col("_n") - 1) % folds).cast("int")).drop("_key", "_at", "_one", "_n", "_label", "_before")


def hold_out(df: DataFrame, fraction: float, row_id: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ceil(fraction * n) test rows."""
    n = df.count()
    k = -int(-(n * fraction) // 1)
    test = sample_per_group(df.withColumn("_all", F.lit("all")), "_all", {"all": k}, seed, row_id).drop("_all")
    return df.join(test.select(row_id), row_id, "left_anti").select(*df.columns), test
