"""Running sums and ranks in two levels, so that one large group, one common score or a narrow range isn't one task.

Rows are dealt by ranges of (groups, order, ties), whose bounds Spark samples from the rows themselves, and written; there are as many
ranges as rows need, so a task's rows don't grow with the table. Sums of ranges are accumulated over the few ranges, and rows only inside their range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.sources.shared import written


#: Rows of a range, so that tasks grow in number and not in size; and rows for which another range is worth a task.
RANGE_ROWS, FEW_ROWS = 1 << 18, 1 << 14


def running_sums(df: DataFrame, groups: Sequence[str], by: str, sums: dict[str, str], descending: bool = False, ties: Sequence[str | Column] = ()) -> DataFrame:
    """Adds for each (out: column) of sums the sum over rows up to and with each row, in the order of by and ties. Nulls of by come
    last; what is equal in all of these is in the order of the input's row numbers."""
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    order = [first, *(F.col(t) if isinstance(t, str) else t for t in ties), F.col("_sum_row")]
    given = written(df.withColumn("_sum_row", F.monotonically_increasing_id()))  # sampled, counted and dealt, but computed once
    rows, usual = given.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(usual, math.ceil(rows / FEW_ROWS)), math.ceil(rows / RANGE_ROWS))
    kept = written(given.repartitionByRange(ranges, *(F.col(g) for g in groups), *order).withColumn("_sum_range", F.spark_partition_id()))
    totals = kept.groupBy(*(F.col(g).alias(f"_sum_in_{i}") for i, g in enumerate(groups)), F.col("_sum_range").alias("_sum_of")).agg(*(F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()))
    earlier = Window.partitionBy(*(f"_sum_in_{i}" for i in range(len(groups)))).orderBy("_sum_of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select(*(f"_sum_in_{i}" for i in range(len(groups))), "_sum_of", *(F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_sum_{o}") for o in sums))
    inside = Window.partitionBy("_sum_range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_sum_range") == F.col("_sum_of")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_sum_in_{i}"))
    joined = kept.repartition(ranges, "_sum_range", *groups).withColumns({o: F.sum(c).over(inside) for o, c in sums.items()}).join(F.broadcast(before), same)  # a row for each range, and for each group
    return joined.withColumns({o: F.col(o) + F.col(f"_sum_{o}") for o in sums}).drop("_sum_row", "_sum_range", "_sum_of", *(f"_sum_in_{i}" for i in range(len(groups))), *(f"_sum_{o}" for o in sums))


def ranked(df: DataFrame, groups: Sequence[str], by: str, tie: str, out: str = "rank") -> DataFrame:
    """Position from 1 by descending score, ties by tie; null scores last."""
    return running_sums(df.withColumn("_one", F.lit(1)), groups, by, {out: "_one"}, descending=True, ties=[tie]).drop("_one")
