"""Hard negatives: entropy of sources in clusters, thresholds, equal shares of sources."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.columns import require_rows


def source_entropy(df: DataFrame, cluster: str, source: str) -> DataFrame:
    """cluster, n, entropy (bits) of the sources' shares. Counts first, so that only a row for each pair is shuffled."""
    counts = df.groupBy(cluster, source).agg(F.count(F.lit(1)).alias("_c"))
    # sum of -p log2 p with p = c / n is log2 n - sum(c log2 c) / n
    sums = counts.groupBy(cluster).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"))
    return sums.select(cluster, "n", F.greatest(F.log2("n") - F.col("_s") / F.col("n"), F.lit(0.0)).alias("entropy"))


def kept_clusters(df: DataFrame, cluster: str, source: str, similarity: str, least_entropy: float, least_similarity: float) -> DataFrame:
    means = df.groupBy(cluster).agg(F.avg(similarity).alias("mean_similarity"))
    return source_entropy(df, cluster, source).join(means, cluster).filter((F.col("entropy") >= least_entropy) & (F.col("mean_similarity") >= least_similarity)).select(cluster)


def select_hard(negatives: DataFrame, n_positives: int, sources: Sequence[str], row_id: str, cluster: str, source: str, similarity: str, confidence: str, ratio: float = 6.0, similarity_range: tuple[float, float] = (0.25, 0.9), most_confidence: float = 0.8, least_entropy: float = 0.8, least_mean: float = 0.3) -> DataFrame:
    """Negatives of mixed, near clusters, similar to positives but not copies, whose source is hard to tell; an equal cap a source."""
    clusters = kept_clusters(negatives, cluster, source, similarity, least_entropy, least_mean)
    kept = negatives.filter(F.col(similarity).between(*similarity_range) & (F.col(confidence) <= most_confidence)).join(clusters, cluster, "left_semi")
    require_rows(kept, "no negative passed the filters")
    cap = max(1, math.ceil(ratio * n_positives) // max(1, len(sources)))
    ranked = kept.filter(F.col(source).isin(*sources)).withColumn("_score", (F.lit(1.0) - F.col(similarity)) + F.col(confidence))
    order = Window.partitionBy(source).orderBy("_score", row_id)  # a top-k: Spark keeps cap rows of each task before the shuffle
    return ranked.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")
