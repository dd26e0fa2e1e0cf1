"""Ingest: one row per key, positives from sheets, overlap control between sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.columns import clean_key, keep_present, non_null_count, quoted

#: Columns of the positives' table and those that identify a compound.
POSITIVE_COLUMNS = ("Entry", "Prodrugid", "Prodrug", "SMILES", "PubChem", "CAS No.", "inchi", "inchi_k")
IDENTIFIERS = ("Prodrugid", "Prodrug", "PubChem", "CAS No.", "inchi", "inchi_k")


def best_row(df: DataFrame, key: str, identifiers: Sequence[str], tie: Sequence[str | Column]) -> DataFrame:
    """Of each key the row with most non-null identifiers, the first by tie among equals. Rows without a key all stay."""
    order = Window.partitionBy(key).orderBy(F.desc("_filled"), *tie)
    ranked = df.filter(F.col(key).isNotNull()).withColumn("_filled", non_null_count(identifiers)).withColumn("_n", F.row_number().over(order))
    best = ranked.filter("_n = 1").drop("_n", "_filled")
    return best.unionByName(df.filter(F.col(key).isNull()))


def value_counts(df: DataFrame, column: str, more_than: int = 1, top: int = 20) -> DataFrame:
    """Values that occur more than more_than times, most frequent first (ties by value). Null values don't count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") > more_than).orderBy(F.desc("count"), column).limit(top)


def prepare_positives(sheets: DataFrame, key: str = "SMILES", row_id: str = "row_id") -> DataFrame:
    """Distinct rows, keys cleaned, the best row of each key, known columns only, with prodrug_label = 1.

    Without a key column the distinct rows stay as they are.
    """
    data = [c for c in sheets.columns if c != row_id]
    best = sheets.dropDuplicates(data)
    if key in data:
        order = [row_id] if row_id in sheets.columns else [quoted(c) for c in data]
        distinct = sheets.withColumn(key, clean_key(F.col(key))).dropDuplicates(data)
        # Rows without a key are told apart by all their columns.
        best = best_row(distinct, key, [c for c in IDENTIFIERS if c in data], order).dropDuplicates(data)
    return keep_present(best, POSITIVE_COLUMNS).withColumn("prodrug_label", F.lit(1))


def positives_report(sheets: DataFrame, key: str = "SMILES", row_id: str = "row_id") -> DataFrame:
    """One row: n_raw, n_distinct (rows), n_prepared, n_with_key, n_without_key (of the prepared)."""
    data = [c for c in sheets.columns if c != row_id]
    prepared = prepare_positives(sheets, key, row_id)
    has_key = F.col(key).isNotNull() if key in data else F.lit(False)
    counts = prepared.agg(F.count(F.lit(1)).alias("n_prepared"), F.count_if(has_key).alias("n_with_key"), F.count_if(~has_key).alias("n_without_key"))
    raw = sheets.agg(F.count(F.lit(1)).alias("n_raw"))
    distinct = sheets.select(*map(quoted, data)).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    return raw.join(F.broadcast(distinct)).join(F.broadcast(counts))  # one row each


def connectivity(inchikey: Column) -> Column:
    """The first block of an InChIKey, equal for salts of charge, isotopes and stereo forms."""
    return F.substring(inchikey, 1, 14)


def overlap_control(df: DataFrame, key: str, source: str, positive: str, row_id: str) -> DataFrame:
    """One row for each key and source, and no negative with a key that a positive has. Rows without a key stay."""
    keyed, rest = df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
    once = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(source, key).orderBy(row_id))).filter("_n = 1").drop("_n")
    positives = once.filter(F.col(source) == positive)
    negatives = once.filter(~F.col(source).eqNullSafe(positive)).join(positives.select(key), key, "left_anti").select(*once.columns)
    return positives.unionByName(negatives).unionByName(rest)
