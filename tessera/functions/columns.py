"""Column expressions and schema helpers: cleaning, coercion, choosing columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Key texts that mean a missing key (case-sensitive).
MISSING_KEYS = ("", "nan", "None")
#: Columns that are never features.
NOT_FEATURES = ("label", "source_dataset", "smiles", "SMILES", "inchikey", "InChIKey", "inchi", "InChI", "id", "ID", "molid", "MOLID", "name", "Name")
#: Names tried, in this order, for the column with a negative's origin and for the structure text.
DOMAIN_COLUMNS = ("decoy_name", "decoy_domain", "domain", "source")
STRUCTURE_COLUMNS = ("SMILES", "smiles", "Canonical_SMILES", "canonical_smiles")


class MissingColumns(ValueError):
    pass


class EmptyInput(ValueError):
    pass


def clean_key(c: Column) -> Column:
    """Text without white space at its ends; texts that stand for a missing key are null."""
    text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(text.isin(*MISSING_KEYS), None).otherwise(text)


def to_number(c: Column) -> Column:
    """Double, or null where the text is no finite-format number. NaN is null too: Spark would order it above all."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_bit(c: Column) -> Column:
    """1 if the number, with null as 0 and cut to [0, 1], is above a half."""
    return (F.least(F.greatest(F.coalesce(to_number(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) > 0.5).cast("int")


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def quoted(name: str) -> str:
    """A column's name with dots and spaces taken as they are."""
    return "`" + name.replace("`", "``") + "`"


def non_null_count(columns: Iterable[str]) -> Column:
    """How many of the columns are not null."""
    return sum((F.col(quoted(c)).isNotNull().cast("int") for c in columns), F.lit(0))


def split_list(text: str) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def keep_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Those of the named columns that exist, in the order of names."""
    return df.select(*[quoted(n) for n in names if n in df.columns])


def require(df: DataFrame, names: Iterable[str], shown: int = 10) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing[:shown]}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyInput(f"no rows: {what}")
    return df


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    found = [c for c in df.columns if c.startswith(prefix)]
    if not found:
        raise MissingColumns(f"no column begins with {prefix!r}")
    return found


def numeric_features(df: DataFrame, wanted: Sequence[str] = (), exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    """The wanted columns, or all numeric ones but the excluded."""
    if wanted:
        require(df, wanted, 8)
        return list(wanted)
    found = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    if not found:
        raise MissingColumns("no numeric feature column")
    return found


def without_internal(df: DataFrame) -> DataFrame:
    """Drop columns whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def first_of(df: DataFrame, names: Sequence[str], chosen: str | None = None) -> str:
    """The column that the user chose, or the first of names that exists."""
    if chosen:
        require(df, [chosen])
        return chosen
    for n in names:
        if n in df.columns:
            return n
    raise MissingColumns(f"none of {list(names)}")


def min_max(df: DataFrame, column: str, groups: Sequence[str], out: str) -> DataFrame:
    """Scores scaled to [0, 1] by group; a constant group gets 0. One small aggregate is joined back, no window is needed.

    NaN says nothing of a group's bounds and stays NaN (0 in a constant group); null stays null.
    """
    known = F.when(~F.isnan(F.col(column).cast("double")), F.col(column))
    bounds = df.groupBy(*(F.col(g).alias(f"_{g}") for g in groups)).agg(F.min(known).alias("_least"), F.max(known).alias("_most"))
    width = F.col("_most") - F.col("_least")
    same = F.lit(True)
    for g in groups:
        same = same & df[g].eqNullSafe(bounds[f"_{g}"])
    joined = (df.join(bounds, same) if groups else df.crossJoin(F.broadcast(bounds))).drop(*(f"_{g}" for g in groups))  # one row without groups
    return joined.withColumn(out, F.when(width > 0, (F.col(column) - F.col("_least")) / width).otherwise(F.when(F.col(column).isNotNull(), F.lit(0.0)))).drop("_least", "_most")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of value computed once: what a lambda refers to would else be computed again for each of its elements."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))
