"""Tables in files: CSV at the edges, Parquet between stages, workbooks where an engine is installed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T


class MissingDependency(ImportError):
    """An optional library is not installed."""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. With a schema nothing is inferred; without one all columns are text, to be coerced by name.

    A missing path raises AnalysisException (PATH_NOT_FOUND).
    """
    reader = spark.read.option("header", True).option("nanValue", "nan")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of a workbook, one above the other, columns by name. Needs pandas' workbook engine (openpyxl)."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise MissingDependency("reading workbooks needs openpyxl; save each sheet as CSV and use union_sheets") from e
    sheets = pd.read_excel(path, sheet_name=None, dtype=str)
    return union_sheets([spark.createDataFrame(s.astype(object).where(s.notna(), None), T.StructType([T.StructField(str(c), T.StringType()) for c in s.columns])) for s in sheets.values()])


def union_sheets(sheets: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, single: bool = False) -> int:
    """Overwrite path (folders are made) and return the number of rows written. single: one file, for small reports."""
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["rows"]


def write_labelled(df: DataFrame, path: str, label: str = "true_label") -> int:
    """CSV whose first column is the row's label."""
    return write_csv(df.select(label, *[c for c in df.columns if c != label]), path, single=True)
