"""Reading tables, cutting lineage in the shared folder, and small helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one process (local mode, as in tests) gets a temporary folder; a cluster has none that
    would do, and must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written once into the shared folder, so that a lost executor costs one task and not the whole lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def deal(self, df: DataFrame, *keys: str) -> DataFrame:
        """Write df in buckets of keys and read it back: joins and groups on them shuffle nothing of it. It leaves the catalogue again."""
        self.count += 1
        parts, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"dealt_{uuid.uuid4().hex}"
        writer = df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("compression", "zstd")
        writer.option("path", f"{self.base}/{self.count}").saveAsTable(name)
        dealt = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
        self.spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle that dealt the rows out
        return dealt

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of keep() that nothing reads any more."""
        for df in frames:
            for name in df.inputFiles()[:1]:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_arrow(df: DataFrame, columns: list, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over the named columns alone, so that nothing else is read or sent to Python."""
    return df.select(*columns).mapInArrow(fn, schema)


def with_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), whatever other columns there are."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def bound(value, fn):
    """fn of a lambda variable that holds value: an expression used inside a lambda is computed once, not for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def split_fold(doc_id, k: int):
    """crc32 of doc_id as text, modulo k."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k
