"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: a run without blank, tab, line feed, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: What parts words.
SEPARATORS = " \t\n\v\f\r"

#: Rows in one Arrow batch. Texts are whole, so a batch of the default 10,000 rows could outgrow a worker.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: whole documents travel in them. Shuffle files go when the job that made them is over: what is needed
    later is written to tables first."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), also set as the checkpoint folder.

    On one machine (a local master) a temporary folder stands in where the setting is absent; a cluster must have it.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = path or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df` written as Parquet to a new table in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in a folder of their own within the shared folder, removed when the run is over."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.run, self.names = spark, f"{name}_{uuid.uuid4().hex}", []
        self.path = f"{shared_dir(spark)}/{self.run}"

    def table(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def bucketed(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """A table bucketed like all others of this session: joins of such tables on `column` shuffle nothing."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names.append(f"{self.run}_{name}")
        df.write.bucketBy(buckets, column).sortBy(column).option("path", f"{self.path}/{name}").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def clear(self, name: str = "") -> None:
        """Removes one table, or all."""
        for table in [] if name else self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
