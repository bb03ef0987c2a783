"""Tables in the folder that the driver and all executors share.

Iterative operators cut their lineage by writing a table there and reading it
back; unlike a local checkpoint it survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, a new folder under /tmp."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.qvault.sharedDir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.qvault.sharedDir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/qvault-{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written under ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; return the table read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that an operator writes on its way to a result, so that it can delete those that the result doesn't read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written to the shared folder and read back."""
        out, self.paths[label] = materialize(df, label)
        return out

    def drop(self, *labels: str) -> None:
        for label in labels:
            drop_path(self.spark, self.paths.pop(label))
