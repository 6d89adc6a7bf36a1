"""Session helpers: reading tables, and tables kept in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader so any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small file that each make much work, dealt out evenly: by its bytes
    alone Spark would read it in one or two tasks and leave the others idle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` is the cluster's choice. Where it is unset, a local
    session, as in tests, uses a folder in its warehouse; on a cluster there is no
    folder that is known to be shared, so nothing is written.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.scratch"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    They survive lost executors. ``drop`` removes what later steps don't read;
    what a returned DataFrame still reads stays until the folder is emptied.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
