"""Reading the given tables, and writing intermediate ones to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "lorekeep.local.checkpoint.dir"
#: Paths that each application has been given, for ``swept``.
_GIVEN: dict[str, list[str]] = {}


def spread(df: DataFrame) -> DataFrame:
    """``df`` over every core, if its files split into fewer parts than there are cores; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master, where all of them are one process, a temporary folder may take its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL, None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set(_LOCAL, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def swept(spark: SparkSession) -> int:
    """Delete all that was written below paths of ``new_path`` so far, and say how many there were.

    For when results have been read or written elsewhere: frames made before can't be read again.
    """
    conf, paths = spark.sparkContext._jsc.hadoopConfiguration(), _GIVEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
