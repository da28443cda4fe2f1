"""Results that must outlive the files they were read from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session whose executors are threads of the driver may go
    without one: elsewhere a local folder would hide one executor's files from the others."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return LOCAL_SCRATCH


def session_dir(spark: SparkSession) -> str:
    """The part of the scratch folder that belongs to this application."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: survives rewrites of its source and lost executors."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application. Lazy results that read them are lost with them."""
    delete_path(spark, session_dir(spark))


def delete_path(spark: SparkSession, path: str) -> bool:
    """Deletes a folder or file of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def mark(spark: SparkSession, path: str) -> None:
    """Makes an empty file and the folders above it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p).close()


def marks(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files in a folder, none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(p)] if system.exists(p) else []
