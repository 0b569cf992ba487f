"""Small helpers for tables written once per micro-batch."""

from __future__ import annotations

from pyspark.sql import SparkSession


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id}"


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path: the folder may live anywhere Spark can reach."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = file_system(spark, path)
    return fs.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = file_system(spark, path)
    fs.delete(hadoop, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, hadoop = file_system(spark, path)
    return fs.getFileStatus(hadoop).isDirectory()
