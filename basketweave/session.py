"""Spark session defaults and the shared folder for cutting lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set only where the caller's session leaves them unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app_name: str = "basketweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE and skew-join splitting on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the one the application set for checkpoints.

    On a cluster every executor must reach it, so an unset folder is an error there; a local session gets one
    beside its warehouse.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse').rstrip('/')}/shared-{uuid.uuid4().hex[:12]}")
    return context.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give MLlib's iterative learners a reliable checkpoint folder."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; returns the table read back and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one result feeds several consumers: the plan is cut, a lost executor costs a
    re-read instead of a recomputation, and the scan keeps statistics and column pruning.
    """
    return write_stage(df, name)[0]


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the finished folder ``new`` in the place of ``path``."""
    fs, to = _folder(spark, path)
    fs.delete(to, True)
    if not fs.rename(_folder(spark, new)[1], to):
        raise OSError(f"{new} could not be moved to {path}")


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, there = _folder(spark, path)
    fs.delete(there, True)


def _folder(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``write_stage`` that nothing reads any more."""
    if "/stage/" not in path:
        raise ValueError(f"not a staged table: {path}")
    delete_folder(spark, path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, tuple[str, str]]:
    """Write ``df`` to the shared folder in ``buckets`` files by ``key``; returns the table and what ``drop_bucketed`` takes.

    Tables with the same buckets join on ``key`` without an exchange of either.
    """
    spark = df.sparkSession
    table, path = re.sub(r"\W", "_", name), f"{shared_dir(spark).rstrip('/')}/stage/{name}"
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table), (table, path)


def drop_bucketed(spark: SparkSession, made: tuple[str, str]) -> None:
    table, path = made
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_stage(spark, path)
