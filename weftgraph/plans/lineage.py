"""Cutting lineage in a place that every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``. A local session that names
    none gets a temporary folder; on a cluster that would be a different folder on every machine, so there it is an
    error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "weftgraph-checkpoints"))
        found = sc._jsc.sc().getCheckpointDir()
        forget_at_exit(spark, found.get())
    return (named or found.get()).rstrip("/")


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends; its tables serve this session alone."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    return path


@contextmanager
def held(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings that hold for a while; ``_`` stands for a dot."""
    before = {(key := k.replace("_", ".")): spark.conf.get(key, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k.replace("_", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` evaluated once and kept in the shared folder; later reads survive lost executors.

    A checkpoint would hand down all conditions that Spark infers for its rows. In a loop of joins these multiply
    from round to round until planning ends in memory, so no conditions are inferred while it is made. Its shuffle
    files go as soon as it is there, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    with held(spark, spark_sql_constraintPropagation_enabled="false", spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut`, as Parquet: compressed, and read with column pruning."""
    path = new_folder(df.sparkSession, name)
    with held(df.sparkSession, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true"):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)
