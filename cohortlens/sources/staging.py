"""Tables written to shared storage so that long jobs do not replay their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cohortlens.functions.numbers import quoted


def checkpoint_root(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster a
    machine-local path would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def use_checkpoints(spark: SparkSession) -> None:
    """Give iterative fits a reliable place to cut their lineage."""
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_COLLECTORS: list[list[str]] = []


@contextmanager
def staged_paths() -> Iterator[list[str]]:
    """The folders that ``stage`` writes inside the block, for ``release``."""
    paths: list[str] = []
    _COLLECTORS.append(paths)
    try:
        yield paths
    finally:
        _COLLECTORS[:] = [c for c in _COLLECTORS if c is not paths]


def record(path: str) -> str:
    """Note a staged folder in every open ``staged_paths`` block."""
    for paths in _COLLECTORS:
        paths.append(path)
    return path


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged folders through the file system they lie on; ``paths`` is empty afterwards."""
    while paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Later steps read only the columns and fold partitions they use, and a lost executor
    costs a re-read instead of the whole history.
    """
    path = record(scratch_path(df.sparkSession, name))
    if partition_by:
        # Rows of one partition value are brought together in files of the advisory size;
        # otherwise every task would write a small file per value.
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(path).selectExpr(*[quoted(f.name) for f in schema])
