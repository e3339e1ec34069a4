"""Reading tables and cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A test table, pruned to ``columns`` when some are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a folder of this machine if all executors are on it, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "spanloom-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder; smaller than a checkpoint where rows repeat."""
    spark = df.sparkSession
    path = f"{_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete the written tables. Results that read them must have been taken; it is done when the program ends while the session is up."""
    spark = spark or SparkSession.getActiveSession()
    sc = spark.sparkContext if spark else None
    if sc is None or sc._jsc is None:
        return
    while _WRITTEN:
        path = sc._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _at_end() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001 (the session is gone; the folder is the cluster's to clean)
        _WRITTEN.clear()


atexit.register(_at_end)
