"""Tables that cut a plan's lineage: Parquet in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where all runs in this one process and it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='coppice-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Tables that each open scratch() has seen written.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables that are written inside, but for those that kept() takes out, once all that reads them has run."""
    _OPEN.append([])
    try:
        yield
    finally:
        drop(*_OPEN.pop())


def kept(table: DataFrame) -> DataFrame:
    """The table, which the scratch() around leaves alone."""
    if _OPEN:
        _OPEN[-1][:] = [t for t in _OPEN[-1] if t is not table]
    return table


def written(df: DataFrame, name: str = "stored") -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._coppice_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made and that no plan will read again; others are left alone."""
    for df in tables:
        if path := getattr(df, "_coppice_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)



def release_shuffles(spark: SparkSession) -> None:
    """Lets executors delete the shuffle files of finished jobs, which stay until the driver's own garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
