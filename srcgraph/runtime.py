"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master without it gets a folder of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="srcgraph-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


#: Tables settled within ``scratch``, by thread.
_open = threading.local()
#: Shuffle files of a query may go once its result is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffle files that it took are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/srcgraph-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if getattr(_open, "held", None) is not None:
        _open.held.append(out)
    return out


def release(*settled: DataFrame) -> None:
    """Delete what ``settle`` wrote; nothing that is still to run may read it."""
    for df in settled:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end what ``settle`` writes within, in this thread; only plain values may leave."""
    outer, _open.held = getattr(_open, "held", None), []
    try:
        yield
    finally:
        held, _open.held = _open.held, outer
        release(*held)
