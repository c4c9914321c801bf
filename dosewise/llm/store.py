"""Tables written between the jobs of an operator, and size-checked broadcasts.

A table goes to the shared folder that the cluster names in
``spark.checkpoint.dir``, so later jobs survive the loss of any executor; unlike
``checkpoint()`` the write runs the plan once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship  # noqa: F401 (operators ship by this module)

#: A side is broadcast when its counted rows times its row width stay under this.
BROADCAST_BYTES = 64 << 20

_kept: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder for one table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _kept.append(path)
    return path


#: Spark's bound of an Arrow batch that goes to a Python worker.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep(df: DataFrame, compression: str = "snappy", batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back; Python workers get Arrow batches of ``batch_bytes`` meanwhile."""
    path, conf = folder(df.sparkSession), df.sparkSession.conf
    before = conf.get(ARROW_BYTES)
    if batch_bytes:
        conf.set(ARROW_BYTES, batch_bytes)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if batch_bytes:
            conf.set(ARROW_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables kept so far; results that still read them must be consumed before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _kept:
        path = jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a kept table) with a broadcast hint if its counted size allows it, else unchanged (shuffle join)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
