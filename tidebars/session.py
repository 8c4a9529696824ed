"""Session settings and staging of shared intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dir: str | None = None
_staged: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the setting results depend on: every timestamp is read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session, whose executors share the driver's disk, may fall back
    to a temporary folder.
    """
    global _local_dir
    configured = spark.conf.get(_CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_CHECKPOINT_CONF} must name a folder shared by all executors")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tidebars-")
    return _local_dir


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several branches read one expensive intermediate: it is computed
    once, its lineage is cut, and it survives the loss of any executor. Parquet
    (rather than an RDD checkpoint) keeps column pruning and size statistics for
    the branches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables ``stage`` wrote; call when their results are no longer read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)
