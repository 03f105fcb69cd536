"""Intermediate tables on shared storage.

An intermediate that several plans read is written once as Parquet below the folder the cluster names in
``spark.checkpoint.dir``. A written table survives the loss of any executor, is column-pruned when read again,
and has a row count that costs only a footer read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHARED_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_kept: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediates: the session's setting, or a temporary one in local mode only."""
    configured = spark.conf.get(_SHARED_DIR, None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/auditkit-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_SHARED_DIR} is not set; intermediates need shared storage on a cluster")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-auditkit-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes all that this application has written for itself. Frames built on it can't be read any more."""
    jvm, where = spark.sparkContext._jvm, shared_dir(spark)
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        del _kept[key]


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer tasks than cores, dealt out to all cores, for work that is heavy per row. Large inputs pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str = "tmp", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame once and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, key: tuple, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The stage table for ``key``, built by ``build()`` the first time this application asks for it."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _kept:
        df = build()
        path = f"{shared_dir(spark)}/{key[-1]}-{uuid.uuid4().hex[:12]}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        _kept[full] = (path, df.schema)
    path, schema = _kept[full]
    return spark.read.schema(schema).parquet(path)
