"""Staged tables: derived once, written as parquet to the shared folder, then scanned
with column pruning by everything downstream. The files outlive lost executors and cut
the lineage of long plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple, str] = {}
_ROOTS: dict[str, str] = {}


#: Bytes of rows of the largest table that a join broadcasts.
BROADCAST_BYTES = 1 << 20


def joins_by_size(spark: SparkSession) -> None:
    """From now on only adaptive execution broadcasts, by the size of the rows that it has seen.

    The planner goes by file sizes, and parquet keeps ids, repeated texts and nested rows of runs in a
    fiftieth of their size in memory: files below its limit became broadcasts of hundreds of MB, all of
    which pass the driver. A study has dozens of joins whose tables the driver keeps until the query
    ends, so each may take ``BROADCAST_BYTES`` at most, or the session's own lower limit. Both sides are
    shuffled by the time a size is known, so a broadcast left out costs a sort and no further shuffle.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(static)
    if limit != "-1":
        chosen = spark.conf.get(adaptive, None) or limit
        as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        spark.conf.set(adaptive, str(min(as_bytes(chosen), BROADCAST_BYTES)))
        spark.conf.set(static, "-1")


def shared_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    A local folder is made up only for a local master without that setting; on a cluster the
    executors would write to disks of their own, so there the setting is required.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError(f"set spark.checkpoint.dir to a shared folder; the master is {master}")
            base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _ROOTS[app] = f"{base.rstrip('/')}/runloom-{uuid.uuid4().hex}"
    return _ROOTS[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made by ``shared_path``, on whatever file system it lies."""
    if not path.startswith(shared_root(spark) + "/"):
        raise ValueError(f"not a staged path: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, a folder per value of ``by``: evaluated once, lineage cut."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, name: str, source: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from ``source``; built and written on first use."""
    joins_by_size(spark)
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _STAGED:
        path = shared_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])
