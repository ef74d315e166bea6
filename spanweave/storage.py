"""Tables written in the folder that all executors share.

A written table cuts lineage and survives the loss of executors. The folder is
the one the cluster names in ``spark.checkpoint.dir``. Only a local session may
go without it; that gets a temporary folder, removed when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its written files are no larger.
BROADCAST_BYTES = 8 << 20

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, from the session's settings."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="spanweave-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return "file://" + _local["dir"]


def _size(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(where).getLength())


def folder(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder; ``release`` deletes what is written there."""
    path = f"{shared_root(spark)}/spanweave-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


class Written:
    """A table in the shared folder: ``df`` reads it, ``nbytes`` is its size."""

    def __init__(self, df: DataFrame, name: str = "t"):
        self.spark = df.sparkSession
        self.path = folder(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def nbytes(self) -> int:
        return _size(self.spark, self.path)

    def side(self, limit: int = BROADCAST_BYTES) -> DataFrame:
        """The table as a join side: broadcast up to ``limit`` bytes, a shuffle join beyond."""
        return F.broadcast(self.df) if self.nbytes <= limit else self.df

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def made() -> int:
    """How many tables this process wrote and did not release; to pass to ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Deletes the tables this process wrote, those after ``since`` only, but for the paths to keep. Call it once results are read."""
    n, left = 0, _made[:since]
    for s, path in _made[since:]:
        if path in keep:
            left.append((s, path))
            continue
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
    _made[:] = left
    return n
