"""Written tables between steps: in a shared folder for a while, or as the steps of a job."""

from __future__ import annotations

import atexit
import logging
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_log = logging.getLogger(__name__)


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a folder of our own in local mode and an error on a
    cluster, whose machines do not share their disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        folder = tempfile.TemporaryDirectory(prefix="linkloom-steps-")
        _own["dir"] = f"file://{folder.name}"
        atexit.register(folder.cleanup)
    return _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table that later steps read instead of computing it again."""
    path = f"{shared_folder(df.sparkSession)}/linkloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt by the columns to as many tasks as there are shuffle partitions or twice the cores,
    for rows that cost much more time than their bytes suggest, which would be put together."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: its commit marker is there."""
    files, at = _filesystem(spark, f"{path}/_SUCCESS")
    return files.exists(at)


class Steps:
    """A job's tables in a work folder.  A step whose table is complete is read, not run again, so
    a job that was stopped goes on where it was; each step is logged with its rows and seconds."""

    def __init__(self, spark: SparkSession, work: str, force: bool = False):
        self.spark, self.work, self.force = spark, work.rstrip("/"), force
        self.ran: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.work}/{name}"

    def table(self, name: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
        if self.force or not is_complete(self.spark, self.path(name)):
            begin = time.monotonic()
            writer = build().write.mode("overwrite")
            (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
            self.ran.append(name)
            _log.info("%s: %d rows in %.1f s", name, self.spark.read.parquet(self.path(name)).count(), time.monotonic() - begin)
        return self.spark.read.parquet(self.path(name))

    def made(self, name: str, marker: str, make: Callable[[str], None]) -> str:
        """The path of something else than a table, such as a model, complete once the part path/marker is written to its end."""
        if self.force or not is_complete(self.spark, f"{self.path(name)}/{marker}"):
            make(self.path(name))
            self.ran.append(name)
        return self.path(name)


def partitions(input_bytes: int, cores: int, target: int = 128 << 20) -> int:
    """Shuffle partitions of about `target` bytes each, at least two for every core."""
    return max(2 * cores, -(-input_bytes // target))
