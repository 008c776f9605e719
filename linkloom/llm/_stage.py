"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.  Where it is unset, a folder of our own in local mode
    and an error on a cluster, whose machines do not share their disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        folder = tempfile.TemporaryDirectory(prefix="linkloom-")
        _own["dir"] = f"file://{folder.name}"
        atexit.register(folder.cleanup)
    return _own["dir"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and returns the table: its lineage ends
    there, a lost executor loses nothing, and the planner knows its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linkloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[id(found)] = (weakref.ref(found), path)
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `staged` that nothing unwritten depends on any more."""
    for table in tables:
        ref, path = _paths.pop(id(table), (None, None))
        if ref is not None and ref() is table:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_batches_small(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most `size` bytes from now on in this session.  Batches live outside
    the heap, in the executor and in its Python workers; large ones do not pay."""
    spark.conf.set(_BATCH, size)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """The same for what is written inside."""
    before = spark.conf.get(_BATCH)
    keep_batches_small(spark, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)
