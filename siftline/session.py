"""Sessions and shared-folder tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "siftline", **more: str) -> SparkSession:
    """A session with this library's settings; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext.getCheckpointDir()
        path = kept.rsplit("/", 1)[0] if kept else None
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_WRITTEN: list[str] = []
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("tables_written", default=())
_PATH_OF: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files behind; otherwise these stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: cuts lineage, survives lost executors, and gives later plans its size. What was shuffled for it goes. See drop_written."""
    return written_in_turns(df, [df], name)


def written_in_turns(like: DataFrame, turns: Iterable[DataFrame], name: str) -> DataFrame:
    """One written table of several tables with the columns of `like`; what is shuffled for one goes before the next is worked out."""
    spark, schema = like.sparkSession, like.schema
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        for df in turns:
            df.write.option("compression", "zstd").mode("append").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(schema).parquet(path)
    _PATH_OF[out] = path
    for made in _OPEN.get():
        made.append(out)
    return out


@contextmanager
def tables_written() -> Iterator[list[DataFrame]]:
    """The tables that are written inside, to be dropped together."""
    made: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield made
    finally:
        _OPEN.reset(token)


def _remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; others stay as they are."""
    for table in tables:
        if path := _PATH_OF.pop(table, None):
            _remove(table.sparkSession, path)
            if path in _WRITTEN:
                _WRITTEN.remove(path)


def drop_written(spark: SparkSession) -> int:
    """Removes the tables that this process has written so far; to be called when the results that read them have been read. How many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())
    return n
