"""Folders for intermediate tables, shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local: dict[str, str] = {}
_made: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``.

    Where nothing is set and the master is local, one machine runs all, so a folder of its own serves; a cluster without
    the setting is an error, since executors would write to folders that others can't read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="millrace-")
    return f"file://{_local[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _made:
        made.append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables begun inside are removed on leaving. What is to last is written, inside, to a path made outside.

    Operators return plans that still read such tables, so it is for whoever writes the result to say when they may go.
    """
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made[:] = [other for other in _made if other is not made]
        for path in made:
            drop(spark, path)


def materialise(df, name: str):
    """Write ``df`` under the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*frames) -> None:
    """Remove the tables behind frames that ``materialise`` returned; nothing lazy may read them any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop(df.sparkSession, path)
