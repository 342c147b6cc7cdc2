"""Reliable intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names the folder. Where it is unset and Spark runs in this process alone (tests, a laptop),
a temporary folder is used and removed at exit; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import memory

_own: dict[str, str] = {}
_made: dict[str, DataFrame] = {}
#: Removes a query's shuffle files when that query ends, instead of whenever the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def root(spark: SparkSession) -> str:
    """The shared folder, as a URI without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="touchline-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and return it, reread: lineage is cut, and the driver's memory that planning it took is given back.

    The files outlive lost executors. They stay until drop() or the end of the cluster's folder.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/touchline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    memory.relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._touchline_path = path
    _made[path] = out
    return out


def drop(df: DataFrame) -> None:
    """Remove the files of a table() that nothing reads any more."""
    path = df._touchline_path
    _made.pop(path, None)
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing() -> Iterator[set[str]]:
    """Drops at its end the tables made within, but those whose paths are added to the set: what still reads them must have been written."""
    before, keep = set(_made), set()
    try:
        yield keep
    finally:
        for path in set(_made) - before - keep:
            drop(_made[path])
