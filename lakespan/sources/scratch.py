"""Intermediate tables in a folder that all machines share.

The folder is the one in spark.checkpoint.dir, else the one given to
SparkContext.setCheckpointDir. A session on one machine (master local) that
names neither gets a folder of its own in its warehouse, deleted when the
process ends; on a cluster that is an error, as each machine would write to its own disk.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = f"lakespan-scratch-{uuid.uuid4().hex}"
_PATHS: list[str] = []


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{_OWN}"
    if own not in _PATHS:
        _PATHS.insert(0, own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors cost nothing."""
    path = f"{folder(df.sparkSession)}/lakespan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> str | None:
    """A point to clear back to: the last table so far."""
    return _PATHS[-1] if _PATHS else None


def clear(spark: SparkSession, since: str | None = None, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables written since a mark, but for those with the names in keep; nothing may read them any more."""
    start = _PATHS.index(since) + 1 if since in _PATHS else 0
    for path in _PATHS[start:]:
        name = path.rsplit("/", 1)[1]
        if name == _OWN or name.removeprefix("lakespan-").rsplit("-", 1)[0] in keep:
            continue
        delete(spark, path)
        _PATHS.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _leave() -> None:
    """What this process wrote and did not clear goes with it, if its session still runs."""
    if not _PATHS:
        return
    try:
        spark = SparkSession.getActiveSession()
        for path in _PATHS if spark is not None else ():
            delete(spark, path)
    except Exception:  # the session ended first; its folder is the cluster's to clean
        return
