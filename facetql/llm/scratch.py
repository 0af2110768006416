"""Shared scratch space: intermediate tables live where every executor can read them.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor then costs only the
tasks it was running.  In local mode, where that setting may be absent, ``/tmp/checkpoints`` is used;
on a cluster an absent setting is an error, because a machine-local folder would lose data.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "/tmp/checkpoints"
BROADCAST_ROWS = 500_000
_made: list[str] = []
_apart: list[str] = []


def root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_DEFAULT


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/facetql-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows (file, hdfs, s3, gs); a bare path is a local one."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` (narrow) rows; beyond that the join shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_apart(df: DataFrame, name: str) -> DataFrame:
    """Like ``materialize``, for results that outlive ``release``: at the program's end they go too."""
    path = new_path(df.sparkSession, name)
    _made.remove(path)
    _apart.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _delete(path: str) -> None:
    with contextlib.suppress(OSError, ValueError):
        fs, p = filesystem(path)
        if fs.get_file_info(p).type != pafs.FileType.NotFound:
            fs.delete_dir(p)


def release() -> None:
    """Delete every scratch table made so far; call only when no DataFrame built on them is still needed."""
    while _made:
        _delete(_made.pop())


def _release_all() -> None:
    _made.extend(_apart)
    release()


atexit.register(_release_all)
