"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession


#: Temporary folders by application, where spark.checkpoint.dir is unset.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="crawlmill-")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, name: str, codec: str | None = None) -> str:
    """Write a table to a new path of the shared folder. `codec` is Parquet's, by default the session's."""
    path = shared_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return path


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; it survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written_to(df, name, codec))


def read_whole(path: str) -> pa.Table:
    """A written table of bounded size, such as a model, read by a task from the shared folder; without rows it may lack columns."""
    fs, at = FileSystem.from_uri(path)
    return pq.read_table(at, filesystem=fs)
