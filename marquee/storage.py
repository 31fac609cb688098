"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: by application, where no shared folder is set
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, as set on the session or on its context. Only where that is unset is another one chosen: a temporary folder in
    local mode (tests), else a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="marquee-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        found = _OWN[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marquee-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there, and a lost executor costs only
    the tasks that were running."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove staged tables, as ``stage`` returned them, that no plan still to be run reads."""
    for table in tables:
        drop_path(table.sparkSession, table._staged)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that Python code of a task opens ``path`` in, and the path there; file: addresses with any number of slashes are local ones."""
    return fs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
