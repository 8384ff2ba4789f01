"""Tables in the folder that all machines share, named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application id.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session that names none gets a folder until it ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tallyspark-core-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there as Parquet and read back: its rows are settled, and a lost executor costs a task."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
