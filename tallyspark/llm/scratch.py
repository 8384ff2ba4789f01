"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Every operator that needs a table twice, or has to cut a long lineage, writes it here as Parquet and
reads it back, so a lost executor costs one task and never the whole plan.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made here because a session (a test, say) names no shared one, by application id.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


class Scratch:
    """One run's tables in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return it as read back from there."""
        with small_batches(self.spark):
            df.write.options(compression="zstd", **options).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again, and let Spark drop shuffle files of finished jobs."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit columns that name a row: its id (null: the largest long) and a hash of id and text.

    Repeated rows share a key and every operator gives them the same result.
    """
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    return ident.alias("key_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key_hash")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """``name`` as the column of that name, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, Arrow batches have ``rows`` rows at most (their bytes Spark bounds itself); a stricter setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``rows`` rows and about ``size`` bytes, one row at least.

    Between slices, memory that is free again goes back to the machine.
    """
    for batch in batches:
        at = 0
        while at < len(batch):
            piece = batch.slice(at, rows)
            while len(piece) > 1 and piece.nbytes > size:
                piece = piece.slice(0, (len(piece) + 1) // 2)
            at += len(piece)
            yield piece
        give_back()


def give_back() -> None:
    """Return memory that this worker has freed to the machine, which runs other workers beside it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None
