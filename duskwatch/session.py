"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # A fixed least number, so that files are split alike whatever the number of executors at the moment.
    "spark.sql.files.minPartitionNum": "64",
}


_STATIC = {
    # Without this every column expression records its Python call site, which slows the building of wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "duskwatch", **extra: str) -> SparkSession:
    """A session with the settings this package expects; master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for name, value in {**_SETTINGS, **_STATIC, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the same runtime settings to a session somebody else made."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="duskwatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_FOLDER: ContextVar[str | None] = ContextVar("scratch_folder", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(_FOLDER.get() or scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """What this thread writes to scratch meanwhile goes to one folder, which is deleted at the end.

    Only for work that is finished inside: a table that is read later must have been written elsewhere by then.
    """
    path = scratch_path(spark, label)
    before = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(before)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it back.

    Used where a table is read many times in one plan. Readers then prune columns, and a lost executor costs a re-read
    of files instead of a replay of the whole lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
