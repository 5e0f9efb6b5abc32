"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import getpass
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine serves only a local master for which none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/paneloom-{getpass.getuser()}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/paneloom/{spark.sparkContext.applicationId}"


#: Shuffle files of a query go when it ends; a retried stage makes them anew.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that staged() has written and nothing has deleted yet.
_written: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        _written.append(path)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete what staged() wrote, once nothing will read it again."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path in _written:
            _written.remove(path)
            _delete(df.sparkSession, path)


def here() -> tuple[str, ...]:
    """What there is now, for sweep() to leave alone."""
    return tuple(_written)


def sweep(spark: SparkSession, keep: Iterable[DataFrame] = (), before: Iterable[str] = ()) -> None:
    """Delete every table that staged() has left but those of `keep` and `before`; results that still read one must be written before."""
    kept = {getattr(df, "_staged", None) for df in keep} | set(before)
    for path in [p for p in _written if p not in kept]:
        _written.remove(path)
        _delete(spark, path)


@atexit.register
def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context is not None else None
    if spark is not None:
        with contextlib.suppress(Exception):
            sweep(spark)
