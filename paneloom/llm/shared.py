"""What several operators need: size checks, fixed text rules, and the written tables that cut lineage."""

from __future__ import annotations

import pickle
import sys

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.sources.scratch import drop as drop_cut
from paneloom.sources.scratch import here, sweep
from paneloom.sources.scratch import staged as cut

__all__ = ["ascii_lower", "cut", "drop_cut", "fold_of", "here", "maybe_broadcast", "opened", "shipped", "small_batches", "small_enough", "sweep"]

#: Characters that separate words of white-space rules: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that one Arrow batch hands to Python; texts may be long.
BATCH_ROWS = 500


def by_value(module: str) -> None:
    """Ship the functions of a module inside the tasks, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def shipped(spark: SparkSession, model: object) -> Broadcast:
    """A model for the tasks, with its code, so that executors need no copy of the package; opened() gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def opened(model: Broadcast) -> object:
    """The model, opened once a process."""
    found = getattr(model, "_opened", None)
    if found is None:
        found = model._opened = pickle.loads(model.value)
    return found


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    """A-Z only. lower() would change other letters too, so it serves texts that are all ASCII, where it is faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold_of(doc_id: Column, folds: int = 4) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only a side whose size has been checked; otherwise the planner shuffles it."""
    return F.broadcast(df) if small_enough(df, rows) else df
