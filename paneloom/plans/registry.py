"""All queries of the library and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paneloom.plans import cases, estimates, literal, places, relational, storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {**relational.QUERIES, **literal.QUERIES, **estimates.QUERIES, **places.QUERIES, **cases.QUERIES, **storage.QUERIES}
ORACLES: dict[str, str] = {**relational.ORACLES, **literal.ORACLES, **estimates.ORACLES, **places.ORACLES, **cases.ORACLES, **storage.ORACLES}
