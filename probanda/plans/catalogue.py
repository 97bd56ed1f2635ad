"""All queries of the library outside the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evidence, review, robust, small, tabular, trials, visual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = tabular.QUERIES | evidence.QUERIES | robust.QUERIES | review.QUERIES | small.QUERIES | visual.QUERIES | trials.QUERIES
ORACLES: dict[str, str] = tabular.ORACLES | evidence.ORACLES | robust.ORACLES | review.ORACLES | small.ORACLES | visual.ORACLES | trials.ORACLES
FLAGSHIP = "pair_and_gate"
